from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Rows of one Column function over a list of inputs, in order."""
    from pyspark.sql import functions as F

    def run(function, inputs, kind="string"):
        rows = spark.createDataFrame(list(enumerate(inputs)), f"n int, x {kind}")
        got = rows.select("n", function(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(got, key=lambda r: r["n"])]

    return run


PROVERBS = """Patience wears down the hardest stone.
A patient farmer waits for the late rain.
Charity given in secret cools anger.
Feed the poor before you feed your guests.
Mercy belongs to those who show mercy.
Forgiveness is the finest form of mercy.
Prayer at dawn steadies the heart.
Those who pray together mend their quarrels.
Fasting teaches the hand to give.
Honour your mother and your father.
The righteous are repaid with gardens.
A river does not drink its own water.
Truth spoken softly travels far.
Do not eat what was taken by force.
The traveller greets the village first.
Knowledge is a lamp for two roads.
Count your blessings before your losses.
The strong man masters his anger.
A guest stays three days and no more.
Every shepherd answers for the flock."""


@pytest.fixture(scope="session")
def proverbs(spark):
    return spark.createDataFrame(
        [("book", PROVERBS, "paragraph", "natural_units")],
        "document_id string, text string, sectioning_strategy string, passage_strategy string")
