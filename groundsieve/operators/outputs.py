"""Raw model outputs to checked records: validation, repair and choice of attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from groundsieve.functions.outputs import fits, misfits, repair_json, spark_type

MAX_ATTEMPTS = 3


def is_whole_json(text: Column) -> Column:
    """True if the text is one JSON value: the parser stops behind the first
    value, so what follows it shows only where the text stands inside another one."""
    inside = (F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}")))
    return (F.try_parse_json(text).isNotNull() & F.try_parse_json(inside[0]).isNotNull()
            & F.try_parse_json(inside[1]).isNotNull())


def check_outputs(attempts: DataFrame, shape: dict) -> DataFrame:
    """Parses and validates attempts(query_id, attempt, raw_output[, transport_error]).

    An output parses if it is one JSON value and nothing else; text behind the
    value goes to the repair like text before it. Repeated keys and the bare words NaN
    and Infinity are no JSON here and end as json_parse.

    Adds parsed (null unless valid), failure_stage (llm_error, json_parse,
    schema_validation or null), failure_reason, repair_attempted and
    repair_succeeded. Only outputs that do not parse are sent to the repair.
    """
    if "transport_error" not in attempts.columns:
        attempts = attempts.withColumn("transport_error", F.lit(None).cast("string"))
    lost = F.col("transport_error").isNotNull()
    parses = is_whole_json(F.col("raw_output"))
    checked = (
        attempts.withColumn("repair_attempted", ~lost & ~parses)
        .withColumn("_repaired", repair_json(F.when(F.col("repair_attempted"), F.col("raw_output"))))
        .withColumn("_text", F.when(lost, None).when(F.col("repair_attempted"), F.col("_repaired"))
                    .otherwise(F.col("raw_output")))
        .withColumn("_value", F.try_parse_json("_text"))
        .withColumn("_valid", F.coalesce(fits(F.col("_value"), shape), F.lit(False)))
        .withColumn("repair_succeeded", F.col("repair_attempted") & F.col("_value").isNotNull())
    )
    stage = (
        F.when(lost, "llm_error").when(F.col("_value").isNull(), "json_parse")
        .when(~F.col("_valid"), "schema_validation")
    )
    reason = (
        F.when(F.col("failure_stage") == "llm_error",
               F.concat(F.lit("llm_error: "), "transport_error"))
        .when(F.col("failure_stage") == "json_parse", F.lit("json_parse: no valid JSON found"))
        .when(F.col("failure_stage") == "schema_validation", F.concat(
            F.lit("schema_validation: "), F.array_join(misfits(F.col("_value"), shape), ", ")))
    )
    return (
        checked.withColumn("failure_stage", stage).withColumn("failure_reason", reason)
        .withColumn("parsed", F.when(F.col("_valid"), F.from_json("_text", spark_type(shape))))
        .drop("_repaired", "_text", "_value", "_valid")
    )


def resolve_attempts(checked: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One result per query: attempts count up to the first valid one, a
    transport error, or ``max_attempts``; later rows are ignored."""
    item = F.struct("attempt", "failure_stage", "failure_reason", "repair_attempted",
                    "repair_succeeded", "raw_output", "parsed")
    rows = checked.where(F.col("attempt") <= max_attempts).groupBy("query_id").agg(
        F.sort_array(F.collect_list(item)).alias("tries"))

    def ends(t: Column) -> Column:
        return t["failure_stage"].isNull() | (t["failure_stage"] == "llm_error")

    last = F.array_position(F.transform("tries", ends), True).cast("int")
    used = F.slice("tries", 1, F.when(last > 0, last).otherwise(F.size("tries")))
    end = F.element_at("used", -1)
    return rows.withColumn("used", used).select(
        "query_id",
        end["failure_stage"].isNull().alias("success"),
        F.size("used").alias("attempts"),
        end["failure_reason"].alias("failure_reason"),
        F.exists("used", lambda t: t["repair_attempted"]).alias("repair_attempted"),
        F.exists("used", lambda t: t["repair_succeeded"]).alias("repair_succeeded"),
        F.array_compact(F.transform("used", lambda t: t["raw_output"])).alias("raw_outputs"),
        end["parsed"].alias("parsed"),
    )


def latest(rows: DataFrame, order: str, by: str = "query_id", ties: tuple = ()) -> DataFrame:
    """The row with the greatest ``order`` of each query, as in the newest artifact
    or the report of the last generation round. Of rows with one order that with the
    greatest ``ties`` counts; name columns there that tell rows apart."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(by).agg(F.max_by(whole, F.struct(order, *ties)).alias("row")).select("row.*")


def matched_rounds(bundles: DataFrame, drafts: DataFrame, reports: DataFrame, at: str = "created_at",
                   tie: str = "artifact_id") -> DataFrame:
    """Every draft with the bundle and the report of its time: query_id, round (from 1), and
    draft, bundle and report as structs, null where there is none.

    A draft was made from the newest bundle there was, and a report looks at the newest draft
    there was; of several reports of a draft the last one counts. Artifacts of one time go in the
    order bundle, draft, report, those of one kind by ``tie``. The artifacts of a query are
    few: a handful for each time it was answered.
    """
    kinds = {"bundle": bundles, "draft": drafts, "report": reports}
    whole = {name: F.struct(*[F.col(c) for c in rows.columns]) for name, rows in kinds.items()}
    events = [rows.select(
        "query_id", F.col(at).alias("at"), F.lit(step).alias("step"), F.col(tie).cast("string").alias("tie"),
        *[(whole[n] if n == name else F.lit(None)).alias(n) for n in kinds])
        for step, (name, rows) in enumerate(kinds.items())]
    rows = events[0].unionByName(events[1]).unionByName(events[2])
    order = W.partitionBy("query_id").orderBy("at", "step", "tie").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("round", F.sum((F.col("step") == 1).cast("int")).over(order)).withColumn(
        "bundle", F.last("bundle", ignorenulls=True).over(order))
    checks = placed.where("step = 2 AND round > 0").groupBy("query_id", "round").agg(
        F.max_by("report", F.struct("at", "tie")).alias("report"))
    return placed.where("step = 1").select("query_id", "round", "draft", "bundle").join(
        checks, ["query_id", "round"], "left")
