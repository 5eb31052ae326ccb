"""Shapes of model output and the checks on them, as Column functions over variants."""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from groundsieve.functions import json_repair

cloudpickle.register_pickle_by_value(json_repair)

# The shapes of an answer and of a verification report. "text"
# is a string, a tuple the strings allowed, a list an array of its one item.
ANSWER = {
    "final_answer": "text",
    "claims": [{
        "claim_id": "text",
        "statement": "text",
        "supporting_passage_ids": ["text"],
        "support_type": ("direct", "interpretive"),
    }],
    "supporting_citations": [{"passage_id": "text", "quote": "text"}],
    "objections_raised": [{"issue": "text", "related_passage_ids": ["text"]}],
    "confidence_notes": "text",
}
REPORT = {
    "status": ("pass", "pass_with_warnings", "fail"),
    "supported_claims": ["text"],
    "unsupported_claims": [{"claim_id": "text", "reason": "text"}],
    "citation_issues": [{"passage_id": "text", "issue": "text"}],
    "notes": "text",
}


def spark_type(shape) -> str:
    """The Spark type of a shape, as DDL."""
    if isinstance(shape, list):
        return f"array<{spark_type(shape[0])}>"
    if isinstance(shape, dict):
        return "struct<" + ",".join(f"{k}:{spark_type(v)}" for k, v in shape.items()) + ">"
    return "string"


def json_schema(shape) -> dict:
    """The JSON schema of a shape."""
    if isinstance(shape, list):
        return {"type": "array", "items": json_schema(shape[0])}
    if isinstance(shape, dict):
        return {"type": "object", "properties": {k: json_schema(v) for k, v in shape.items()},
                "required": list(shape)}
    return {"type": "string"} | ({"enum": list(shape)} if isinstance(shape, tuple) else {})


def fits(value: Column, shape) -> Column:
    """True if a variant has the shape. Types are strict: a number is no
    string, null is nothing, but fields beyond the shape are allowed."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    if isinstance(shape, dict):
        fields = [fits(F.try_variant_get(value, f"$.{name}", "variant"), inner)
                  for name, inner in shape.items()]
        out = kind.startswith("OBJECT")
        for field in fields:
            out = out & field
        return out
    if isinstance(shape, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        return kind.startswith("ARRAY") & F.coalesce(
            F.forall(items, lambda item: fits(item, shape[0])), F.lit(False))
    out = kind == "STRING"
    if isinstance(shape, tuple):
        out = out & F.coalesce(F.try_variant_get(value, "$", "string").isin(*shape), F.lit(False))
    return out


def misfits(value: Column, shape: dict) -> Column:
    """Names of the top-level fields that are missing or have the wrong shape."""
    return F.array_compact(F.array(*[
        F.when(~fits(F.try_variant_get(value, f"$.{name}", "variant"), inner), name)
        for name, inner in shape.items()
    ]))


@F.pandas_udf(StringType())
def repair_json(outputs: pd.Series) -> pd.Series:
    """The JSON inside each output, or null; nulls pass through."""
    return outputs.map(lambda o: o if o is None else json_repair.json_candidate(o))
