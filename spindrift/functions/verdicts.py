"""A judge model's reply as columns, parsed with JSON and regular-expression functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.taxonomy import CLASSES


def verdict(text: Column) -> Column:
    """struct(success_prob, progress, failure_class, rationale, parse_error).

    A fenced object is taken first, else the widest run from { to }.  A reply
    without a finite success_prob (or with a progress that is no number) is a
    parse error and counts as one half.  Probabilities are clipped to [0, 1], an
    unknown class is null.
    """
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    body = F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))
    field = lambda name: F.get_json_object(body, f"$.{name}")

    def number(name):
        x = field(name).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    p = number("success_prob")
    q = F.when(field("progress").isNull(), p).otherwise(number("progress"))
    bad = p.isNull() | q.isNull()
    clip = lambda x: F.when(bad, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    name = F.lower(F.trim(field("failure_class")))
    words = F.concat_ws(" ", F.nullif(F.trim(field("final_state_evidence")), F.lit("")), F.nullif(F.trim(field("rationale")), F.lit("")))
    return F.struct(
        clip(p).alias("success_prob"),
        clip(q).alias("progress"),
        F.when(~bad & name.isin(CLASSES), name).alias("failure_class"),
        F.when(bad, "could not parse the judge reply").otherwise(F.substring(words, 1, 500)).alias("rationale"),
        bad.alias("parse_error"),
    )
