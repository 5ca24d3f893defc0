"""Matches of patterns with their places, by SQL functions only.

``split`` gives what lies between the matches of a pattern and ``regexp_extract_all`` the matches; both walk the
text alike, leftmost and without overlaps, so that the running sum of their lengths gives the offsets, in
code points. Nothing leaves the row: no explode, no exchange.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a candidate's surroundings that are kept on each side.
CONTEXT = 32
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>"


def with_spans(rows: DataFrame, text: Column, patterns: dict[str, str], prefix: str = "__") -> DataFrame:
    """``rows`` with a column ``<prefix><kind>`` for each pattern: array of SPAN, in order of place.

    A text without a match, as most are, is passed over once; only others are cut up.
    """
    pieces, matches = {}, {}
    for kind, pattern in patterns.items():
        has = text.rlike(pattern)
        pieces[f"__p_{kind}"] = F.when(has, F.split(text, pattern, -1))
    rows = rows.withColumns(pieces)
    for kind, pattern in patterns.items():
        matches[f"__m_{kind}"] = F.when(F.col(f"__p_{kind}").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = rows.withColumns(matches)
    made = {f"{prefix}{kind}": _placed(kind, F.col(f"__p_{kind}"), F.col(f"__m_{kind}")) for kind in patterns}
    return rows.withColumns(made).drop(*pieces, *matches)


def _placed(kind: str, pieces: Column, found: Column) -> Column:
    long = lambda c: F.char_length(c).cast("bigint")
    steps = F.transform(found, lambda m, i: F.struct(long(F.get(pieces, i)).alias("skip"), long(m).alias("len")))
    none = F.array().cast("array<bigint>")
    starts = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")),
        lambda acc, s: F.struct((acc["at"] + s["skip"] + s["len"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + s["skip"])).alias("out")),
        lambda acc: acc["out"],
    )
    numbered = F.transform(
        found,
        lambda m,
        i: F.struct(m.alias("m"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("b"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("a")),
    )
    spans = F.zip_with(
        numbered,
        starts,
        lambda x,
        s: F.struct(
            F.lit(kind).alias("kind"),
            s.alias("start"),
            (s + long(x["m"])).alias("end"),
            x["m"].alias("value"),
            x["b"].alias("before"),
            x["a"].alias("after"),
        ),
    )
    return F.coalesce(spans, F.array().cast(f"array<{SPAN}>")).cast(f"array<{SPAN}>")


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(spark, rows: list[dict]) -> DataFrame:
    """Labelled findings of the driver (kind, value, before, after, label) as a constant table of the plan."""
    kind = "array<struct<kind:string,value:string,before:string,after:string,path:string,label:double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def count_of(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")
