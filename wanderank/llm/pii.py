"""Personal data by candidate gradient boosting, in SQL functions only.

High-recall generators, one pattern each, propose spans that may overlap. Four base kinds are checked by
format alone and always stay. Spans of the other generators are described by features of their format and
of the words around them, scored by boosted trees that are part of the query's expression, calibrated, and
selected where the calibrated probability reaches their kind's threshold and no base span overlaps them.

The trees are fitted on the driver to ``FINDINGS`` labelled findings that a seeded generator composes (the
tables hold no labels of personal data); a third of them is held out for calibration and thresholds.

The whole operator is a map over the documents: no exchange, and a document's spans stay in its row.

Defined results: null and empty texts have no spans; offsets are code points of the whole text; repeated rows
are judged each; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import clear_of
from .spans import SPAN, count_of, findings, flag, told, with_spans

# Base kinds. Possessive quantifiers and look-behinds change no match; they keep the matcher from stepping back
# and from recursing, so that long runs of digits or letters cost linear time and constant stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text is searched for cards only where a run of these can hold 16 digits.
CARD_HINT = r"[0-9][\x20-]?[0-9](?:[\x20-]?[0-9]){14}"
#: Further generators: local phone numbers, social security numbers, bank accounts, spelled-out addresses.
MORE = {
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]?[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[({]?(?:at|AT)[\])}]?\x20?[A-Za-z0-9-]{2,}+\x20?[\[({]?(?:dot|DOT)[\])}]?\x20?[A-Za-z]{2,6}(?![A-Za-z0-9])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
FINDINGS, SEED, PRECISION = 2400, 17, 0.95
PERSONAL = r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|contact|reach|text|ssn|social|security|taxpayer|iban|account|bank|transfer|mail|email|write|address)\b"
IMPERSONAL = r"(?i)\b(?:order|part|item|version|isbn|ref|reference|invoice|model|serial|score|page|room|ticket|sku|build|no|nr|number|id|code|look|arrived|meet)\b"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass Luhn's test."""
    d = digits(value)
    n = F.char_length(d)

    def part(i: Column) -> Column:
        v = F.substr(d, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + part(i))
    return (n > 0) & (total % 10 == 0)


def base_spans(kind: str, found: Column) -> Column:
    """The matches that are of the kind; others are dropped without another try."""
    if kind == "ip":
        return F.filter(found, lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        return F.filter(found, lambda s: F.char_length(digits(s["value"])).between(16, 19) & luhn(s["value"]))
    if kind == "phone":
        return F.filter(found, lambda s: F.char_length(digits(s["value"])).between(8, 15))
    return found


def features(kind: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    d = digits(value)
    near = F.concat_ws(" ", before, after)
    return [
        *(flag(kind == k) for k in MORE),
        F.char_length(value).cast("double"), F.char_length(d).cast("double"), count_of(value, r"[\x20.()-]"),
        count_of(value, "[A-Z]"), count_of(value, "[a-z]"),
        flag(value.rlike(r"[\[({]")), flag(value.rlike(r"^\(?[2-9]")), flag(value.rlike(r"^(?:000|666|9)")),
        flag(d.rlike(r"^([0-9])\1+$")), flag(d.rlike("(?:0123|1234|2345|3456|4567|5678|6789)")),
        flag(before.rlike(r"[A-Za-z0-9]$")), flag(after.rlike(r"^[A-Za-z0-9]")), flag(before.rlike(r"[:#=]\s?$")),
        count_of(before, PERSONAL), count_of(before, IMPERSONAL), count_of(after, PERSONAL), count_of(near, IMPERSONAL), count_of(near, r"[0-9]"),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[dict]:
    """Composed findings of the further generators, personal (1) and other (0), in usual surroundings."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices("etaoinshrdluc", k=r.randrange(2, 9)))
    personal = "tel phone call mobile cell fax contact reach text ssn social-security iban account bank mail email write".split()
    other = "order part item version isbn ref invoice model serial score page room ticket sku build number id code look arrived meet".split()
    out = []
    for i in range(n):
        kind, label = list(MORE)[i % len(MORE)], r.random() < 0.5
        sep = r.choice(" .-")
        if kind == "local_phone":
            value = f"{r.randrange(2, 10) if label else r.randrange(0, 10)}{num(2)}{sep}{num(3)}{sep}{num(4)}"
            value = f"({value[:3]}){value[3:]}" if label and r.random() < 0.4 else value
        elif kind == "ssn":
            value = f"{r.randrange(1, 666):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10_000):04d}" if label else f"{r.choice(['000', '666', num(3), '9' + num(2)])}-{num(2)}-{num(4)}"
        elif kind == "iban":
            value = "".join(r.choices("ABDEFGILNPST", k=2)) + num(2) + "".join((" " if sep == " " else "") + (num(4) if label or r.random() < 0.5 else "".join(r.choices("ABCDEFGHJK0123456789", k=4))) for _ in range(r.randrange(3, 6)))
        else:
            at, dot = (r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" AT ", " DOT ")]) if label else (" at ", " dot "))
            value = f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if label else f"{word()} at {word()} dot {word()[:6]}"
        hint = r.choice(personal if r.random() < (0.8 if label else 0.1) else other if r.random() < (0.1 if label else 0.75) else [word()])
        before = f"{word()} {word()} {hint}{r.choice([': ', ' ', ' ', ' = '])}"[-32:]
        out.append({
            "kind": kind,
            "value": value,
            "before": before,
            "after": f"{r.choice([' ', '. ', ', '])}{word()} {word()}"[:32],
            "path": "",
            "label": float(label),
        })
    return out


@functools.lru_cache(maxsize=1)
def _fitted(rows: tuple) -> tuple[list, float, float, dict[str, float]]:
    """Trees, calibration and thresholds by kind, from (kind, label, features) rows."""
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    kinds = np.array([r[0] for r in rows])
    test = np.arange(len(rows)) % 3 == 2
    model = trees.boosted(x[~test], y[~test])
    score = sum(trees.values(t, x) if isinstance(t, tuple) else np.full(len(x), t) for t in model)
    slope, offset = trees.platt(score[test], y[test])
    p = 1 / (1 + np.exp(-(slope * score + offset)))
    return model, slope, offset, {k: trees.least_threshold(p[test & (kinds == k)], y[test & (kinds == k)], PRECISION) for k in MORE}


def model(spark: SparkSession):
    """The model, fitted to the composed findings' features as the query's own expressions compute them."""
    table = findings(spark, labelled_findings())
    parts = features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    rows = table.select("kind", "label", F.array(*parts).alias("x")).collect()
    return _fitted(tuple((r["kind"], r["label"], tuple(r["x"])) for r in rows))


def selected(spans: Column, base: Column, fitted) -> Column:
    """Candidates whose calibrated probability reaches their kind's threshold and that no base span overlaps."""
    grown, slope, offset, least = fitted
    described = F.transform(spans, lambda s: F.struct(s.alias("s"), F.array(*features(s["kind"], s["value"], s["before"], s["after"])).alias("x")))

    def keeps(c: Column) -> Column:
        score = functools.reduce(lambda a, t: a + trees.column(t, lambda i: F.get(c["x"], F.lit(i))), grown, F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(score * slope + offset)))
        threshold = functools.reduce(lambda rest, k: F.when(c["s"]["kind"] == k, F.lit(least[k])).otherwise(rest), least, F.lit(1.1))
        return (p >= threshold) & ~F.exists(base, lambda b: (b["start"] < c["s"]["end"]) & (b["end"] > c["s"]["start"]))

    return F.transform(F.filter(described, keeps), lambda c: c["s"])


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_spans and all_spans (arrays of SPAN)."""
    own = [*(f"n_{k}" for k in BASE), "base_spans", "all_spans"]
    docs = clear_of(docs, *own)
    fitted = model(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_spans(docs, text, {k: p for k, p in (BASE | MORE).items() if k != "card"})
    hinted = F.when(text.rlike(CARD_HINT), text).otherwise(F.lit(""))
    rows = with_spans(rows, hinted, {"card": BASE["card"]})
    rows = rows.withColumns({f"__{k}": base_spans(k, F.col(f"__{k}")) for k in BASE})
    rows = rows.withColumn("base_spans", F.concat(*[F.col(f"__{k}") for k in BASE]))
    more = F.concat(*[F.col(f"__{k}") for k in MORE])
    extra = F.when(F.size(more) > 0, selected(more, F.col("base_spans"), fitted)).otherwise(F.array().cast(f"array<{SPAN}>"))
    rows = rows.withColumns({f"n_{k}": F.size(F.col(f"__{k}")).cast("bigint") for k in BASE}).withColumn("all_spans", F.concat("base_spans", extra))
    return rows.drop(*[f"__{k}" for k in BASE | MORE])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``redacted``: the text with each selected span as [KIND], overlaps as one."""
    rows = personal_data(docs, text_col)
    ordered = F.array_sort(F.transform("all_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["out"],
                F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")),
                F.lit("["),
                F.upper(s["kind"]),
                F.lit("]"),
            ).alias("out"),
        ),
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1)),
    )
    return rows.withColumn("redacted", done)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op7."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        F.sha2(told(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        told(F.col("all_spans")).alias("spans"),
    )
