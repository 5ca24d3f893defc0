"""Mixing sources to target weights by systematic sampling.

In each source every document expects the same number of copies, the source's target over its size.
Documents are put in order of length class and then of a hash, their expected copies are summed up along
that order, one random offset is added, and a document is emitted once for each integer that its step
passes. The copies of a source are thus as many as expected, to within one, in every length class too, so
that its words come near the target, and no document is emitted more often than its expectation rounded up.

The texts are read once, for a thin table of each row's locator, source, size and hash; all else works on that, and
the mix itself fetches the texts by their locators, which are unique.

The running sum needs no global sort: the order is cut into cells (source, length class, hash bucket), the
cells are counted (partial aggregation), the counts are summed along the cells, and rows are ranked only
inside their cell. A source with a third of all rows has many buckets; no task gets a whole source. There are a few
cells for each shuffle partition, so that the sum along a source's cells stays as short however many its rows are.

Defined results: a null source is a source of its own, after all others; a null, empty or blank text has
size 0 and is emitted like others but counts no words; repeated rows are drawn one by one; an empty table
gives no rows; input columns with the names added here (in any case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RUN, as_scan, checked, clear_of, located, maybe_broadcast, scoped, written

#: Weights of the sources in code point order, null last, repeating; share of all words to take; most times a source's size.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Length classes per doubling of the size; cells for each shuffle partition, and the fewest rows that one is planned for.
CLASSES, CELLS, CELL_ROWS = 8, 8, 64
#: Most rows of a table of counts that is broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000
OWN = ("size", "source_size", "target", "taken", "copies")


def n_words(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, n) with the column ``target``.

    A source gets ``level * weight`` but at most ``most`` times its size; the level is such that all targets
    sum up to ``share`` of all sizes. Handing out by weight and resharing the excess ends in just this.
    The sources sorted by the level at which they fill up give the level in closed form.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__w", weight).withColumn("__cap", most * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "__filled": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
        "__open": F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
        "__all": share * F.sum("source_size").over(whole).cast("double"),
    })
    level = (F.col("__all") - F.col("__filled")) / F.col("__open")
    # the first source that its level does not fill: all after it stay open too
    rows = rows.withColumn(
        "__level",
        F.min(F.when(level * F.col("__w") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("__w"), level.alias("level")))).over(whole)["level"],
    )
    target = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("__w")))
    return rows.withColumn("target", target).drop("__w", "__cap", "__filled", "__open", "__all", "__level")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same in every run and in other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def _thin(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(__at, size, __src, __no, __class, __digest) and the columns ``keep`` of each row of a scan, written: the texts are read once."""
    digest = F.md5(F.concat_ws(
        ":",
        F.lit(str(seed)),
        F.col(id_col).cast("string"),
        F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null")),
    ).cast("binary"))
    source = F.col(source_col).cast("string")
    rows = located(docs).select(
        "__at",
        *keep,
        n_words(F.col(text_col)).alias("size"),
        F.coalesce(source, F.lit("")).alias("__src"),
        source.isNull().alias("__no"),
        digest.alias("__digest"),
    )
    return written(rows.withColumn("__class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * CLASSES).cast("int")), "mix-thin")


def drawn(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One thin row per row of the scan ``docs``: __at, the columns ``keep``, size, source_size, target (its source's), copies and taken = copies * size."""
    thin = _thin(docs, seed, id_col, text_col, source_col, keep)
    # (source, length class) decides the order; the number of hash buckets follows the rows of each
    keys = ["__src", "__no", "__class"]
    classes = written(thin.groupBy(*keys).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")), "mix-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    cell_rows = max(CELL_ROWS, total // (CELLS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    source = F.when(~F.col("__no"), F.col("__src"))
    goals = targets(classes.groupBy("__src", "__no").agg(F.sum("s").alias("source_size")).withColumn("source", source)).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = F.ceil(F.col("n") / cell_rows).cast("int")
    classes = classes.join(goals, ["__src", "__no"]).select(*keys, "source_size", "target", rate.alias("__rate"), buckets.alias("__buckets"))
    bucket = F.floor(F.conv(F.substring("__digest", 1, 8), 16, 10).cast("bigint") * F.col("__buckets") / F.lit(float(1 << 32))).cast("int")
    rows = thin.join(maybe_broadcast(classes, "mix-rates", BROADCAST_ROWS), keys).withColumn("__bucket", bucket)
    cell = [*keys, "__bucket"]
    along = Window.partitionBy("__src", "__no").orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).select(*cell, F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"))
    ranked = rows.join(maybe_broadcast(cells, "mix-cells", BROADCAST_ROWS), cell).withColumn(
        "__in",
        F.row_number().over(Window.partitionBy(*cell).orderBy("__digest")),
    )
    offset = _unit(F.lit(f"offset {seed}"), F.col("__src"), F.col("__no").cast("string"))
    passed = lambda r: F.floor(offset + F.col("__rate") * r.cast("double"))
    rank = F.col("__before") + F.col("__in")
    ranked = ranked.withColumn("copies", (passed(rank) - passed(rank - 1)).cast("int"))
    return ranked.select("__at", *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def expected_copies(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's), ``copies`` and ``taken`` = copies * size."""
    docs = as_scan(clear_of(docs, *OWN, "__at"))
    return located(docs).join(
        checked(scoped(docs.sparkSession, "mix-drawn", lambda: drawn(docs, seed, id_col, text_col, source_col)), BROADCAST_ROWS),
        "__at",
    ).drop("__at")


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: every document as often as it was drawn, with the columns of ``docs``."""
    docs = as_scan(clear_of(docs, "__at"))
    copies = checked(
        scoped(docs.sparkSession, "mix-drawn", lambda: drawn(docs, seed).where("copies > 0").select("__at", F.col("copies").alias("__copies"))),
        BROADCAST_ROWS,
    )
    rows = located(docs).join(copies, "__at")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drawn(docs, keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in DuckDB's SQL.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(doc_id::VARCHAR || ':', '') || coalesce(md5(text), 'null')) AS digest
  FROM documents),
classed AS (SELECT *, CAST(floor(log2(size + 1.0::DOUBLE) * 8) AS INT) AS class FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
                   2.0::DOUBLE * source_size AS cap FROM sizes),
summed AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS still,
                  1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS whole FROM weighed),
levels AS (SELECT (whole - filled) / still AS level FROM summed WHERE (whole - filled) / still * w <= cap ORDER BY cap / w LIMIT 1),
goals AS (SELECT source, source_size, n, coalesce(least(cap, (SELECT level FROM levels) * w), cap) AS target FROM summed),
ranked AS (
  SELECT c.doc_id, c.size, g.source_size, g.target, c.source,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY c.source ORDER BY c.class, c.digest) AS rank
  FROM classed c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source),
steps AS (SELECT *, ('0x' || substr(md5('offset 7:' || coalesce(source, '') || ':' || (source IS NULL)::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST((floor(off + rate * rank) - floor(off + rate * (rank - 1))) * size AS BIGINT) AS taken
FROM steps
"""
