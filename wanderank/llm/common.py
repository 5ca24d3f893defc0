"""Helpers shared by the training-data operators: scratch tables, safe columns, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept as written
from ..session import removed, scratch_path, scratch_scope, settings

#: White space that separates words: space and the ASCII controls 0x09 to 0x0D.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_RUN = r"[^\x20\x09-\x0D]+"


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def clear_of(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns (in any case) whose names an operator is about to give to its own columns."""
    own = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in own])


def as_scan(docs: DataFrame) -> DataFrame:
    """``docs`` if it reads files, so that its rows have places; else a copy written to the shared folder."""
    try:
        docs.select("_metadata.file_path")
        return docs
    except AnalysisException:
        return written(docs, "located")


def located(docs: DataFrame, name: str = "__at") -> DataFrame:
    """``docs`` with a column that tells its rows apart: file and row of a scan.

    The places are the same in every pass over one scan; who needs them in two passes calls ``as_scan`` first.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return as_scan(docs).withColumn(name, at)


def checked(table: DataFrame, rows: int) -> DataFrame:
    """A written table, broadcast in joins if it was found to have at most ``rows`` rows; else Spark shuffles it, and splits hot keys."""
    return F.broadcast(table) if table.count() <= rows else table


def maybe_broadcast(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df`` written once, and broadcast in joins if it was found to have at most ``rows`` rows."""
    return checked(written(df, name), rows)


def scoped(spark, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; all scratch tables that it needed are deleted."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        df = make()
        df.write.mode("overwrite").parquet(path)
        schema = df.schema
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


#: Rows and bytes of texts that are Python objects at once.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def per_text(rows: DataFrame, text_col: str, added: dict[str, tuple[str, pa.DataType]], make: Callable[[], Callable[[list[str]], dict]]) -> DataFrame:
    """``rows`` with the text replaced by the columns ``added`` (name -> SQL type, Arrow type).

    ``make`` is called in each task and returns the function from texts (null as "") to these columns. The other
    columns pass as they are, in Arrow; only a slice of the texts at a time becomes Python objects.
    """
    fields = [f for f in rows.schema.fields if f.name != text_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            others = [batch.column(batch.schema.get_field_index(n)) for n in names]
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                before = ends[at - 1] if at else 0
                n = max(1, min(SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")) - at))
                made = work([t or "" for t in texts.slice(at, n).to_pylist()])
                new = [pa.array(made[name], kind) for name, (_, kind) in added.items()]
                yield pa.RecordBatch.from_arrays([c.slice(at, n) for c in others] + new, [*names, *added])
                at += n

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{name} {kind}" for name, (kind, _) in added.items())])
    return rows.mapInArrow(run, schema)


__all__ = [
    "SPACE_RUN",
    "WORD_RUN",
    "as_scan",
    "checked",
    "clear_of",
    "located",
    "maybe_broadcast",
    "per_text",
    "removed",
    "scoped",
    "scratch_path",
    "scratch_scope",
    "settings",
    "utf8_size",
    "written",
]
