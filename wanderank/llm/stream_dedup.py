"""Exact deduplication as a stateful stream with disk-backed keyed state that never expires.

Two streams run one after the other, each until all files are absorbed:

* The first reads the documents as a stream of files and reduces each row, once, to the SHA-256 of its normalised
  text, its stable id and the locator of its content (file and row in it). Text is not moved.
* The second streams these thin rows into keyed state, held by RocksDB on the executors' disks and in the checkpoint
  folder: per digest the smallest (id, locator), the locator first seen, and the number of rows. There is no
  watermark, so nothing expires, and a later run with the same ``state_dir`` goes on with new files only. Partial
  aggregation comes before the state's exchange, so that a group of copies with a third of all rows reaches it as
  one row per task. Each micro-batch checks its hits on the full bytes: the texts of the new rows and of the
  row first seen are fetched by their locators and compared, again with partial aggregation (the texts
  of a digest are all equal if the smallest is the largest), so that no group of copies comes together in a task.

Rows whose bytes differ though the digest is equal are grouped by their whole text instead.

Defined results: null text counts as empty; of repeated rows with the same smallest id, the one at the
smallest locator stays; a null id comes after all others (of a group of null ids only, the first locator
stays and keep_id is null); an empty table gives no rows; columns beside id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, scratch_path, settings, written

#: State on disk; changes are written to the checkpoint as change logs; no space is taken in advance for each of many stores.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests that one partition of a new state is planned for; most rows that a join broadcasts (about 150 bytes each).
STATE_ROWS, BROADCAST_ROWS = 2_000_000, 100_000
FILES_PER_BATCH = 1000


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(SPACE_RUN), F.lit(" "))


def _at() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _first() -> Column:
    """The row that stays: smallest id, nulls last, then the smallest locator."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("at")))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast in joins if its count allows it; else the join shuffles, and Spark splits its hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Dedup:
    """The streams, their state and their tables below ``state_dir``; ``path`` is a file or folder, not a pattern."""

    def __init__(self, spark: SparkSession, path: str, state_dir: str, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = FILES_PER_BATCH):
        self.spark, self.path, self.dir = spark, _escaped(path), state_dir.rstrip("/")
        self.text_col, self.files_per_batch = text_col, files_per_batch
        self.schema, self.stream_path = spark.read.parquet(self.path).schema, _streamable(spark, path)
        kind = self.schema[id_col].dataType.simpleString()
        self.id = F.col(id_col).alias("id")
        self.rows_schema = f"id {kind}, at struct<file:string,row:bigint>, digest string"
        self.state_schema = f"digest string, first struct<no_id:boolean,id:{kind},at:struct<file:string,row:bigint>>, anchor struct<batch:bigint,at:struct<file:string,row:bigint>>, n bigint"

    def _table(self, name: str, schema: str) -> DataFrame:
        """What the batches have written below ``name``, with the batch's number; no rows if there was none."""
        top = f"{self.dir}/{name}"
        if not _exists(self.spark, top):
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(top)

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(digest, norm) of the rows (at, digest), by their locators."""
        texts = self.spark.read.parquet(self.path).select(_at().alias("at"), F.col(self.text_col).alias("text"))
        return texts.join(_small(written(wanted, "dedup-wanted")), "at").select("digest", "at", normalised(F.col("text")).alias("norm"))

    def _hashed(self) -> None:
        """The first stream: id, locator and digest of each new row."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch).option("maxFileAge", "36500d").parquet(self.stream_path)
        thin = stream.select(self.id, _at().alias("at"), F.sha2(normalised(F.col(self.text_col)).cast("binary"), 256).alias("digest"))
        self._run(thin, "append", "seen", lambda batch, k: batch.write.mode("overwrite").parquet(f"{self.dir}/rows/batch={k}"))

    def _absorbed(self, new: DataFrame) -> None:
        """The second stream: thin rows into the state; ``new``: those rows that it has not seen."""
        stream = self.spark.readStream.schema(f"{self.rows_schema}, batch bigint").parquet(f"{self.dir}/rows")
        anchor = F.min(F.struct("batch", "at")).alias("anchor")
        state = stream.groupBy("digest").agg(_first().alias("first"), anchor, F.count(F.lit(1)).alias("n"))

        def keep(changed: DataFrame, k: int) -> None:
            path = f"{self.dir}/changes/batch={k}"
            changed.write.mode("overwrite").parquet(path)
            hits = self.spark.read.schema(self.state_schema).parquet(path).where("n > 1").select("digest", F.col("anchor.at").alias("anchor"))
            members = new.join(_small(hits), "digest").where("at <> anchor").select("at", "digest")
            wanted = members.unionByName(hits.select(F.col("anchor").alias("at"), "digest"))
            compared = self._texts(wanted).groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
            compared.where("a <> b").select("digest").write.mode("overwrite").parquet(f"{self.dir}/clashes/batch={k}")

        self._run(state, "update", "checkpoint", keep)

    def _run(self, df: DataFrame, mode: str, name: str, each) -> None:
        df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{self.dir}/{name}").trigger(availableNow=True).start().awaitTermination()

    def run(self) -> None:
        """Absorb all files that were not seen before. A run that fails is taken up by the next."""
        self._hashed()
        rows = self._table("rows", self.rows_schema)
        done = self._table("absorbed", "upto bigint").agg(F.max("upto")).first()[0]
        new = rows if done is None else rows.where(F.col("batch") > done)
        n, last = new.agg(F.count(F.lit(1)), F.max("batch")).first()
        if not _exists(self.spark, f"{self.dir}/rows"):
            return
        before = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with settings(self.spark, STATE_CONF | {"spark.sql.shuffle.partitions": str(max(before, n // STATE_ROWS + 1))}):
            self._absorbed(new.drop("batch"))
        if last is not None:
            self.spark.range(1).select(F.lit(last).cast("bigint").alias("upto")).write.mode("overwrite").parquet(f"{self.dir}/absorbed/batch={last}")

    def state(self) -> DataFrame:
        """(digest, first, n): a batch holds each digest that it changed once, and the last change is the state."""
        return self._table("changes", self.state_schema).groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))

    def told(self) -> DataFrame:
        """One row per row seen: id, keep_id, group_size, kept, text_sha256, file, row."""
        rows = self._table("rows", self.rows_schema).drop("batch")
        clashes = self._table("clashes", "digest string").select("digest").distinct()
        copied = _small(written(self.state().where("n > 1"), "dedup-copied"))
        if clashes.isEmpty():
            return _told(rows.join(copied, "digest", "left"))
        # equal digests of different bytes: group these digests by their whole text
        some = rows.join(clashes, "digest", "left_semi")
        texts = self._texts(some.select("at", "digest"))
        some = written(some.join(texts.select("at", "norm"), "at"), "dedup-clashing")
        by_text = some.groupBy("digest", "norm").agg(_first().alias("first"), F.count(F.lit(1)).alias("n"))
        exact = some.join(written(by_text, "dedup-by-text"), ["digest", "norm"]).select("digest", "id", "at", "first", "n")
        others = rows.join(copied, "digest", "left").join(clashes, "digest", "left_anti").select("digest", "id", "at", "first", "n")
        return _told(others.unionByName(exact))


def _told(rows: DataFrame) -> DataFrame:
    single = F.col("n").isNull()
    return rows.select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("at") == F.col("first.at"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("at.file").alias("file"),
        F.col("at.row").alias("row"),
    )


def _escaped(path: str) -> str:
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def _streamable(spark: SparkSession, path: str) -> str:
    """A file source streams folders and globs; a single file is given as a glob of itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return f"{_escaped(path[:-1])}[{path[-1]}]" if status.isFile() else _escaped(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def deduplicated(
    spark: SparkSession,
    path: str,
    state_dir: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """One row per row below ``path``: id, keep_id, group_size, kept, text_sha256, file, row."""
    dedup = Dedup(spark, path, state_dir or scratch_path(spark, "dedup-state"), id_col, text_col, files_per_batch)
    dedup.run()
    return dedup.told()


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op4."""
    found = deduplicated(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


#: The same groups in DuckDB's SQL.
ORACLE = r"""
WITH norm AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM norm
"""
