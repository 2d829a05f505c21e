"""Streaming twins of the append-only caches: an upserted last-wins table and a capped history.

Each micro-batch is merged by key into the table's next version, written beside the last; the pointer is the newest
complete version, so a failed batch leaves the table as it was and a repeated batch writes the same version again. The
newest ``KEPT`` versions stay, older ones are removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossmill.operators import history
from glossmill.sources.readers import cache_last_wins


KEPT = 2


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of complete versions, by the marker that a finished write leaves."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append(int(name[2:]))
    return sorted(found)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version (before batch ``before``), or None."""
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v={known[-1]}") if known else None


def _write_version(table: DataFrame, path: str, number: int) -> None:
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{path}/v={number}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for v in _versions(spark, path)[:-KEPT]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}"), True)


def upsert_cache(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: str = "line_no") -> StreamingQuery:
    """Keep the last value of every key of a stream of cache lines; returns the running query (all available data, then stops)."""

    def merge(batch: DataFrame, number: int) -> None:
        old = current(batch.sparkSession, path, number)
        lines = batch if old is None else batch.unionByName(old.drop("first_line").withColumnRenamed("last_line", order).select(*batch.columns))
        _write_version(cache_last_wins(lines, key, order), path, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_history(stream: DataFrame, path: str, checkpoint: str, owner: str, ts: str, id_col: str, cap: int = history.CAP) -> StreamingQuery:
    """Keep each owner's newest ``cap`` entries of a stream."""

    def merge(batch: DataFrame, number: int) -> None:
        old = current(batch.sparkSession, path, number)
        rows = batch if old is None else batch.unionByName(old.select(*batch.columns))
        _write_version(history.latest(rows, owner, ts, id_col, cap).drop("place"), path, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts a window and type with a watermark; works on streams and on tables alike."""
    from pyspark.sql import functions as F

    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
