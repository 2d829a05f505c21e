"""Scans and sinks. Downloads are outside: every reader takes files that are already in a folder Spark can read."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``text``): whole files, UTF-8 with a byte order mark removed and bad bytes replaced; gzip by extension."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole-file JSON: an array gives a row an element, an object one row."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with a header and quoted fields over several lines; all columns are strings, chosen by name."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    known = {c.lstrip("﻿"): c for c in df.columns}
    return df.select(*[(F.col(f"`{known[c]}`") if c in known else F.lit(None).cast("string")).alias(c) for c in columns])


def read_zipped_csv(spark: SparkSession, path: str, member: str, columns: Sequence[str]) -> DataFrame:
    """A CSV inside ZIP archives: archives are spread over tasks, each read by one."""
    schema = ", ".join(f"`{c}` string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for part in pd.read_csv(io.BytesIO(archive.read(member)), dtype=str, keep_default_na=False, encoding="utf-8-sig", chunksize=10_000):
                        yield part.reindex(columns=list(columns))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


#: Columns that ``write_cache`` adds: when a batch was appended, and a row's place in it.
BATCH, PLACE = "_batch", "_place"


def read_jsonl_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON-lines cache with ``line_no``; malformed lines are dropped, a missing path is an empty table.

    ``line_no`` is a struct that orders lines as they were appended, in whichever order Spark reads the files: by batch and
    place where ``write_cache`` noted them, else by the file's time and name and the place in the file.
    """
    try:
        lines = spark.read.text(path)
    except Exception as e:  # a cache that was never written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        line_no = "struct<batch: bigint, place: bigint, file: string, block: bigint, row: bigint>"
        return spark.createDataFrame([], f"line_no {line_no}, {schema}")
    meta = "_metadata"
    parsed = lines.select(
        F.from_json("value", f"{schema}, {BATCH} bigint, {PLACE} bigint", {"mode": "PERMISSIVE"}).alias("r"), "value", F.monotonically_increasing_id().alias("row"),
        F.unix_micros(f"{meta}.file_modification_time").alias("time"), F.col(f"{meta}.file_path").alias("file"), F.col(f"{meta}.file_block_start").alias("block"),
    )
    known = parsed.where(F.try_parse_json("value").isNotNull() & F.col("r").isNotNull())
    line_no = F.struct(F.coalesce(f"r.{BATCH}", "time").alias("batch"), F.coalesce(f"r.{PLACE}", F.lit(0)).alias("place"), "file", "block", "row")
    return known.select(line_no.alias("line_no"), "r.*").drop(BATCH, PLACE)


def cache_last_wins(log: DataFrame, key: Sequence[str], order: str = "line_no") -> DataFrame:
    """One row a key: its last line's values, with ``first_line`` and ``last_line``. Rows with a null key are dropped.

    Two lines with one number cannot be told apart in time; the larger value row then wins.
    """
    rest = [c for c in log.columns if c not in key and c != order]
    clean = log.where(" and ".join(f"`{k}` is not null" for k in key))
    last = F.max(F.struct(order, *rest)).alias("last")
    out = clean.groupBy(*key).agg(F.min(order).alias("first_line"), last)
    return out.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest], "first_line", F.col(f"last.{order}").alias("last_line"))


class PagedSource(DataSource):
    """A paged row service as a Spark source: one task a page.

    Options: ``total`` rows, ``page`` rows a page. ``fetch(offset, limit)`` is given by ``paged_source``.
    """

    fetch: Callable[[int, int], list[tuple]] | None = None
    columns = ""
    title = "paged"

    @classmethod
    def name(cls) -> str:
        return cls.title

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options["total"]), int(self.options.get("page", 100)), int(self.options.get("start", 0)))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int, int], list[tuple]], total: int, page: int, start: int):
        self.fetch, self.total, self.page, self.start = fetch, total, page, start

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.start, self.total, self.page)] or [InputPartition(self.total)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value, min(self.page, self.total - partition.value)) if partition.value < self.total else []


def paged_source(title: str, columns: str, fetch: Callable[[int, int], list[tuple]]) -> type[PagedSource]:
    """A source class to register with ``spark.dataSource.register``; resume by the option ``start``."""
    return type("Paged", (PagedSource,), {"title": title, "columns": columns, "fetch": staticmethod(fetch)})


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """The lexicon as JSON lines, gzip-compressed, with a one-row ``_summary`` beside it."""
    from glossmill.operators.merge import lexicon_summary

    lexicon.write.mode("overwrite").option("compression", "gzip").json(f"{path}/entries")
    lexicon_summary(lexicon).write.mode("overwrite").json(f"{path}/summary")


def write_shards(rows: DataFrame, path: str) -> None:
    """Rows with a ``shard`` column as one folder a shard, so that lookups prune to the shards they need."""
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)


def write_cache(rows: DataFrame, path: str) -> None:
    """Append to a JSON-lines cache. Rows carry the time of their batch and their place in it, by which readers order them."""
    rows.withColumn(BATCH, F.lit(time.time_ns() // 1000).cast("bigint")).withColumn(PLACE, F.monotonically_increasing_id()).write.mode("append").json(path)
