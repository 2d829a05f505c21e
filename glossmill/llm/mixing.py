"""Problem 8: draw documents so that each source has its target share of all tokens.

The total is the largest one that every source can reach within its repeat cap (or a given smaller one). A source's budget
is taken as whole copies of all its documents first; the rest is a sample without repeats by Pareto order sampling:
documents are ranked by the odds of a uniform number over the odds of their inclusion probability, which is proportional to
their size with sizes that would exceed 1 made certain. Ranks are cut where the rest is met, to the nearest document.

The cut is found on sums in 65,536 rank intervals per source, combined before the shuffle; only the one interval at the cut
is ordered document by document, so that a source with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.session import checkpointed, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_INTERVALS = 65_536


def token_counter(path: str = TOKENIZER):
    """A pandas UDF: the number of tokens of a text under the byte-level BPE of the file (null counts 0)."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for s in batches:
            yield s.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return F.pandas_udf(count, T.LongType())


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(``doc_id``, ``source``, ``n_tokens``) of the documents with at least one token, written down once."""
    counted = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", token_counter(path)("text").alias("n_tokens"))
    return checkpointed(counted.where("n_tokens > 0"))


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row a target source that has documents: ``source, target_share`` (of the present sources' sum)``, max_repeats, tokens,
    whole`` (certain copies) and ``rest`` (tokens still to sample). Null or non-positive shares and caps take no part."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").join(have, "source")
    everything = Window.partitionBy()  # one row a target source
    t = t.withColumn("target_share", F.col("target_share") / F.sum("target_share").over(everything))
    most = F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).over(everything)
    t = t.withColumn("budget", F.col("target_share") * (most if total is None else F.least(most, F.lit(float(total)))))
    whole = F.least(F.floor(F.col("budget") / F.col("tokens") + F.lit(1e-9)).cast("int"), "max_repeats")
    return t.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0.0)))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, path: str = TOKENIZER, total: float | None = None) -> DataFrame:
    """The drawn records: ``doc_id, source, n_tokens, repeats`` (at least 1).

    Null texts and sources without a target row are not drawn; empty tables give an empty result. The same seed draws the same records.
    """
    sizes = sized(documents, path)
    sources = checkpointed(plan(sizes, targets, total))
    docs = sizes.join(F.broadcast(sources.select("source", "whole", "rest")), "source")  # one row a target source
    by_size = docs.where("rest > 0").groupBy("source", "rest", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("n_tokens"))
    larger = F.coalesce(F.sum(F.col("n") * F.col("n_tokens")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.col("n") * F.col("n_tokens") * F.col("n_tokens")).over(down.rowsBetween(0, Window.unboundedFollowing))
    slopes = by_size.withColumn("slope", (F.col("rest") - larger) / squares).where(F.col("slope") * F.col("n_tokens") <= 1)
    slope = slopes.groupBy("source").agg(F.max_by("slope", "n_tokens").alias("slope"))
    p = F.least(F.col("slope") * F.col("n_tokens"), F.lit(1.0))
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    # q / (1 + q) of the Pareto rank q = (u / (1 - u)) / (p / (1 - p)) lies in [0, 1).
    rank = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    ranked = docs.join(F.broadcast(slope), "source", "left").withColumn("rank", F.when((F.col("rest") > 0) & (p > 0), rank))
    ranked = ranked.withColumn("interval", F.floor(F.col("rank") * _INTERVALS))
    sums = ranked.where("rank is not null").groupBy("source", "rest", "interval").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("interval"))
    cut = sums.withColumn("upto", upto).where("upto >= rest").groupBy("source").agg(F.min(F.struct("interval", (F.col("upto") - F.col("t")).alias("before"))).alias("c"))
    cut = cut.select("source", F.col("c.interval").alias("cut"), F.col("c.before").alias("before"))
    placed = ranked.join(F.broadcast(cut), "source", "left")
    at_cut = placed.where("interval = cut")
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id"))
    chosen = at_cut.withColumn("running", running).where("running - rest <= rest - (running - n_tokens)").select("doc_id", "source", "n_tokens", (F.col("whole") + 1).alias("repeats"))
    others = placed.where("interval is null or cut is null or interval <> cut").select("doc_id", "source", "n_tokens", (F.col("whole") + F.when(F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("interval") < F.col("cut"))), 1).otherwise(0)).alias("repeats"))
    passed = at_cut.select("doc_id", "source", "n_tokens", F.col("whole").alias("repeats")).join(chosen.select("doc_id", "source"), ["doc_id", "source"], "left_anti")
    return chosen.unionByName(others).unionByName(passed).where("repeats > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, drawn_tokens, drawn_records, actual_share`` of every target source; sources without documents have 0."""
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.sum("repeats").alias("drawn_records"))
    out = targets.select("source", "target_share").join(got, "source", "left").na.fill(0, ["drawn_tokens", "drawn_records"])
    return out.withColumn("actual_share", F.col("drawn_tokens") / F.sum("drawn_tokens").over(Window.partitionBy()))  # one row a target source
