"""Problem 2: lines that one source repeats in many of its texts.

The letters of a whole text (case, blanks, punctuation and digits left out) are cut by content: where a rolling hash over
four letters is smaller than at the ``REACH`` places before and after it. A line break hashes lowest of all, so it always
cuts, and with it the same line is cut the same way wherever it stands. A chunk counts together with the chunks beside it,
up to the line breaks, and with whether they reach those. Distinct texts are counted per source and chunk, for every chunk,
summed within a batch before any shuffle. Chunks that a source repeats to excess are cut out; a line goes if all of its
chunks do.

A line repeated to excess has only such chunks. The other way round: a line of up to three chunks is a chunk with its
neighbours, so its count is the chunk's; of a longer line every run of three chunks is repeated to excess by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import checkpointed, spread

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A cut is the least of so many places on either side; chunks have about twice as many letters.
REACH = 16
_SLICE = 2000
#: Excessive chunks are sent to the tasks up to this number; beyond it they are joined.
MAX_SENT = 2_000_000


def letters(text: Column) -> Column:
    """What a line is compared by; line breaks stay."""
    # Dropping stands between the two conversions because the optimizer would simplify lower(upper(x)), which differs.
    kept = F.regexp_replace(F.upper(text), r"[\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}\p{Nd}&&[^\n]]+", "")
    return F.replace(F.lower(kept), F.lit("i̇"), F.lit("i"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least_around(h: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` values before and after each (itself left out)."""
    far = np.full(reach, np.iinfo(np.uint64).max, np.uint64)
    run, width = np.concatenate([far, h, far]), 1
    while width < reach:  # run[i]: the least of width values from i on
        step = min(width, reach - width)
        run = np.minimum(run[:-step], run[step:])
        width += step
    return np.minimum(run[: len(h)], run[reach + 1 : reach + 1 + len(h)])


def chunk_keys(texts: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The non-blank lines of the texts (``doc``, ``line_no``), and for each chunk its line's row and its hash."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    breaks = np.flatnonzero(codes == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
    doc_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    doc = np.searchsorted(doc_end, breaks)
    first_line = np.searchsorted(doc, doc)
    full = breaks > begin
    lines = pd.DataFrame({"doc": doc[full], "line_no": (np.arange(len(breaks)) - first_line + 1)[full].astype(np.int32)})
    if not len(lines):
        return lines, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = _mixed(codes + np.uint64(0x1234567))
    h = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    if n > 3:
        whole = np.ones(n - 3, bool)
        for j in range(4):
            whole &= codes[j : n - 3 + j] != 10
        h[:-3][whole] = _mixed(c[:-3] + c[1:-2] * _BASE + c[2:-1] * _BASE * _BASE + c[3:] * _BASE * _BASE * _BASE)[whole]
    h[breaks] = 0
    cut = h < _least_around(h, REACH)
    cut[breaks] = False
    begin, end = begin[full], breaks[full]
    at = np.sort(np.concatenate([np.flatnonzero(cut), begin]))
    row = np.searchsorted(begin, at, "right") - 1
    # Of each chunk: where the chunk before it begins and the one after it ends, within the line.
    k = np.arange(len(at))
    first, last = np.searchsorted(row, row), np.searchsorted(row, row, "right") - 1
    a = at[np.maximum(k - 1, first)]
    b = np.where(k + 2 <= last, at[np.minimum(k + 2, len(at) - 1)], end[row])
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * powers[:-1])])
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
    edges = (a == begin[row]).astype(np.uint64) * np.uint64(2) + (b == end[row]).astype(np.uint64)
    return lines, row, _mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(4) + edges)


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), _SLICE):
            yield pdf.iloc[k : k + _SLICE]


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _sliced(batches):
        lines, rows, keys = chunk_keys(list(pdf["letters"]))
        doc = lines["doc"].to_numpy()[rows]
        once = pd.DataFrame({"doc": doc, "s": pdf["s"].to_numpy()[doc], "key": keys.view(np.int64)}).drop_duplicates()
        yield once.groupby(["s", "key"], sort=False).size().rename("n").reset_index()


def site_texts(dream_terms: DataFrame) -> DataFrame:
    """(``meaning_id``, ``source_name``, ``text``) of all meanings."""
    m = dream_terms.select(F.explode("meanings").alias("m"))
    return m.select("m.meaning_id", "m.source_name", "m.text")


def repeated_lines(texts: DataFrame, least: int = 5, share: float = 0.01) -> DataFrame:
    """(``meaning_id``, ``line_no``, ``source_name``): every occurrence of a line whose chunks all stand in at least ``least``
    and at least ``share`` of all texts of its source.

    Texts without a source or text have no lines (a null text counts as one of its source's texts); blank lines and lines
    without letters are no case. A repeated row counts as a text of its own. Empty tables give an empty result.
    """
    spark = texts.sparkSession
    totals = checkpointed(texts.where("source_name is not null").groupBy(F.xxhash64("source_name").alias("s")).agg(F.count(F.lit(1)).alias("total")))
    usable = texts.where("source_name is not null and text is not null")
    ready = spread(usable.select("meaning_id", "source_name", "text")).select("meaning_id", "source_name", F.xxhash64("source_name").alias("s"), letters(F.col("text")).alias("letters"))
    counts = ready.select("s", "letters").mapInPandas(_count_batches, "s bigint, key bigint, n bigint").groupBy("s", "key").agg(F.sum("n").alias("n"))
    excessive = checkpointed(counts.where(F.col("n") >= least).join(totals, "s").where(F.col("n") >= share * F.col("total")).select("s", "key"))
    sent = None
    if excessive.count() <= MAX_SENT:
        pairs = excessive.toPandas()
        mixed = np.unique(pairs["key"].to_numpy(np.int64) ^ (pairs["s"].to_numpy(np.int64) * 31))
        sent = spark.sparkContext.broadcast(mixed)

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _sliced(batches):
            lines, rows, keys = chunk_keys(list(pdf["letters"]))
            signed = keys.view(np.int64)
            if sent is None:
                out = lines.iloc[rows].assign(key=signed)
            else:
                with np.errstate(over="ignore"):
                    probe = signed ^ (pdf["s"].to_numpy()[lines["doc"].to_numpy()[rows]] * 31)
                known = sent.value
                place = np.minimum(np.searchsorted(known, probe), max(len(known) - 1, 0))
                hit = known[place] == probe if len(known) else np.zeros(len(probe), bool)
                good = np.ones(len(lines), bool)
                good[rows[~hit]] = False
                out = lines[good].assign(key=0)
            at = out["doc"].to_numpy()
            yield pd.DataFrame({"meaning_id": pdf["meaning_id"].to_numpy()[at], "source_name": pdf["source_name"].to_numpy()[at], "s": pdf["s"].to_numpy()[at], "line_no": out["line_no"], "key": out["key"]})

    lines = ready.mapInPandas(covered, "meaning_id bigint, source_name string, s bigint, line_no int, key bigint")
    if sent is None:
        judged = lines.join(excessive.withColumn("known", F.lit(1)), ["s", "key"], "left")
        lines = judged.groupBy("meaning_id", "source_name", "line_no").agg(F.count(F.lit(1)).alias("all"), F.count("known").alias("known")).where("all = known")
    return lines.select("meaning_id", "line_no", "source_name")


def without_repeated_lines(texts: DataFrame, least: int = 5, share: float = 0.01) -> DataFrame:
    """(``meaning_id``, ``source_name``, ``text``): every text without the lines that its source repeats to excess."""
    drop = repeated_lines(texts, least, share).groupBy("meaning_id").agg(F.collect_set("line_no").alias("drop"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, k: ~F.array_contains("drop", (k + 1).cast("int")))
    joined = texts.select("meaning_id", "source_name", "text").join(drop, "meaning_id", "left")
    return joined.select("meaning_id", "source_name", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
