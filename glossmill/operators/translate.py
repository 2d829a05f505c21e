"""What is to be translated, what is already, and in which batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as X
from glossmill.sources.readers import cache_last_wins

LANGUAGES = ("en", "tr", "zh-Hant", "my")


def translation_items(terms: DataFrame, languages: Sequence[str] = LANGUAGES, only: str | None = None, most: int = 2) -> DataFrame:
    """Distinct (``lang``, ``text``) with their first place (``entry_id``, ``slot``: 0 the term, then the meanings).

    Of each entry the term and the first ``most`` meanings count; a meaning equal to its term does not. ``only`` is
    'terms', 'meanings' or None for both.
    """
    t = terms.where(F.col("language").isin(list(languages)))
    parts = []
    if only in (None, "terms"):
        parts.append(t.select(F.col("language").alias("lang"), "entry_id", F.lit(0).alias("slot"), X.clean_text(F.col("term")).alias("text")))
    if only in (None, "meanings"):
        m = t.select(F.col("language").alias("lang"), "entry_id", X.clean_text(F.col("term")).alias("own"), F.posexplode(F.slice("meanings", 1, most)).alias("k", "m"))
        parts.append(m.select("lang", "entry_id", (F.col("k") + 1).alias("slot"), X.source_text(F.col("lang"), F.col("m.text")).alias("text"), "own").where("text <> own").drop("own"))
    all_ = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    first = all_.where("text <> ''").groupBy("lang", "text").agg(F.min(F.struct("entry_id", "slot")).alias("f"))
    return first.select("lang", "text", "f.entry_id", "f.slot")


def translation_todo(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items that the cache has no line for, whatever the line says."""
    return items.join(cache.select("lang", "text").distinct(), ["lang", "text"], "left_anti")


def translate_lookup(df: DataFrame, cache: DataFrame, lang: str, text: str, out: str) -> DataFrame:
    """``df`` with the cache's last value for (lang, text), null where there is none."""
    last = cache_last_wins(cache.select("lang", "text", "v", "line_no"), ["lang", "text"])
    return df.join(last.select(F.col("lang").alias(lang), F.col("text").alias(text), F.col("v").alias(out)), [lang, text], "left")


def batch_fill(items: DataFrame, max_chars: int = 3600, max_items: int = 48, block: int = 50_000) -> DataFrame:
    """``lang, entry_id, slot, block, batch``: items filled into batches in order, per language.

    A batch closes before an item that would exceed ``max_chars`` (each item counts its length and one) or when it has
    ``max_items``. Filling is sequential, so languages are cut into blocks of ``block`` entry numbers that are filled side by
    side; a batch never crosses a block.
    """
    sized = items.select("lang", "entry_id", "slot", F.length("text").alias("n"), F.floor(F.col("entry_id") / block).alias("block"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_id", "slot"])
        batch, held, count, out = 0, 0, 0, []
        for n in pdf["n"]:
            if count and (held + n > max_chars or count >= max_items):
                batch, held, count = batch + 1, 0, 0
            held += n + 1
            count += 1
            out.append(batch)
        return pdf.assign(batch=out)[["lang", "entry_id", "slot", "block", "batch"]]

    return sized.groupBy("lang", "block").applyInPandas(fill, "lang string, entry_id bigint, slot int, block bigint, batch int")


def fingerprint(*parts: Column, digits: int = 10) -> Column:
    """A short content id."""
    return F.substring(F.sha1(F.to_json(F.struct(*parts))), 1, digits)


def translate_batches(
    items: DataFrame, call: Callable[[str, list[str]], list[str]], max_chars: int = 3600, max_items: int = 48,
    tries: int = 6, wait: float = 0.1, failures: tuple[type[Exception], ...] = (OSError, ValueError),
) -> DataFrame:
    """``lang, text, v, failed``: items sent through ``call(lang, texts)`` batch by batch, on the executors.

    A call that raises one of ``failures`` is repeated up to ``tries`` times, with waits that double from ``wait`` seconds;
    other errors end the job. An answer with another number of lines than the batch is not trusted. Items of a batch that
    fails either way are sent one by one; what fails then is null and marked ``failed``.
    """
    placed = batch_fill(items, max_chars, max_items)
    rows = items.join(placed, ["lang", "entry_id", "slot"]).select("lang", "block", "batch", "entry_id", "slot", "text")

    def asked(lang: str, texts: list[str]) -> list[str] | None:
        for n in range(tries):
            try:
                got = list(call(lang, texts))
                return got if len(got) == len(texts) else None
            except failures:
                time.sleep(wait * 2**n if n < tries - 1 else 0)
        return None

    def told(lang: str, texts: list[str]) -> list[tuple[str | None, bool]]:
        got = asked(lang, texts)
        if got is not None:
            return [(v, False) for v in got]
        return [(None, True)] if len(texts) == 1 else [told(lang, [t])[0] for t in texts]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_id", "slot"])
        answers = told(pdf["lang"].iloc[0], list(pdf["text"]))
        return pd.DataFrame({"lang": pdf["lang"], "text": pdf["text"], "v": [v for v, _ in answers], "failed": [f for _, f in answers]})

    return rows.groupBy("lang", "block", "batch").applyInPandas(run, "lang string, text string, v string, failed boolean")
