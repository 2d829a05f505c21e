"""Problem 6: records that are the same but for formatting.

A record's canonical form is case-folded (upper, then lower, so that dotless i and sharp s meet their capitals), without
white space and punctuation; a text wholly made of ``label: value`` fields gets its fields sorted. Canonical forms are
hashed to 128 bits and counted with map-side combining, so a hot record is one row a partition before any shuffle. A
third, independent hash of the form guards against collisions: forms that share 128 bits but not the guard stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.session import checkpointed

# ASCII symbols that count as punctuation though Unicode calls them symbols.
_ASCII_SYMBOLS = r"$+<=>^`|~"
_DROPPED = r"[\p{P}\p{Z}\s" + "".join("\\" + c for c in _ASCII_SYMBOLS) + r"]+"
_FIELD = r"(?s)^[^:：]+[:：]\s*\S.*"


def fold(text: Column) -> Column:
    """Case, white space and punctuation disregarded."""
    # Dropping stands between the two conversions because the optimizer would simplify lower(upper(x)), which differs.
    return F.replace(F.lower(F.regexp_replace(F.upper(text), _DROPPED, "")), F.lit("i̇"), F.lit("i"))


def canonical_text(text: Column) -> Column:
    """``fold`` of the text; of its sorted fields, each folded, where it is two or more ``label: value`` fields."""
    parts = F.filter(F.transform(F.split(text, r"[;|\r\n]+"), lambda p: F.trim(p)), lambda p: p != "")
    fielded = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(_FIELD))
    # The cheap test comes first: without a separator there are no two fields.
    maybe = text.rlike(r"[;|\r\n]") & text.rlike("[:：]")
    return F.when(maybe & fielded, F.concat_ws("\u0001", F.array_sort(F.transform(parts, fold)))).otherwise(fold(text))


def fingerprints(records: DataFrame, id_col: str, parts: list[Column]) -> DataFrame:
    """``id``, 128-bit hash (``h1``, ``h2``) and ``guard`` of each record; null parts count as empty."""
    form = F.concat_ws("\u0002", *[F.coalesce(p, F.lit("")) for p in parts])
    keyed = records.select(F.col(id_col).alias("id"), form.alias("form"))
    return keyed.select("id", F.xxhash64("form").alias("h1"), F.xxhash64(F.lit(1), "form").alias("h2"), F.hash("form", F.length("form")).alias("guard"))


def collapse(prints: DataFrame) -> DataFrame:
    """One row a distinct record: ``h1, h2, guard, keep_id`` (smallest id) and ``copies``.

    Ties and exact repeats count as copies; an empty input gives an empty table.
    """
    return prints.groupBy("h1", "h2", "guard").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def copy_links(prints: DataFrame) -> DataFrame:
    """(``keep_id``, ``copy_id``) for every record that has a smaller-numbered copy."""
    prints = checkpointed(prints)  # read twice below, and far smaller than the texts
    groups = collapse(prints).where("copies > 1").select("h1", "h2", "guard", "keep_id")
    return prints.join(groups, ["h1", "h2", "guard"]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def meaning_records(dream_terms: DataFrame) -> DataFrame:
    """Meanings with text as (``meaning_id``, ``term_normalized``, ``text``); null texts and null lists give no row."""
    m = dream_terms.select("term_normalized", F.explode("meanings").alias("m"))
    return m.select(F.col("m.meaning_id").alias("meaning_id"), "term_normalized", F.col("m.text").alias("text")).where("text is not null")


def meaning_fingerprints(dream_terms: DataFrame) -> DataFrame:
    return fingerprints(meaning_records(dream_terms), "meaning_id", [fold(F.col("term_normalized")), canonical_text(F.col("text"))])
