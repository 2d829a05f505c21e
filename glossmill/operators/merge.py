"""Consolidation of entries into a lexicon, and the lexicon's counts.

Entries carry ``ord``, their arrival order, because order decides: the first row of a key gives its display term and
language, the first of equal meanings gives its text. Results are flat tables keyed by ``term_normalized`` and ordered by
``ord``; nothing collects a key's rows, so that one key may hold any share of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions import text as X


def union_sources(*sources: DataFrame) -> DataFrame:
    """All entries in the given order of sources: ``rank`` then ``ord`` is the arrival order."""
    out = None
    for k, s in enumerate(sources):
        one = s.withColumn("rank", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def keyed(entries: DataFrame) -> DataFrame:
    """Entries that count, with ``term`` cleaned and ``key``: no empty terms or meanings, no English terms of one character."""
    e = entries.withColumn("term", X.clean_text(F.col("term"))).where(F.col("term") != "").where(F.col("meaning").rlike(f"[^{X.WS}]"))
    e = e.where(~((F.coalesce("language", F.lit("")) == "en") & (F.length("term") == 1)))
    return e.withColumn("key", X.casefold(F.col("term"))).withColumn("mkey", F.md5(X.meaning_key(F.col("meaning"))))


def merge_lexicon(entries: DataFrame) -> DataFrame:
    """One row a key: ``term_normalized, term, language, meaning_count, source_count, first_ord``.

    Nulls: a null language stays null, a null source name or address counts as a value. Ties in ``ord`` go to the smaller term.
    """
    k = keyed(entries)
    first = F.min(F.struct("ord", "term", "language")).alias("f")
    source = F.struct(F.coalesce("source.name", F.lit("\u0000")), F.coalesce("source.url", F.lit("\u0000")))
    out = k.groupBy("key").agg(first, F.count_distinct("mkey").alias("meaning_count"), F.count_distinct(source).alias("source_count"))
    return out.select(F.col("key").alias("term_normalized"), "f.term", "f.language", "meaning_count", "source_count", F.col("f.ord").alias("first_ord"))


def merge_meanings(entries: DataFrame) -> DataFrame:
    """First occurrence of each meaning of a key: ``term_normalized, ord, text, source_name``; ``ord`` orders them."""
    k = keyed(entries)
    won = k.groupBy("key", "mkey").agg(F.min(F.struct("ord", F.col("meaning").alias("text"), F.col("source.name").alias("source_name"), F.col("source.url").alias("source_url"), F.col("source.license_note").alias("license_note"))).alias("w"))
    return won.select(F.col("key").alias("term_normalized"), "w.*")


def merge_sources(entries: DataFrame) -> DataFrame:
    """First occurrence of each (name, address) of a key, also of entries whose meaning was a repeat."""
    k = keyed(entries).select("key", "ord", "source.name", "source.url", "source.license_note")
    won = k.groupBy("key", "name", "url").agg(F.min(F.struct("ord", "license_note")).alias("w"))
    return won.select(F.col("key").alias("term_normalized"), "w.ord", "name", "url", "w.license_note")


def merge_aliases(entries: DataFrame) -> DataFrame:
    """Distinct aliases of a key with ``sort_key``, their casefold, by which they are listed."""
    k = keyed(entries).select("key", F.explode("aliases").alias("alias")).where("alias is not null").distinct()
    return k.select(F.col("key").alias("term_normalized"), "alias", X.casefold(F.col("alias")).alias("sort_key"))


def nest(lexicon: DataFrame, meanings: DataFrame, sources: DataFrame, aliases: DataFrame, most: int = 10_000) -> DataFrame:
    """Entries with nested lists, for export. A key with more than ``most`` meanings has a row for each run of ``most`` arrival
    numbers that holds some, told apart and ordered by ``part``; other keys have part 0 alone. Sources and aliases stand in part 0."""
    heads = lexicon.select("term_normalized", "first_ord", (F.col("meaning_count") > most).alias("wide"))
    run = F.floor(F.col("ord") / most) - F.floor(F.col("first_ord") / most)
    placed = meanings.join(heads, "term_normalized").withColumn("part", F.when(F.col("wide"), run).otherwise(0).cast("bigint"))
    fields = lambda df, *c: F.transform(F.array_sort(F.collect_list(F.struct("ord", *c))), lambda x: F.struct(*[x[n].alias(n) for n in c]))
    m = placed.groupBy("term_normalized", "part").agg(fields(placed, "text", "source_name", "source_url", "license_note").alias("meanings"))
    s = sources.groupBy("term_normalized").agg(fields(sources, "name", "url", "license_note").alias("sources")).withColumn("part", F.lit(0).cast("bigint"))
    a = aliases.groupBy("term_normalized").agg(F.transform(F.array_sort(F.collect_set(F.struct("sort_key", "alias"))), lambda x: x["alias"]).alias("aliases")).withColumn("part", F.lit(0).cast("bigint"))
    return lexicon.join(m, "term_normalized").join(s, ["term_normalized", "part"], "left").join(a, ["term_normalized", "part"], "left")


def pages_as_entries(pages: DataFrame, source_name: str, source_url: str, license_note: str, language: str = "tr") -> DataFrame:
    """Crawled pages in the shape of entries; ``line_no`` is their order."""
    source = F.struct(F.lit(source_name).alias("name"), F.lit(None).cast("string").alias("author"), F.lit(source_url).alias("url"), F.lit(license_note).alias("license_note"))
    alias = F.filter(F.array(F.trim("alias")), lambda a: a.isNotNull() & (a != ""))
    return pages.select(F.col("line_no").alias("ord"), "term", F.lit(language).alias("language"), X.strip(F.coalesce("meaning", F.lit(""))).alias("meaning"), alias.alias("aliases"), source.alias("source"))


def lexicon_upsert(terms: DataFrame, pages: DataFrame, source_name: str, language: str = "tr") -> DataFrame:
    """Pages added to a lexicon: ``term_normalized, term, language, meaning_count, source_count, is_new``.

    ``terms`` has E2's shape. Known keys keep their term and language; a page's meaning counts if the key has none equal to
    it; here sources differ by name alone. Repeated keys in ``terms`` are one entry, its smallest id first.
    """
    old = terms.where("term_normalized is not null")
    o = old.select(F.col("term_normalized").alias("key"), F.lit(0).alias("rank"), F.col("entry_id").alias("ord"), "term", "language")
    p = pages.withColumn("term", X.clean_text(F.col("term"))).withColumn("meaning", X.strip(F.coalesce("meaning", F.lit("")))).where("term <> '' and meaning <> ''")
    n = p.select(X.casefold(F.col("term")).alias("key"), F.lit(1).alias("rank"), F.col("line_no").alias("ord"), "term", F.lit(language).alias("language"))
    heads = o.unionByName(n).groupBy("key").agg(F.min(F.struct("rank", "ord", "term", "language")).alias("h"))
    om = old.select(F.col("term_normalized").alias("key"), F.explode("meanings").alias("m")).where("m.text is not null")
    facts = om.select("key", F.md5(X.meaning_key(F.col("m.text"))).alias("mkey"), F.lit(None).cast("string").alias("name"))
    facts = facts.unionByName(p.select(X.casefold(F.col("term")).alias("key"), F.md5(X.meaning_key(F.col("meaning"))).alias("mkey"), F.lit(source_name).alias("name")))
    os = old.select(F.col("term_normalized").alias("key"), F.explode("sources").alias("s")).select("key", F.lit(None).cast("string").alias("mkey"), F.col("s.name").alias("name"))
    counts = facts.unionByName(os).groupBy("key").agg(F.count_distinct("mkey").alias("meaning_count"), F.count_distinct("name").alias("source_count"))
    out = heads.join(counts, "key", "left").na.fill(0, ["meaning_count", "source_count"])
    return out.select(F.col("key").alias("term_normalized"), "h.term", "h.language", "meaning_count", "source_count", (F.col("h.rank") == 1).alias("is_new"))


def _usable_pages(pages: DataFrame) -> DataFrame:
    """``key, rank, ord, meaning, alias`` of the pages with a term and a meaning; rank 1 puts them behind a lexicon's entries."""
    p = pages.withColumn("term", X.clean_text(F.col("term"))).withColumn("meaning", X.strip(F.coalesce("meaning", F.lit("")))).where("term <> '' and meaning <> ''")
    return p.select(X.casefold(F.col("term")).alias("key"), F.lit(1).alias("rank"), F.col("line_no").alias("ord"), "meaning", X.strip(F.coalesce("alias", F.lit(""))).alias("alias"))


def upsert_meanings(terms: DataFrame, pages: DataFrame, source_name: str) -> DataFrame:
    """The meanings of a lexicon with pages added: ``term_normalized, is_new, ord, pos, text, source_name``.

    A key's meanings stand as they were (of equal ones the first); a page's follows if the key has none equal to it. Null texts have no row.
    """
    old = terms.where("term_normalized is not null").select(F.col("term_normalized").alias("key"), F.lit(0).alias("rank"), F.col("entry_id").alias("ord"), F.posexplode("meanings").alias("pos", "m"))
    o = old.select("key", "rank", "ord", "pos", F.col("m.text").alias("text"), F.col("m.source_name").alias("source_name")).where("text is not null")
    n = _usable_pages(pages).select("key", "rank", "ord", F.lit(0).alias("pos"), F.col("meaning").alias("text"), F.lit(source_name).alias("source_name"))
    first = o.unionByName(n).groupBy("key", F.md5(X.meaning_key(F.col("text"))).alias("mkey")).agg(F.min(F.struct("rank", "ord", "pos", "text", "source_name")).alias("f"))
    return first.select(F.col("key").alias("term_normalized"), (F.col("f.rank") == 1).alias("is_new"), "f.ord", "f.pos", "f.text", "f.source_name")


def upsert_sources(terms: DataFrame, pages: DataFrame, source_name: str, url: str) -> DataFrame:
    """The sources of a lexicon with pages added: ``term_normalized, name, url, is_new``, one a key and name, the first met."""
    old = terms.where("term_normalized is not null").select(F.col("term_normalized").alias("key"), F.lit(0).alias("rank"), F.col("entry_id").alias("ord"), F.posexplode("sources").alias("pos", "s"))
    o = old.select("key", "rank", "ord", "pos", F.col("s.name").alias("name"), F.col("s.url").alias("url")).where("name is not null")
    n = _usable_pages(pages).select("key", "rank", "ord", F.lit(0).alias("pos"), F.lit(source_name).alias("name"), F.lit(url).alias("url"))
    first = o.unionByName(n).groupBy("key", "name").agg(F.min(F.struct("rank", "ord", "pos", "url")).alias("f"))
    return first.select(F.col("key").alias("term_normalized"), "name", "f.url", (F.col("f.rank") == 1).alias("is_new"))


def upsert_aliases(terms: DataFrame, pages: DataFrame) -> DataFrame:
    """The aliases of a lexicon with pages added: ``term_normalized, alias, sort_key``, each once."""
    old = terms.where("term_normalized is not null").select(F.col("term_normalized").alias("key"), F.explode("aliases").alias("alias")).where("alias is not null")
    both = old.unionByName(_usable_pages(pages).where("alias <> ''").select("key", "alias")).distinct()
    return both.select(F.col("key").alias("term_normalized"), "alias", X.casefold(F.col("alias")).alias("sort_key"))


def language_counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("language").agg(F.count(F.lit(1)).alias("entries"))


def source_count(terms: DataFrame, name: Column | None = None) -> DataFrame:
    """How many different sources a lexicon names."""
    each = terms.select(F.explode("sources").alias("s"))
    return each.agg(F.count_distinct("s.name" if name is None else name).alias("source_count"))


def lexicon_summary(lexicon: DataFrame) -> DataFrame:
    """``entry_count``, ``language_count`` and ``meaning_total`` of a merged lexicon, in one row."""
    return lexicon.agg(F.count(F.lit(1)).alias("entry_count"), F.count_distinct("language").alias("language_count"), F.coalesce(F.sum("meaning_count"), F.lit(0)).alias("meaning_total"))


def row_count_guard(df: DataFrame, least: int = 100) -> DataFrame:
    """The number of rows; fails when there are fewer than ``least``."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return n.select(F.when(F.col("n_rows") >= least, F.col("n_rows")).otherwise(F.raise_error(F.lit(f"fewer than {least} rows")).cast("bigint")).alias("n_rows"))
