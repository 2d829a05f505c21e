"""The target-language index: terms merged by translated key, their senses, tones, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import pack
from glossmill.functions import text as X
from glossmill.operators.translate import translate_lookup
from glossmill.session import checkpointed

MAX_SENSES, MAX_MEANINGS, MAX_SOURCES, PREFIX = 4, 3, 2, 36
TERM_LIMIT, ORIGINAL_LIMIT, SHARDS = 60, 48, 128


def translated_entries(terms: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries with a usable translated term: ``entry_id, ord, language, term, key, orig, okey, sources``."""
    t = terms.where("term_normalized is not null").select("entry_id", F.struct("term_normalized", "entry_id").alias("ord"), "language", X.clean_text(F.col("term")).alias("own"), F.col("sources"))
    t = translate_lookup(t, cache, "language", "own", "v")
    ja = t.withColumn("norm", X.normalize_key(X.clean_text(F.col("v")))).withColumn("term", X.strip(F.substring(X.clean_term(F.col("norm")), 1, TERM_LIMIT))).where("term <> ''")
    ja = ja.withColumn("key", X.merge_key(F.col("term"))).where("key <> ''")  # the term is in normal form already
    orig = F.substring("own", 1, ORIGINAL_LIMIT)
    return ja.select("entry_id", "ord", "language", "term", "key", orig.alias("orig"), X.normalize_key(orig).alias("okey"), "sources")


def translated_meanings(terms: DataFrame, entries: DataFrame, cache: DataFrame, most: int = 2) -> DataFrame:
    """``entry_id, pos, text``: the translated meanings of each entry; a long term stands in where there is none."""
    m = terms.select("entry_id", "language", X.clean_text(F.col("term")).alias("own"), F.posexplode(F.slice("meanings", 1, most)).alias("pos", "m"))
    m = m.select("entry_id", "language", "pos", "own", X.source_text(F.col("language"), F.col("m.text")).alias("source")).where("source <> '' and source <> own")
    told = translate_lookup(m, cache, "language", "source", "v").select("entry_id", "pos", X.clean_meaning(F.col("v")).alias("text")).where("text <> ''")
    alone = entries.where(F.length("term") >= 8).join(told.select("entry_id").distinct(), "entry_id", "left_anti").select("entry_id", F.lit(0).alias("pos"), F.col("term").alias("text"))
    return told.unionByName(alone)


def shortest_surface(entries: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """``key, term``: the shortest term of each key, the first of equals. Null keys and terms take no part."""
    told = entries.where(F.col(key).isNotNull() & F.col("term").isNotNull())
    return told.groupBy(key).agg(F.min(F.struct(F.length("term"), order, "term")).alias("m")).select(key, F.col("m.term").alias("term"))


def capped_texts(texts: DataFrame, key: list[str], order: str, most: int = MAX_MEANINGS) -> DataFrame:
    """``key, order, text, place`` (from 1): each key's first ``most`` texts that differ in their first ``PREFIX`` characters.

    Null keys and texts take no part."""
    told = texts.where(" and ".join(f"`{k}` is not null" for k in [*key, "text"]))
    first = told.groupBy(*key, F.substring("text", 1, PREFIX).alias("prefix")).agg(F.min(F.struct(order, "text")).alias("m"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(f"m.{order}")))
    return first.withColumn("place", place).where(F.col("place") <= most).select(*key, f"m.{order}", "m.text", "place")


def sense_merge(terms: DataFrame, cache: DataFrame) -> DataFrame:
    """One row a sense: ``key, term, langs, sense_no, orig, okey, meanings, sources``.

    Terms merge by key; the shortest surface shows (the first of equals), languages list in order. A key keeps its first 4
    senses; entries of later ones still count for surface and languages. A sense keeps its first 3 meanings that differ in
    their first 36 characters and the first 2 different names among each entry's first 2 sources.
    """
    entries = translated_entries(terms, cache)
    meanings = translated_meanings(terms, entries, cache)
    e = checkpointed(entries.join(meanings.select("entry_id").distinct(), "entry_id", "left_semi"))
    slots = shortest_surface(e, "key")
    langs = e.groupBy("key", "language").agg(F.min("ord").alias("ord")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "language"))).alias("l"))
    first = e.groupBy("key", "okey").agg(F.min(F.struct("ord", "orig")).alias("f"))
    number = F.row_number().over(Window.partitionBy("key").orderBy("f.ord"))
    senses = first.withColumn("sense_no", number).where(F.col("sense_no") <= MAX_SENSES).select("key", "okey", "sense_no", F.col("f.orig").alias("orig"))
    kept = e.join(senses.select("key", "okey"), ["key", "okey"], "left_semi")
    by_sense = Window.partitionBy("key", "okey").orderBy("at")
    texts = capped_texts(kept.join(meanings, "entry_id").select("key", "okey", F.struct("ord", "pos").alias("at"), "text"), ["key", "okey"], "at")
    texts = texts.groupBy("key", "okey").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("meanings"))
    names = kept.select("key", "okey", "ord", F.posexplode(F.slice("sources", 1, 2)).alias("pos", "s")).where("s.name is not null and s.name <> ''")
    names = names.groupBy("key", "okey", F.col("s.name").alias("name")).agg(F.min(F.struct("ord", "pos")).alias("at"))
    names = names.withColumn("n", F.row_number().over(by_sense)).where(F.col("n") <= MAX_SOURCES)
    names = names.groupBy("key", "okey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("sources"))
    out = senses.join(texts, ["key", "okey"]).join(names, ["key", "okey"], "left").join(slots, "key").join(langs, "key")
    return out.select("key", "term", F.transform("l", lambda x: x["language"]).alias("langs"), "sense_no", "orig", "okey", "meanings", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def with_tone(senses: DataFrame) -> DataFrame:
    return senses.withColumn("tone", X.tone(F.array_join("meanings", ""), F.col("orig"), pack.TONE_GOOD, pack.TONE_ILL))


def sense_order(senses: DataFrame) -> DataFrame:
    """Senses with ``place`` (from 1): those whose meanings hold a keyword of the shown term come first, else as they were."""
    stop = F.array(*[F.lit(x) for x in pack.ORDER_STOP])
    keywords = F.filter(X.runs(F.col("term"), X.RUNS_BUILD), lambda r: ~F.array_contains(stop, r))
    named = F.exists(keywords, lambda r: F.exists("meanings", lambda m: F.contains(m, r)))
    return senses.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.when(named, 0).otherwise(1), "sense_no")))


def global_index(df: DataFrame, key: str, out: str = "i") -> DataFrame:
    """``df`` with its 0-based rank by ``key`` (unique): range-partitioned sort, then an offset a partition. No single-task sort."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    ranged = checkpointed(df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = {r[0]: r[1] for r in ranged.groupBy(part).count().collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p).cast("bigint"), F.lit(before).cast("bigint")]
        before += counts[p]
    offset = F.create_map(*offsets)[part] if offsets else F.lit(0).cast("bigint")
    return ranged.withColumn(out, offset + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def shard_assign(keys: DataFrame, key: str = "key", shards: int = SHARDS) -> DataFrame:
    """``key, i, shard, idx``: equal key ranges and the place inside them."""
    indexed = global_index(keys.select(key), key)
    n = indexed.count()
    size = max(1, -(-n // shards))
    shard = F.least(F.floor(F.col("i") / size), F.lit(shards - 1)).cast("int")
    return indexed.select(key, "i", shard.alias("shard"), (F.col("i") - shard * size).cast("int").alias("idx"))


def build_index(terms: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows (``row_no, term, tone, langs, orig, shard, idx``) and payload (``shard, idx, place, orig, tone, meanings, sources``)."""
    senses = checkpointed(sense_order(with_tone(sense_merge(terms, cache))))
    head = senses.where("place = 1").select("key", "term", "tone", "langs", "orig")
    places = checkpointed(shard_assign(head))
    index = head.join(places, "key").select(F.col("i").alias("row_no"), "key", "term", "tone", "langs", "orig", "shard", "idx")
    payload = senses.join(places, "key").select("shard", "idx", "place", "orig", "tone", "meanings", "sources")
    return index, payload


def header(index: DataFrame, terms: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row: ``entry_count, source_entry_count, shard_count, build``. The build id hashes rows independently of their order."""
    rows = index.agg(F.count(F.lit(1)).alias("entry_count"), F.bit_xor(F.xxhash64("key", "term", "tone", "orig", "shard", "idx")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "key", "term"), F.lit(1 << 40))).alias("s"))
    total = terms.agg(F.count(F.lit(1)).alias("source_entry_count"))
    return rows.crossJoin(total).select("entry_count", "source_entry_count", F.lit(shards).alias("shard_count"), F.substring(F.sha1(F.concat_ws("-", "x", "s")), 1, 10).alias("build"))  # one row each


def lang_explode_counts(index: DataFrame) -> DataFrame:
    return index.select(F.explode("langs").alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("entries"))
