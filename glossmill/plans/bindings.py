"""How the data tables stand for the operators' inputs where no table has the exact shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import pack
from glossmill.functions import text as X
from glossmill.operators import interpret, match
from glossmill.session import checkpointed, spread, table
from glossmill.sources.readers import cache_last_wins

PAGE_SOURCE = "Crawled pages"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages by slug, the last line's values in the place of the first."""
    return cache_last_wins(table(spark, d, "page_cache"), ["slug"]).withColumnRenamed("first_line", "line_no")


def books(spark: SparkSession, d: str) -> DataFrame:
    """One text an entry of the lexicon: a preface, then each meaning under the term as a heading."""
    t = table(spark, d, "dream_terms").where("term is not null and meanings is not null")
    body = F.array_join(F.transform("meanings", lambda m: F.concat(F.lit("_"), F.col("term"), F.lit("_.\n"), F.coalesce(m["text"], F.lit("")))), "\n")
    return t.select("entry_id", F.concat(F.lit("Preface\n*** START ***\nfront matter\n"), body, F.lit("\n*** END ***\nback matter")).alias("text"))


def html(spark: SparkSession, d: str) -> DataFrame:
    """Crawled pages as they might have been served: the alias as heading, the meaning as one paragraph a sentence pair."""
    p = table(spark, d, "page_cache").where("slug is not null")
    text = F.coalesce("meaning", F.lit(""))
    return p.select("line_no", "slug", F.concat(F.lit("<html><h1 class='t'>"), F.coalesce("alias", F.lit("")), F.lit("</h1><p>Dini: "), text, F.lit("</p><p><b>"), text, F.lit("</b></p><p>x</p></html>")).alias("html"))


def index(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """An index of the cache's lines: the first clause of a translation as term, the source text, ``whole`` or its first 48 characters, as original."""
    c = table(spark, d, "translation_cache").where("v is not null and v <> ''")
    tone = X.tone(F.col("v"), F.col("text"), pack.TONE_GOOD, pack.TONE_ILL)
    text = F.coalesce("text", F.lit(""))
    orig = text if whole else F.substring(text, 1, 48)
    return c.select(F.col("line_no").alias("row_no"), F.substring_index("v", "、", 1).alias("term"), orig.alias("orig"), tone.alias("tone"), "v")


def diaries(spark: SparkSession, d: str) -> DataFrame:
    """Texts to be read: every entry with a meaning, whatever its label says."""
    return spread(table(spark, d, "raw_entries").where("meaning is not null").select("ord", F.col("meaning").alias("text")))


def apart(spark: SparkSession, d: str) -> bool:
    """No two texts have one number."""
    return table(spark, d, "raw_entries").where("meaning is not null").groupBy("ord").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def matched(spark: SparkSession, d: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Contexts and features of the two bindings above."""
    return match.contexts(diaries(spark, d), "ord"), checkpointed(match.lexicon_features(index(spark, d, whole)))


def sent(lines: DataFrame) -> DataFrame:
    """``lines`` of the index to be joined to matches: sent to all tasks up to a counted number."""
    return F.broadcast(lines) if lines.count() <= match.LINES else lines


def items(spark: SparkSession, d: str) -> DataFrame:
    """The first matches of each text with tone and meaning: ``ord, place, row_no, term, tone, meanings``."""
    ctx, features = matched(spark, d)
    top = match.topk_of_texts(ctx, features, "ord", apart(spark, d))
    lines = features.select("row_no", "term", "tone", F.array("v").alias("meanings"))
    return top.join(sent(lines), "row_no").select("ord", "place", "row_no", "term", "tone", "meanings")


def pooled(spark: SparkSession, d: str) -> DataFrame:
    """The items that readings are made of, without meanings: ``ord, place, row_no, term, tone, pool_place``."""
    ctx, features = matched(spark, d)
    lines = features.select("row_no", "term", "tone")
    one = apart(spark, d)
    if one and (top := match.pool_of_texts(ctx, features.where("row_no is not null"), "ord")) is not None:
        return top.join(sent(lines), "row_no").select("ord", "place", "row_no", "term", "tone", "pool_place")
    return interpret.reading_pool(match.topk_of_texts(ctx, features, "ord", one).join(sent(lines), "row_no").select("ord", "place", "row_no", "term", "tone"), "ord")


def pool(spark: SparkSession, d: str) -> DataFrame:
    """``pooled`` with meanings. Kept without them, since they are far wider and join where they are read."""
    return checkpointed(pooled(spark, d)).join(sent(index(spark, d).select("row_no", F.array("v").alias("meanings"))), "row_no")


def lexicon_of_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache's source texts as a lexicon that the cache translates: each text a term, the next line's text its meaning."""
    c = table(spark, d, "translation_cache")
    last = cache_last_wins(c, ["lang", "text"]).select(F.col("first_line").alias("line_no"), "lang", "text")
    after = c.select((F.col("line_no") - 1).alias("line_no"), F.col("text").alias("next"))

    def source(name: Column) -> Column:
        return F.struct(name.alias("name"), F.lit("https://cache.example").alias("url"), F.lit(None).cast("string").alias("license_note"))

    b = last.join(after, "line_no", "left")
    return b.select(
        F.col("line_no").alias("entry_id"), F.col("text").alias("term"), X.casefold(X.clean_text(F.col("text"))).alias("term_normalized"), F.col("lang").alias("language"),
        F.array(F.struct(F.coalesce("next", "text").alias("text"))).alias("meanings"),
        F.array(source(F.concat(F.lit("part "), (F.col("line_no") % 5).cast("string"))), source(F.lit("cache"))).alias("sources"),
    )
