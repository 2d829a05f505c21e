"""Named queries over the data tables. Their SQL is in ``sql``; both give the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import text as X
from glossmill.operators import history, interpret, match, merge, search, senses, translate
from glossmill.plans import bindings as B
from glossmill.plans.sql import SQL
from glossmill.session import checkpointed, spread, table
from glossmill.sources import parsers, readers
from glossmill.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

__all__ = ["QUERIES", "SQL"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _raw(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "raw_entries"))


def _terms(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "dream_terms"))


def _cache(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "translation_cache")


# Consolidation


@query
def merge_lexicon(s, d):
    return merge.merge_lexicon(_raw(s, d))


@query
def merge_meanings(s, d):
    return merge.merge_meanings(_raw(s, d)).select("term_normalized", "ord", F.md5("text").alias("text_md5"), "source_name")


@query
def merge_sources(s, d):
    return merge.merge_sources(_raw(s, d))


@query
def merge_aliases(s, d):
    return merge.merge_aliases(_raw(s, d))


@query
def lexicon_upsert(s, d):
    return merge.lexicon_upsert(_terms(s, d), B.pages(s, d), B.PAGE_SOURCE)


@query
def upsert_meanings(s, d):
    return merge.upsert_meanings(_terms(s, d), B.pages(s, d), B.PAGE_SOURCE).select("term_normalized", "is_new", "ord", F.md5("text").alias("text_md5"), "source_name")


@query
def upsert_sources(s, d):
    return merge.upsert_sources(_terms(s, d), B.pages(s, d), B.PAGE_SOURCE, "https://pages.example")


@query
def upsert_aliases(s, d):
    return merge.upsert_aliases(_terms(s, d), B.pages(s, d))


@query
def lexicon_summary(s, d):
    return merge.lexicon_summary(merge.merge_lexicon(_raw(s, d)))


@query
def language_counts(s, d):
    return merge.language_counts(merge.merge_lexicon(_raw(s, d)))


@query
def source_count(s, d):
    return merge.source_count(_terms(s, d))


@query
def lang_explode_counts(s, d):
    return senses.lang_explode_counts(_terms(s, d).where("term_normalized is not null").groupBy("term_normalized").agg(F.collect_set("language").alias("langs")))


@query
def row_count_guard(s, d):
    return merge.row_count_guard(merge.merge_lexicon(_raw(s, d)))


@query
def union_sources(s, d):
    pages = merge.pages_as_entries(B.pages(s, d), B.PAGE_SOURCE, "https://pages.example", "none")
    columns = ["ord", "term", "language", "meaning", "aliases", "source"]
    u = merge.union_sources(_raw(s, d).select(*columns), pages.select(*columns))
    return u.groupBy("rank", F.col("source.name").alias("source_name")).agg(F.count(F.lit(1)).alias("entries"), F.min("ord").alias("first_ord"))


@query
def nested_lexicon(s, d):
    e = _raw(s, d)
    n = merge.nest(merge.merge_lexicon(e), merge.merge_meanings(e), merge.merge_sources(e), merge.merge_aliases(e))
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("bigint").alias(f"n_{c}")
    return n.groupBy("term_normalized").agg(size("meanings"), size("sources"), size("aliases"))


# Sources and parsers


@query
def required_fields(s, d):
    ok = (F.length(X.strip(F.coalesce("term", F.lit("")))) > 0) & (F.length(X.strip(F.coalesce("meaning", F.lit("")))) > 0)
    return _raw(s, d).groupBy(F.col("source.name").alias("source_name")).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query
def field_map(s, d):
    return parsers.field_map(_raw(s, d), ["ord"], "term", "meaning", "term_normalized").select("ord", "term", F.md5("meaning").alias("meaning_md5"))


@query
def nested_explode(s, d):
    return parsers.nested_phrases(_terms(s, d), ["entry_id"], "meanings", "text").select("entry_id", F.md5("meaning").alias("meaning_md5"))


@query
def first_sentence(s, d):
    return _raw(s, d).where("meaning is not null").select("ord", F.md5(parsers.first_sentence(F.col("meaning"))).alias("sentence_md5"))


@query
def symbol_first_wins(s, d):
    return parsers.symbol_rows(_raw(s, d), "ord", "aliases", "meaning").select("term_normalized", "ord", F.md5("meaning").alias("meaning_md5"))


@query
def qa_pairs(s, d):
    p = table(s, d, "page_cache").where("term is not null and meaning is not null")
    told = p.select("line_no", F.concat(F.lit("### Human: What does it mean if I dream about a "), "term", F.lit("?\n### Assistant: "), "meaning").alias("text"))
    return parsers.transcripts(told, ["line_no"]).select("line_no", "term", F.md5("meaning").alias("meaning_md5"))


@query
def regex_capture_or_default(s, d):
    p = table(s, d, "page_cache").select("line_no", F.concat("alias", F.when(F.col("line_no") % 3 > 0, " ne anlama gelir?").otherwise("?")).alias("q"), "meaning")
    return parsers.questions(p, ["line_no"], "q", "meaning").select("line_no", "term", F.size("aliases").cast("bigint").alias("n_aliases"))


@query
def alias_split(s, d):
    t = _raw(s, d).where("term is not null").select("ord", F.concat("term", F.lit(" and "), F.coalesce("source.name", F.lit("x"))).alias("t"))
    return t.select("ord", F.array_join(parsers.alias_split(F.col("t")), "|").alias("aliases"))


@query
def phrase_split(s, d):
    t = _raw(s, d).where("meaning is not null").select("ord", F.translate("meaning", "，。", "　　").alias("text"))
    return parsers.phrases(t, ["ord"]).select("ord", F.col("pos").cast("bigint").alias("pos"), "term")


@query
def page_extract(s, d):
    return parsers.pages(B.html(s, d).select(F.col("line_no").alias("slug"), "html")).select(F.col("slug").alias("line_no"), "term", "alias", F.md5("meaning").alias("meaning_md5"))


@query
def page_paragraphs(s, d):
    return B.html(s, d).select("line_no", F.size(parsers.page_paragraphs(F.col("html"))).cast("bigint").alias("paragraphs"))


@query
def sitemap_slugs(s, d):
    maps = table(s, d, "page_cache").select(F.concat(F.lit("<url><loc>https://pages.example/a/"), "slug", F.lit(".html</loc></url>")).alias("text"))
    return parsers.sitemap_slugs(maps)


@query
def crawl_todo(s, d):
    p = table(s, d, "page_cache").where("slug is not null")
    return p.select("slug").distinct().join(p.where("meaning is not null").select("slug"), "slug", "left_anti")


@query
def cache_last_wins(s, d):
    return readers.cache_last_wins(_cache(s, d), ["lang", "text"]).select("lang", F.md5("text").alias("text_md5"), "v", "first_line", "last_line")


@query
def page_last_wins(s, d):
    return B.pages(s, d).select("slug", "term", "line_no", "last_line")


@query
def marker_slice(s, d):
    return B.books(s, d).select("entry_id", F.md5(parsers.marker_slice(F.col("text"), "*** START ***", "*** END ***", "_")).alias("core_md5"))


@query
def heading_filter(s, d):
    lines = B.books(s, d).select("entry_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("entry_id").agg(F.count_if(parsers.is_heading(F.col("line"))).alias("headings"), F.count(F.lit(1)).alias("n_lines"))


@query
def heading_sections(s, d):
    core = B.books(s, d).select("entry_id", parsers.marker_slice(F.col("text"), "*** START ***", "*** END ***").alias("text"))
    return parsers.heading_sections(core, ["entry_id"]).select("entry_id", F.col("section").cast("bigint").alias("section"), "term", F.md5("meaning").alias("meaning_md5"))


@query
def pattern_pairs(s, d):
    t = _terms(s, d).where("term is not null").select("entry_id", F.concat_ws("\n", F.transform("meanings", lambda m: F.concat(F.lit("_"), F.col("term"), F.lit("_--"), F.coalesce(m["text"], F.lit(""))))).alias("text"))
    return parsers.pattern_pairs(t, ["entry_id"], parsers.DASH_PAIRS).select("entry_id", "pos", "term", F.md5("meaning").alias("meaning_md5"))


# Translation


@query
def translation_items(s, d):
    return translate.translation_items(_terms(s, d)).select("lang", F.md5("text").alias("text_md5"), "entry_id", F.col("slot").cast("bigint").alias("slot"))


@query
def translation_todo(s, d):
    return translate.translation_todo(translate.translation_items(_terms(s, d)), _cache(s, d)).groupBy("lang").agg(F.count(F.lit(1)).alias("items"))


@query
def translate_lookup(s, d):
    named = _cache(s, d).select("line_no", "lang", "text")
    return translate.translate_lookup(named, _cache(s, d), "lang", "text", "told").select("line_no", "told")


@query
def batch_fill(s, d):
    return translate.batch_fill(translate.translation_items(_terms(s, d)))


# Senses and index


@query
def shortest_surface(s, d):
    return senses.shortest_surface(_raw(s, d), "term_normalized")


@query
def capped_meanings(s, d):
    m = _terms(s, d).select("term_normalized", F.explode("meanings").alias("m")).select("term_normalized", F.col("m.meaning_id").alias("meaning_id"), "m.text")
    return senses.capped_texts(m, ["term_normalized"], "meaning_id").select("term_normalized", F.col("place").cast("bigint").alias("place"), "meaning_id")


@query
def tone_score(s, d):
    return B.index(s, d).select("row_no", F.col("tone").cast("bigint").alias("tone"))


@query
def shard_assign(s, d):
    keys = _terms(s, d).where("term_normalized is not null").select(F.col("term_normalized").alias("key")).distinct()
    return senses.shard_assign(keys).select("key", "i", F.col("shard").cast("bigint").alias("shard"), F.col("idx").cast("bigint").alias("idx"))


@query
def shard_lookup(s, d):
    terms = _terms(s, d).where("term_normalized is not null")
    placed = checkpointed(senses.shard_assign(terms.select(F.col("term_normalized").alias("key")).distinct()))
    first = terms.groupBy(F.col("term_normalized").alias("key")).agg(F.min(F.struct("entry_id", "term", "meaning_count")).alias("f"))
    rows = placed.join(first, "key")
    index = rows.select(F.col("i").alias("row_no"), "key", "f.term", F.lit(0).alias("tone"), F.lit(None).cast("array<string>").alias("langs"), F.lit(None).cast("string").alias("orig"), "shard", "idx")
    payload = rows.select("shard", "idx", F.lit(1).alias("place"), F.col("key").alias("orig"), F.col("f.meaning_count").alias("tone"), F.array("f.term").alias("meanings"), F.lit(None).cast("array<string>").alias("sources"))
    found = interpret.shard_lookup(index.where("row_no % 50 = 0").select("row_no"), index, payload)
    sense = F.get("senses", 0)
    return found.select("row_no", F.col("shard").cast("bigint").alias("shard"), F.col("idx").cast("bigint").alias("idx"), "term", sense["orig"].alias("key"), sense["tone"].cast("bigint").alias("meaning_count"))


@query
def sense_merge(s, d):
    return senses.sense_merge(B.lexicon_of_cache(s, d), _cache(s, d)).select("key", "term", F.array_join("langs", ",").alias("langs"), "sense_no", "orig", F.array_join("meanings", "|").alias("meanings"), F.array_join("sources", "|").alias("sources"))


@query
def sense_order(s, d):
    return senses.sense_order(senses.with_tone(senses.sense_merge(B.lexicon_of_cache(s, d), _cache(s, d)))).select("key", "sense_no", "place", "tone")


@query
def build_index(s, d):
    return senses.build_index(B.lexicon_of_cache(s, d), _cache(s, d))[0].withColumn("langs", F.array_join("langs", ","))


@query
def build_fingerprint(s, d):
    lexicon = B.lexicon_of_cache(s, d)
    return senses.header(checkpointed(senses.build_index(lexicon, _cache(s, d))[0]), lexicon)


# Matching


@query
def lexicon_features(s, d):
    f = match.lexicon_features(B.index(s, d))
    return f.select("row_no", "phrase", *[F.array_join(c, "|").alias(c) for c in ("kanji", "other", "latin")])


@query
def keyword_classes(s, d):
    f = match.lexicon_features(B.index(s, d))
    return f.select("row_no", F.explode(F.concat("kanji", "other", "latin")).alias("kw")).groupBy("kw").agg(F.count(F.lit(1)).alias("uses"))


@query
def synonym_bridge(s, d):
    ctx = match.contexts(B.diaries(s, d), "ord")
    return ctx.select("ord", F.array_join("kanji_runs", "|").alias("runs"))


@query
def match_candidates(s, d):
    return match.match_candidates(*B.matched(s, d, whole=True), "ord")


@query
def match_topk(s, d):
    return match.topk_of_texts(*B.matched(s, d, whole=True), "ord", B.apart(s, d)).withColumn("place", F.col("place").cast("bigint"))


@query
def match_diverse(s, d):
    return match.diverse_of_texts(*B.matched(s, d), "ord", B.apart(s, d))


# Interpretation


@query
def pick_sense(s, d):
    index, payload = senses.build_index(B.lexicon_of_cache(s, d), _cache(s, d))
    index, one = checkpointed(index), B.apart(s, d)
    features, ctx = checkpointed(match.lexicon_features(index)), match.contexts(B.diaries(s, d), "ord")
    columns = "ord", "place", "row_no", "term", "tone", "orig", "meaning"
    if one:
        told = checkpointed(interpret.told_senses(index, payload))
        if (top := match.senses_of_texts(ctx, features, "ord", told.where("pick > 0"))) is not None:
            return top.join(B.sent(told.drop("hay", "o")), ["row_no", "pick"]).select(*columns)
    ctx = checkpointed(ctx)
    found = match.diverse_of_texts(ctx, features, "ord", one)
    picked = interpret.pick_sense(interpret.shard_lookup(found, index, payload), ctx, "ord")
    return picked.withColumn("meaning", F.get("meanings", 0)).select(*columns)


@query
def theme_scores(s, d):
    hits = interpret.theme_hits(B.items(s, d), "ord")
    return interpret.theme_scores(hits, "ord").select("ord", "theme", *[F.col(c).cast("bigint").alias(c) for c in ("score", "polarity", "first_place", "rank")])


@query
def pair_insight(s, d):
    return interpret.pair_insight(B.diaries(s, d), "ord", "text").withColumn("rule", F.col("rule").cast("bigint"))


@query
def reading_pool(s, d):
    return B.pooled(s, d).select("ord", "row_no", F.col("pool_place").cast("bigint").alias("pool_place"))


@query
def tone_mood(s, d):
    return interpret.tone_mood(B.pooled(s, d), "ord")


@query
def tone_digest(s, d):
    return interpret.tone_digest(B.items(s, d), "ord")


@query
def theme_quotes(s, d):
    hits = interpret.theme_hits(B.pool(s, d), "ord")
    return interpret.theme_quotes(hits, interpret.theme_scores(hits, "ord"), "ord")


@query
def reading_compose(s, d):
    texts = B.diaries(s, d)
    return interpret.reading_compose(texts, B.pool(s, d), match.contexts(texts, "ord"), "ord")


# Serving


@query
def dict_search(s, d):
    asked = B.index(s, d).where("row_no % 50 = 0").select(F.col("term").alias("query"))
    found = search.dict_search(asked, match.lexicon_features(B.index(s, d)))
    return found.select("query", "row_no", F.col("rank").cast("bigint").alias("rank"), F.col("place").cast("bigint").alias("place"))


@query
def stride_sample(s, d):
    f = match.lexicon_features(B.index(s, d))
    return search.stride_sample(checkpointed(f), start=5, stride=97)


@query
def history_latest60(s, d):
    kept = history.latest(table(s, d, "events"), "user_id", "ts", "event_id")
    return kept.select("user_id", "event_id", F.col("place").cast("bigint").alias("place"))


@query
def history_delete(s, d):
    return history.delete(table(s, d, "events"), "event_id", [1, 5, 50]).select("event_id", "user_id")


@query
def event_windows(s, d):
    w = ingest.windowed_counts(table(s, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
