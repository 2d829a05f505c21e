"""From matches to a reading: payload lookup, sense choice, themes, pairs, mood, quotes, prose."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import pack
from glossmill.functions import text as X


def shard_lookup(matches: DataFrame, index: DataFrame, payload: DataFrame) -> DataFrame:
    """Matches with their index row and the payload's senses in order (null where a shard is missing)."""
    rows = matches.join(index.select("row_no", F.col("term"), F.col("tone").alias("row_tone"), "langs", F.col("orig").alias("row_orig"), "shard", "idx"), "row_no")
    packed = payload.groupBy("shard", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "orig", "tone", "meanings", "sources"))).alias("senses"))  # at most 4 a row
    return rows.join(packed, ["shard", "idx"], "left")


def told_senses(index: DataFrame, payload: DataFrame) -> DataFrame:
    """``row_no, pick, term, tone, orig, meaning, hay, o`` of each line's senses: ``pick`` is the place of one of several (with what choosing among them reads in ``hay`` and ``o``) or 0 for a lone
    one and for a line without any, whose own tone and original stand."""
    several = F.count("place").over(Window.partitionBy("row_no")) > 1
    rows = index.select("row_no", "term", F.col("tone").alias("row_tone"), F.col("orig").alias("row_orig"), "shard", "idx")
    s = rows.join(payload.select("shard", "idx", "place", "tone", "orig", "meanings"), ["shard", "idx"], "left").withColumn("several", several)
    told = s.select(
        "row_no", F.when(F.col("several"), F.col("place")).otherwise(0).cast("int").alias("pick"), "term", F.coalesce("tone", "row_tone").alias("tone"),
        F.coalesce("orig", "row_orig").alias("orig"), F.get("meanings", F.lit(0)).alias("meaning"), F.array_join("meanings", "").alias("whole"), F.col("orig").alias("own"),
    )
    return told.withColumn("hay", X.fold_kana(X.normalize_key(F.col("whole")))).withColumn("o", X.normalize_key(F.col("own"))).drop("whole", "own")


def pick_sense(attached: DataFrame, ctx: DataFrame, key: str) -> DataFrame:
    """``attached`` with ``sense``: the one whose wording shares most with the text, the first of equals; a lone one as it is.

    Without senses the row's own tone and original stand, with no meanings.
    """
    c = ctx.select(key, "kanji_runs", "other_set", "latin_set")
    j = attached.join(c, key)
    stop, stop_latin = (F.array(*[F.lit(x) for x in xs]) for xs in (pack.MATCH_STOP, pack.MATCH_STOP_LATIN))
    # Normal forms are made before the sense is scored, since they may leave the JVM.
    s = j.select(key, "row_no", F.explode("senses").alias("s"), "kanji_runs", "other_set", "latin_set")
    s = s.withColumn("hay", X.fold_kana(X.normalize_key(F.array_join("s.meanings", "")))).withColumn("o", X.normalize_key(F.col("s.orig")))
    add = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0), lambda a, x: a + x)
    score = (
        add("kanji_runs", lambda r: F.when(~F.array_contains(stop, r) & F.contains("hay", r), F.length(r) * F.length(r)).otherwise(0))
        + add("other_set", lambda k: F.when((F.length(k) >= 2) & F.contains("hay", k), F.length(k)).otherwise(0))
        + add("latin_set", lambda k: F.when((F.length(k) >= 3) & ~F.array_contains(stop_latin, k) & F.contains("o", k), F.length(k) * 2).otherwise(0))
    )
    best = s.withColumn("score", score).groupBy(key, "row_no").agg(F.max_by("s", F.struct("score", -F.col("s.place"))).alias("sense"))
    out = attached.drop("senses").join(best, [key, "row_no"], "left")
    return out.select(
        "*", F.coalesce("sense.tone", "row_tone").alias("tone"), F.coalesce("sense.orig", "row_orig").alias("orig"),
        F.coalesce("sense.meanings", F.array().cast("array<string>")).alias("meanings"), F.coalesce("sense.sources", F.array().cast("array<string>")).alias("sources"),
    ).drop("sense", "row_tone", "row_orig")


def _count_words(x: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(x, F.lit(w)).cast("int") for w in words), F.lit(0))


def theme_hits(items: DataFrame, key: str) -> DataFrame:
    """``key, theme, theme_no, place, row_no, term, tone, polarity, hits`` for every item and theme with a hit."""
    i = items.withColumn("text", F.array_join("meanings", "")).where("text <> ''")
    by_words = F.signum(_count_words(F.col("text"), pack.READING_GOOD) - _count_words(F.col("text"), pack.READING_ILL)).cast("int")
    i = i.withColumn("polarity", F.when(F.col("tone") != 0, F.col("tone").cast("int")).otherwise(by_words))
    hits = F.array(*[F.struct(F.lit(t).alias("theme"), F.lit(n).alias("theme_no"), _count_words(F.col("text"), ws).alias("hits")) for n, (t, ws) in enumerate(pack.THEMES.items())])
    e = i.withColumn("h", F.explode(hits)).where("h.hits > 0")
    return e.select(key, "h.theme", "h.theme_no", "place", "row_no", "term", "tone", "polarity", "meanings", "h.hits")


def theme_scores(hits: DataFrame, key: str) -> DataFrame:
    """``key, theme, score, polarity, symbols, first_place, rank``: themes by score, the first met of equals first."""
    g = hits.groupBy(key, "theme", "theme_no").agg(
        F.sum("hits").alias("score"), F.sum(F.col("polarity") * F.col("hits")).alias("polarity"), F.min("place").alias("first_place"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])).alias("symbols"),
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "first_place", "theme_no"))
    return g.withColumn("rank", rank)


def pair_insight(texts: DataFrame, key: str, hay: str) -> DataFrame:
    """``key, rule``: the first rule (from 1) of which both groups occur; 0 where none does."""
    any_of = lambda ws: F.col(hay).rlike("|".join(ws))
    rule = F.coalesce(*[F.when(any_of(a) & any_of(b), F.lit(n)) for n, (a, b) in enumerate(pack.PAIR_RULES, 1)], F.lit(0))
    return texts.select(key, rule.alias("rule"))


def reading_pool(items: DataFrame, key: str, most: int = 6, longest: int = 14, enough: int = 3) -> DataFrame:
    """The items that a reading is made of: the first ``most`` with short terms, or of all where fewer than ``enough`` are short."""
    w = Window.partitionBy(key)
    short = F.length("term") <= longest
    n = items.withColumn("n_short", F.sum(short.cast("int")).over(w)).where((F.col("n_short") < enough) | short)
    return n.withColumn("pool_place", F.row_number().over(w.orderBy("place"))).where(F.col("pool_place") <= most).drop("n_short")


def tone_mood(items: DataFrame, key: str) -> DataFrame:
    """``key, good, ill, mood``: pos, neg, mixed or neutral."""
    g = items.groupBy(key).agg(F.count_if(F.col("tone") == 1).alias("good"), F.count_if(F.col("tone") == -1).alias("ill"))
    mood = F.when((F.col("good") > 0) & (F.col("ill") > 0), "mixed").when(F.col("good") > 0, "pos").when(F.col("ill") > 0, "neg").otherwise("neutral")
    return g.withColumn("mood", mood)


def tone_digest(items: DataFrame, key: str) -> DataFrame:
    """``key, digest``: counts of good and ill items as a label."""
    g = items.groupBy(key).agg(F.count_if(F.col("tone") == 1).alias("good"), F.count_if(F.col("tone") == -1).alias("ill"))
    label = F.concat_ws(" / ", F.when(F.col("good") > 0, F.concat(F.lit("吉"), F.col("good"))), F.when(F.col("ill") > 0, F.concat(F.lit("注意"), F.col("ill"))))
    return g.select(key, F.when(label == "", "中").otherwise(label).alias("digest"))


def _main_tone(polarity: Column) -> Column:
    return F.signum(polarity).cast("int")


def theme_quotes(hits: DataFrame, scores: DataFrame, key: str, themes: int = 3, most: int = 2) -> DataFrame:
    """``key, theme, rank, place, term, quote, kind``: the quotes of a text's first themes.

    Within a theme items of its own tone come first, then those with more hits. A quote (kind 'quote', at most ``most`` a
    theme) needs a short term, an essence that does not speak against the theme's tone, and an item not quoted before. A
    theme without quotes takes one item's summary ('summary'); a theme with a tone also one opposing voice ('counter'). Items
    and themes of one text (at most 6 and 3) are walked in order, as a stream sorted by text.
    """
    first = X.essence(F.get("meanings", 0))
    top = scores.where(F.col("rank") <= themes).select(key, "theme", "rank", _main_tone(F.col("polarity")).alias("main"))
    h = hits.join(top, [key, "theme"]).withColumn("essence", first).withColumn("summary", X.summarize(F.get("meanings", 0), 80))
    side = F.when(F.col("main") == 0, 0).when(F.col("tone") == F.col("main"), 1).when(F.col("tone") == 0, 0).otherwise(-1)
    speaks = F.least(_count_words(F.col("essence"), pack.READING_GOOD), F.lit(1)) - F.least(_count_words(F.col("essence"), pack.READING_ILL), F.lit(1))
    fit = (F.length("term") <= 12) & ~F.col("term").rlike("(ください|します|ました|ます|です)")
    rows = h.select(key, "theme", "rank", "place", "row_no", "term", F.col("tone").cast("int").alias("tone"), "main", "hits", "essence", "summary", side.alias("side"), speaks.alias("speaks"), fit.alias("fit"))
    rows = rows.repartition(key).sortWithinPartitions(key, "rank", F.desc("side"), F.desc("hits"), "place")

    def of_text(rows: list) -> list[tuple]:
        out, used = [], set()
        for rank in sorted({r.rank for r in rows}):
            own, got = [r for r in rows if r.rank == rank], 0
            main = own[0].main
            for r in own:
                if got < most and r.fit and r.row_no not in used and r.essence and not (main and r.speaks == -main):
                    used.add(r.row_no)
                    out.append((*r[:2], r.rank, r.place, r.term, r.essence, "quote"))
                    got += 1
            if not got:
                source = next((r for r in own if r.fit and r.row_no not in used), None)
                if source is not None and source.summary:
                    used.add(source.row_no)
                    out.append((*source[:2], rank, source.place, source.term, source.summary, "summary"))
            if main:
                other = next((r for r in own if r.tone == -main and r.row_no not in used and r.fit), None)
                if other is not None and other.essence:
                    used.add(other.row_no)
                    out.append((*other[:2], rank, other.place, other.term, other.essence, "counter"))
        return out

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held = [key, "theme", "rank", "place", "term", "quote", "kind"], []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name="R"):
                if held and held[0][0] != r[0]:
                    out += of_text(held)
                    held = []
                held.append(r)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(of_text(held) if held else [], columns=columns)

    return rows.mapInPandas(walk, f"{key} bigint, theme string, rank int, place int, term string, quote string, kind string")


def reading_compose(texts: DataFrame, pool: DataFrame, ctx: DataFrame, key: str, text: str = "text", wording: pack.Wording | None = None) -> DataFrame:
    """``key, reading``: the composed prose, its parts parted by empty lines. Texts without matches get the fixed answer."""
    say = wording or pack.Wording()

    def fill(template: str, **values: Column) -> Column:
        out = F.lit(template)
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
        return out

    hits = theme_hits(pool, key)
    scores = theme_scores(hits, key)
    quotes = theme_quotes(hits, scores, key)
    said = quotes.groupBy(key, "theme").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "counter", 1).otherwise(0).alias("late"), "place", "term", "quote"))), lambda q: fill(say.quote, term=q["term"], essence=q["quote"])), "").alias("body"))
    tone = _main_tone(F.col("polarity"))
    advice = F.when(tone == 1, say.advice[1]).when(tone == -1, say.advice[-1]).otherwise(say.advice[0])
    short = F.slice(F.transform(F.array_sort(F.transform(F.filter("symbols", lambda s: F.length(s) <= 10), lambda s, k: F.struct(F.length(s).alias("n"), k.alias("k"), s.alias("s")))), lambda x: x["s"]), 1, 2)
    lines = scores.where("rank <= 3").join(said, [key, "theme"], "left")
    lines = lines.select(key, "rank", "theme", fill(say.theme, theme=F.col("theme"), symbols=F.array_join(short, "・"), body=F.col("body"), advice=advice).alias("line"))
    themes = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("themes"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "theme"))), 1, 2), lambda x: x["theme"]), " + ").alias("nouns"))
    # Only the first three meanings are read; the others are not moved.
    firsts = F.collect_list(F.when(F.col("pool_place") <= 3, F.struct("place", F.get("meanings", 0).alias("m"))))
    tops = pool.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"), F.array_sort(firsts).alias("m"))
    listed = lambda c, n, f: F.transform(F.slice(c, 1, n), lambda x: x[f])
    tops = tops.select(key, listed("t", 3, "term").alias("top"), listed("t", 6, "term").alias("all"), listed("m", 3, "m").alias("firsts"))
    j = texts.select(key, F.col(text).alias("__text")).join(tops, key, "left").join(tone_mood(pool, key), key, "left").join(themes, key, "left").join(ctx.select(key, "fold"), key, "left")
    j = j.withColumn("hay", F.concat(F.coalesce("fold", F.lit("")), F.coalesce(F.array_join("all", ""), F.lit(""))))
    j = j.join(pair_insight(j, key, "hay"), key)
    scene = X.scene(F.col("__text"))
    names = F.array_join(F.transform("top", lambda t: F.concat(F.lit("<"), t, F.lit(">"))), "")
    mood = F.create_map(*[x for k, v in say.mood.items() for x in (F.lit(k), F.lit(v))])[F.col("mood")]
    intro = F.when(scene == "", fill(say.intro_plain, names=names)).otherwise(fill(say.intro, scene=scene, names=names))
    fallback = F.array_join(F.filter(F.transform("firsts", lambda m: X.summarize(m, 90)), lambda s: s != ""), "\n")
    body = F.coalesce("themes", fallback)
    parts = F.array(intro, F.when(F.col("rule") > 0, fill(say.pair, rule=F.col("rule"))), F.when(body != "", body), mood, fill(say.omen, term=X.shortest(F.col("top"))), F.col("nouns"))
    reading = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")
    return j.select(key, F.when(F.col("top").isNull(), say.none).otherwise(reading).alias("reading"))
