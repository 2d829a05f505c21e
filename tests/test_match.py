"""Matching, interpretation, search and history on small inputs."""

import random

from pyspark.sql import functions as F

from glossmill.operators import history, interpret, match, search
from glossmill.plans import bindings, catalogue
from glossmill.plans.catalogue import QUERIES
from glossmill.session import checkpointed

TERMS = ["犬", "黒い犬", "蛇", "snake", "black snake", "アパート", "お金", "海で泳ぐ", "古い家", "the", "古い家の犬", "ab", "水水", "へび", "階段を登る"]
TEXTS = ["黒い犬が海で泳いでいた。", "A black snake, and the dog!", "アパートの階段を登る夢", "いぬとヘビ", "", None, "!!", "浴びるいぬ", "snakes", "古い家に古い犬", "水水水と金"]


def frames(spark, terms=TERMS, texts=TEXTS):
    index = spark.createDataFrame([(k, t, "orig word" if k % 3 == 0 else None, 0) for k, t in enumerate(terms)], "row_no bigint, term string, orig string, tone int")
    q = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "ord bigint, text string")
    return match.contexts(q, "ord"), match.lexicon_features(index)


def nested_loop(ctx, features, key):
    """The same by comparing every text with every row."""
    j = ctx.crossJoin(features)
    has = {
        "kanji": lambda k: F.exists("kanji_runs", lambda r: F.contains(r, k)),
        "other": lambda k: F.array_contains("other_set", k) | ((F.length(k) >= 3) & F.contains("fold", k)),
        "latin": lambda k: F.array_contains("latin_set", k),
    }
    weight = {"kanji": lambda k: 20 * F.length(k) * F.length(k), "other": lambda k: 12 * F.length(k) * F.length(k), "latin": lambda k: 15 * F.length(k)}
    add = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0), lambda a, x: a + x)

    def hit(c: str):
        return add(c, lambda k: F.when(has[c](k), weight[c](k)).otherwise(0))

    got = {c: hit(c) for c in has}
    all_ = {c: add(c, weight[c]) for c in has}
    phrase = F.when(F.col("latin_phrase").isNotNull(), (F.length("latin_phrase") >= 3) & F.contains("pad", F.concat(F.lit(" "), F.col("latin_phrase"), F.lit(" ")))).otherwise((F.length("phrase") >= 3) & F.contains("fold", F.col("phrase")))
    j = j.select(key, "row_no", "term", F.length("phrase").alias("pl"), F.coalesce(phrase, F.lit(False)).alias("phrase_hit"), (got["kanji"] + got["other"]).alias("jg"), (all_["kanji"] + all_["other"]).alias("ja"), got["latin"].alias("lg"), all_["latin"].alias("la"))
    full = (F.col("ja") > 0) & (F.col("jg") == F.col("ja"))
    ja_ok = (F.col("ja") > 0) & (full | ((10 * F.col("jg") >= 6 * F.col("ja")) & (F.col("jg") >= 60)))
    latin_ok = (F.col("la") > 0) & (10 * F.col("lg") >= 6 * F.col("la"))
    score = F.when(F.col("phrase_hit"), 60 + 20 * F.col("pl")).otherwise(0) + F.when(ja_ok, F.col("jg")).otherwise(0) + F.when(latin_ok, F.col("lg")).otherwise(0) + F.when(full & (F.length("term") <= 2), 60).otherwise(0)
    return j.where(F.col("phrase_hit") | ja_ok | latin_ok).select(key, "row_no", score.cast("bigint").alias("score"), "phrase_hit", full.alias("ja_full")).where("score > 0")


def test_key_join_equals_nested_loop(spark):
    rng = random.Random(5)
    parts = ["犬", "黒", "海", "蛇", "アパ", "ート", "snake", "black", " ", "の", "い", "家", "水", "。", "へび", "ab"]
    terms = TERMS + ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(60)]
    ctx, features = frames(spark, terms, texts)
    a, b = match.match_candidates(ctx, features, "ord").collect(), nested_loop(ctx, features, "ord").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 100


def test_bridge(spark):
    ctx, _ = frames(spark)
    got = {r.ord: list(r.kanji_runs) for r in ctx.collect()}
    assert got[3] == ["犬", "蛇"] and got[7] == ["浴"] and 4 not in got and 5 not in got and 6 not in got


def test_diverse_against_plain_walk(spark):
    ctx, features = frames(spark)
    cand = match.match_candidates(ctx, features, "ord")
    ranked = cand.join(features, "row_no").select("ord", "row_no", "score", "ja_full", "phrase", "kanji", "term").collect()
    want = set()
    for q in {r.ord for r in ranked}:
        accepted = []
        for r in sorted((r for r in ranked if r.ord == q), key=lambda r: (-r.score, -len(r.phrase), len(r.term), r.row_no)):
            if len(accepted) == 12:
                break
            if any(a.phrase in r.phrase or r.phrase in a.phrase or (a.ja_full and r.ja_full and a.kanji and len(a.kanji) == len(r.kanji) and set(a.kanji) <= set(r.kanji)) for a in accepted):
                continue
            if r.kanji and sum(bool(set(a.kanji) & set(r.kanji)) for a in accepted) >= 2:
                continue
            accepted.append(r)
            want.add((q, r.row_no, len(accepted)))
    assert {(r.ord, r.row_no, r.place) for r in match.match_diverse(cand, features, "ord").collect()} == want


ITEM = "ord bigint, place int, row_no bigint, term string, tone int, meanings array<string>"


def test_themes_mood_and_reading(spark):
    items = spark.createDataFrame(
        [
            (1, 1, 10, "犬", 1, ["夢の中で犬を見ることは、忠実な友人との再会を意味します。"]),
            (1, 2, 11, "蛇", -1, ["蛇を見ることは、病気への不安を示しています。"]),
            (1, 3, 12, "海", 0, ["お金の夢です。"]),
            (1, 4, 13, "長い長い長い長い長い長い名前のもの", 0, []),
        ],
        ITEM,
    )
    hits = interpret.theme_hits(items, "ord")
    scores = {r.theme: (r.score, r.polarity, r.rank) for r in interpret.theme_scores(hits, "ord").collect()}
    assert scores["social"] == (1, 1, 2) and scores["health"] == (2, -2, 1)
    assert interpret.tone_mood(items, "ord").first().mood == "mixed"
    assert interpret.tone_digest(items, "ord").first().digest == "吉1 / 注意1"
    pool = interpret.reading_pool(items, "ord")
    assert sorted(r.row_no for r in pool.collect()) == [10, 11, 12]
    quotes = [(r.theme, r.term, r.quote, r.kind) for r in interpret.theme_quotes(hits, interpret.theme_scores(hits, "ord"), "ord").collect()]
    assert ("social", "犬", "忠実な友人との再会", "quote") in quotes
    texts = spark.createDataFrame([(1, "海と犬の夢。"), (2, "何もない"), (3, None)], "ord bigint, text string")
    read = {r.ord: r.reading for r in interpret.reading_compose(texts, pool, match.contexts(texts, "ord"), "ord").collect()}
    assert "<犬><蛇><海>" in read[1] and "rule 1" in read[1] and read[2] == read[3] and len(read) == 3


def test_pick_sense(spark):
    senses = [(1, "dog", 0, ["海の犬"], ["s"]), (2, "hound", 1, ["山の犬"], [])]
    attached = spark.createDataFrame([(1, 5, "犬", 0, "x", senses), (2, 5, "犬", 0, "x", senses), (3, 5, "犬", -1, "x", None)], "ord bigint, row_no bigint, term string, row_tone int, row_orig string, senses array<struct<place:int,orig:string,tone:int,meanings:array<string>,sources:array<string>>>")
    ctx = match.contexts(spark.createDataFrame([(1, "山で"), (2, "犬"), (3, "犬")], "ord bigint, text string"), "ord")
    got = {r.ord: (r.orig, r.tone) for r in interpret.pick_sense(attached, ctx, "ord").collect()}
    assert got == {1: ("hound", 1), 2: ("dog", 0), 3: ("x", -1)}


def test_search_ranks_and_cap(spark):
    index = spark.createDataFrame([(k, t, o, 0) for k, (t, o) in enumerate([("犬", "dog"), ("犬小屋", "kennel"), ("子犬", "puppy"), ("hot dog", "x"), ("猫", "dogfish")] + [("犬" + "あ" * n, "y") for n in range(1, 25)])], "row_no bigint, term string, orig string, tone int")
    f = match.lexicon_features(index)
    q = spark.createDataFrame([("犬",), ("dog",), ("「」",), ("犬",), (None,)], "query string")
    got = search.dict_search(q, f).orderBy("query", "place").collect()
    dog = [(r.row_no, r.rank) for r in got if r.query == "dog"]
    inu = [(r.row_no, r.rank) for r in got if r.query == "犬"]
    assert dog == [(3, 2), (0, 1), (4, 1)] and len(inu) == 20 and inu[0] == (0, 4) and inu[1][1] == 3 and {r.query for r in got} == {"犬", "dog"}
    assert search.stride_sample(f, 0, 4).count() <= 8


def test_history(spark):
    e = spark.createDataFrame([(k, k % 2, None if k == 3 else k) for k in range(200)], "id bigint, owner int, ts bigint")
    kept = history.latest(e, "owner", "ts", "id").collect()
    assert len(kept) == 120 and {r.id for r in kept if r.owner == 0} == set(range(80, 200, 2))
    assert history.delete(e, "id", [1, 2]).count() == 198 and history.clear(e).count() == 0
    assert history.latest(e.where(F.lit(False)), "owner", "ts", "id").count() == 0


def test_all_texts_are_read_whatever_their_label(spark, tmp_path):
    rows = [(1, "ja", "石橋を渡る"), (2, "ja-JP", "石橋を渡る"), (3, "jpn", "石橋を渡る"), (4, None, "石橋を渡る"), (5, "en", "An old bridge"), (6, "ja", None)]
    spark.createDataFrame(rows, "ord bigint, language string, meaning string").write.parquet(str(tmp_path / "raw_entries.parquet"))
    spark.createDataFrame([(1, "en", "old bridge", "石橋、古い橋")], "line_no bigint, lang string, text string, v string").write.parquet(str(tmp_path / "translation_cache.parquet"))
    assert sorted(r.ord for r in QUERIES["pair_insight"](spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5]
    assert sorted((r.ord, r.row_no) for r in QUERIES["match_candidates"](spark, str(tmp_path)).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_blocks_and_shared_keys(spark):
    rng = random.Random(6)
    parts = ["犬", "黒", "海", "蛇", "アパ", "ート", "snake", "black", " ", "の", "い", "家", "水", "。", "へび", "ab"]
    terms = TERMS + ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(40)]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(40)]
    ctx, features = frames(spark, terms, texts)
    told = lambda df: sorted(map(tuple, df.select("ord", "row_no", "score", "place").collect()))
    cand = nested_loop(ctx, features, "ord").cache()
    for blocks in ({}, {"lines": 20}):
        assert sorted(map(tuple, match.match_candidates(ctx, features, "ord", **blocks).collect())) == sorted(map(tuple, cand.collect()))
        for apart in (True, False):
            assert told(match.topk_of_texts(ctx, features, "ord", apart, **blocks)) == told(match.match_topk(cand, features, "ord"))
            assert told(match.diverse_of_texts(ctx, features, "ord", apart, **blocks)) == told(match.match_diverse(cand, features, "ord"))
    one = ctx.withColumn("ord", F.col("ord") * 0)  # one ranking for all texts of a key
    assert [r.place for r in match.topk_of_texts(one, features, "ord").orderBy("place").collect()] == list(range(1, 13))


def test_hits_of_rejected_pairs_are_no_rows(spark, tmp_path, capsys):
    words = [f"w{k:03}x" for k in range(40)]
    spark.createDataFrame([(k, "en", " ".join(words)) for k in range(5)] + [(9, "en", "w000x")], "ord bigint, language string, meaning string").write.parquet(str(tmp_path / "raw_entries.parquet"))
    lines = [(k, "en", f"{words[k % 40]} " + " ".join(f"z{k}{j}y" for j in range(5)), "犬") for k in range(80)]
    spark.createDataFrame(lines, "line_no bigint, lang string, text string, v string").write.parquet(str(tmp_path / "translation_cache.parquet"))
    for name in ("match_candidates", "match_topk", "match_diverse"):
        df = QUERIES[name](spark, str(tmp_path))
        assert df.count() == 0
        df.explain()
        assert "Join" not in capsys.readouterr().out


def test_items_join_lines_only(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "ja", "石橋を渡る"), (2, "ja", "石橋")], "ord bigint, language string, meaning string").write.parquet(str(tmp_path / "raw_entries.parquet"))
    spark.createDataFrame([(1, "en", "old bridge", "石橋、お金の吉")], "line_no bigint, lang string, text string, v string").write.parquet(str(tmp_path / "translation_cache.parquet"))
    for name in ("tone_digest", "theme_scores", "reading_pool", "tone_mood"):
        df = QUERIES[name](spark, str(tmp_path))
        assert sorted(r.ord for r in df.select("ord").distinct().collect()) == [1, 2]
        df.explain()
        plan = capsys.readouterr().out
        assert plan.count("Join") == plan.count("BroadcastHashJoin") == 1


def test_pools_are_kept_without_meanings(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "ja", "石橋を渡る"), (2, "ja", "石橋")], "ord bigint, language string, meaning string").write.parquet(str(tmp_path / "raw_entries.parquet"))
    spark.createDataFrame([(1, "en", "old bridge", "石橋、お金の吉")], "line_no bigint, lang string, text string, v string").write.parquet(str(tmp_path / "translation_cache.parquet"))
    kept = []
    for module in (bindings, catalogue):
        monkeypatch.setattr(module, "checkpointed", lambda df: kept.append(df.columns) or checkpointed(df))
    for name in ("reading_compose", "theme_quotes"):
        assert QUERIES[name](spark, str(tmp_path)).count() > 0
    assert kept and not any("meanings" in c for c in kept)


def test_pools_are_chosen_where_texts_are_met(spark, tmp_path, capsys):
    terms = [*TERMS, *(f"犬{'長' * n}" for n in range(10, 20)), "水" + "い" * 14]
    texts = [*TEXTS, "犬" + "長" * 19 + "、黒い犬", "水" + "い" * 14 + "犬" + "長" * 19, "古い家の犬と蛇と黒い犬が海で泳ぐお金の水水"]
    ctx, features = frames(spark, terms, texts)
    items = match.topk_of_texts(ctx, features, "ord", True).join(features.select("row_no", "term"), "row_no")
    want = interpret.reading_pool(items, "ord").select("ord", "row_no", "place", "pool_place")
    got = match.pool_of_texts(ctx, features, "ord")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("place <> pool_place").count() > 0
    assert match.pool_of_texts(ctx, features, "ord", lines=3) is None and match.pool_of_texts(ctx, features.unionByName(features), "ord") is None
    spark.createDataFrame([(1, "ja", "石橋を渡る"), (2, "ja", "石橋")], "ord bigint, language string, meaning string").write.parquet(str(tmp_path / "raw_entries.parquet"))
    spark.createDataFrame([(1, "en", "old bridge", "石橋、お金の吉")], "line_no bigint, lang string, text string, v string").write.parquet(str(tmp_path / "translation_cache.parquet"))
    QUERIES["reading_pool"](spark, str(tmp_path)).explain()
    QUERIES["tone_mood"](spark, str(tmp_path)).explain()
    assert "Window" not in capsys.readouterr().out


def test_first_lines_of_a_term_decide(spark):
    terms, texts = ["蛇"] * 40 + ["black dog"] * 3 + ["黒い犬"], ["蛇と black dog", "蛇", "orig word 蛇と黒い犬"]
    ctx, features = frames(spark, terms, texts)
    told = lambda df: sorted(map(tuple, df.select("ord", "row_no", "score", "place").collect()))
    cand = nested_loop(ctx, features, "ord").cache()
    assert sorted(map(tuple, match.match_candidates(ctx, features, "ord").collect())) == sorted(map(tuple, cand.collect()))
    assert told(match.topk_of_texts(ctx, features, "ord", True)) == told(match.match_topk(cand, features, "ord"))
    assert told(match.diverse_of_texts(ctx, features, "ord", True)) == told(match.match_diverse(cand, features, "ord"))


def test_contexts_are_made_in_one_pass(spark, capsys):
    texts = ["ＡＢ Ⅻ snake, snake's", "ヘビとカー・ヴ、いぬ。黒いぬ", "x\u3000y\x85z", "ΣΑΣ İß Straße a_b", "...", ""]
    df = match.contexts(spark.createDataFrame(list(enumerate(texts)), "ord bigint, text string"), "ord")
    got = {r[0]: tuple(r[1:]) for r in df.collect()}
    assert got == {
        0: ("abxiisnakesnakes", " ab xii snake snake s ", [], [], ["ab", "xii", "snake", "s"]),
        1: ("へびとかーゔいぬ黒いぬ", " ヘビとカー ヴ いぬ 黒いぬ ", ["黒", "犬", "蛇"], ["へび", "かー", "ゔ"], []),
        2: ("xyz", " x y z ", [], [], ["x", "y", "z"]),
        3: ("σαςi̇ßstraßea_b", " σας i ß straße a b ", [], [], ["i", "stra", "e", "a", "b"]),
    }
    df.explain()
    assert "Eval" not in capsys.readouterr().out


def test_all_pairs_are_handed_over_without_places(spark):
    ctx, features = frames(spark)
    met, blocks = match._meet(ctx, features, "ord", None, match.LINES)
    assert blocks == 1 and met.columns == ["ord", "row_no", "score", "phrase_hit", "ja_full"] == match.match_candidates(ctx, features, "ord").columns
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, match.match_candidates(ctx, features, "ord", 4).collect()))


def test_diverse_over_blocks_moves_no_pairs(spark, monkeypatch):
    rng = random.Random(29)
    bits = ["犬", "黒い", "蛇", "水", "家", "海", "夢", "ヘビ", "snake", "black", " ", "の", "アパート"]
    make = lambda n: "".join(rng.choices(bits, k=n))
    terms = [make(rng.randint(1, 3)) for _ in range(60)]
    ctx, f = frames(spark, terms + terms[:30], [make(rng.randint(2, 14)) for _ in range(80)])
    ctx, f = checkpointed(ctx), checkpointed(f)
    want = sorted(map(tuple, match.match_diverse(match.match_candidates(ctx, f, "ord"), f, "ord", 4).collect()))
    monkeypatch.setattr(match, "_HELD_PAIRS", 50, raising=False)
    for lines in (7, 30, 1000):
        got = match.diverse_of_texts(ctx, f, "ord", True, 4, lines)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 100
        assert "Exchange" not in got._jdf.queryExecution().toString()
    sent, made = [], match._blocks
    monkeypatch.setattr(match, "_blocks", lambda f, *a: (sent.append(f.count()), made(f, *a))[1])
    match.diverse_of_texts(ctx, f, "ord", True, 4, 1000)
    assert sent == [f.select("term", "phrase", "latin_phrase", "kanji", "other", "latin").distinct().count()] and sent[0] < 90


def long_original(spark, folder):
    """A line whose Latin keywords stand behind the 48th character of its original, and a text with them."""
    spark.createDataFrame([(1, "en", "A silver bridge")], "ord bigint, language string, meaning string").write.parquet(str(folder / "raw_entries.parquet"))
    spark.createDataFrame([(7, "en", "- " * 30 + "silver bridge", "犬")], "line_no bigint, lang string, text string, v string").write.parquet(str(folder / "translation_cache.parquet"))
    return str(folder)


def test_candidates_read_whole_originals(spark, tmp_path):
    assert [tuple(r) for r in QUERIES["match_candidates"](spark, long_original(spark, tmp_path)).collect()] == [(1, 7, 180, False, False)]


def test_topk_reads_whole_originals(spark, tmp_path):
    assert [tuple(r) for r in QUERIES["match_topk"](spark, long_original(spark, tmp_path)).collect()] == [(1, 7, 180, 1)]


def test_senses_are_chosen_where_texts_are_met(spark, monkeypatch):
    d, sizes = "/root/testdata/sf0.001", []
    monkeypatch.setattr(catalogue, "checkpointed", lambda df: (sizes.append(df.columns), checkpointed(df))[1])
    got = QUERIES["pick_sense"](spark, d)
    assert "hashpartitioning(ord" not in got._jdf.queryExecution().toString() and not any("fold" in columns for columns in sizes)
    monkeypatch.setattr(bindings, "apart", lambda *_: False)
    want = QUERIES["pick_sense"](spark, d)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() > 100
