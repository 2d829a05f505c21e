"""Consolidation, parsers, senses and caches on small hand-made inputs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossmill.operators import merge, senses, translate
from glossmill.plans.catalogue import QUERIES
from glossmill.sources import parsers, readers

ENTRY = "ord bigint, term string, language string, meaning string, aliases array<string>, source struct<name:string,author:string,url:string,license_note:string>, extra int"


def entries(spark, rows):
    return spark.createDataFrame([(o, t, l, m, a, None if s is None else (s, None, "u", None), 0) for o, t, l, m, a, s in rows], ENTRY)


ROWS = [
    (1, "Black  Dog", "en", "Luck.", ["b", "A"], "s1"),
    (2, "black dog", "tr", "luck. ", ["a"], "s2"),
    (3, "BLACK DOG", "en", "Loss.", None, "s1"),
    (4, "a", "en", "dropped", [], "s1"),
    (5, "水", "zh-Hant", "財", [], "s1"),
    (6, None, "en", "x", [], "s1"),
    (7, " ", "en", "x", [], "s1"),
    (8, "dog", "en", None, [], "s1"),
    (9, "cat", None, "purr", [None], None),
]


def test_merge(spark):
    e = entries(spark, ROWS)
    got = {r.term_normalized: r for r in merge.merge_lexicon(e).collect()}
    assert set(got) == {"black dog", "水", "cat"}
    b = got["black dog"]
    assert (b.term, b.language, b.meaning_count, b.source_count, b.first_ord) == ("Black Dog", "en", 2, 2, 1)
    assert sorted((r.ord, r.text) for r in merge.merge_meanings(e).collect() if r.term_normalized == "black dog") == [(1, "Luck."), (3, "Loss.")]
    assert sorted((r.ord, r.name) for r in merge.merge_sources(e).collect() if r.term_normalized == "black dog") == [(1, "s1"), (2, "s2")]
    assert [r.alias for r in merge.merge_aliases(e).where("term_normalized = 'black dog'").orderBy("sort_key", "alias").collect()] == ["A", "a", "b"]
    nested = {r.term_normalized: r for r in merge.nest(merge.merge_lexicon(e), merge.merge_meanings(e), merge.merge_sources(e), merge.merge_aliases(e)).collect()}
    assert [m.text for m in nested["black dog"].meanings] == ["Luck.", "Loss."]


def test_merge_is_idempotent_and_ignores_row_order(spark):
    e = entries(spark, ROWS)
    once = merge.merge_lexicon(e).collect()
    assert sorted(once) == sorted(merge.merge_lexicon(e.orderBy(F.rand(3))).collect())
    assert len({r.term_normalized for r in once}) == len(once)
    again = merge.merge_meanings(e).select(F.col("ord"), F.col("term_normalized").alias("term"), F.lit("tr").alias("language"), F.col("text").alias("meaning"), F.array().cast("array<string>").alias("aliases"), F.struct("source_name", F.lit(None).cast("string").alias("a"), "source_url", "license_note").cast("struct<name:string,author:string,url:string,license_note:string>").alias("source"))
    assert {(r.term_normalized, r.meaning_count) for r in merge.merge_lexicon(again).collect()} == {(r.term_normalized, r.meaning_count) for r in once}


def test_merge_of_nothing(spark):
    e = entries(spark, []) if False else spark.createDataFrame([], ENTRY)
    for f in (merge.merge_lexicon, merge.merge_meanings, merge.merge_sources, merge.merge_aliases):
        assert f(e).count() == 0


def test_row_count_guard(spark):
    assert merge.row_count_guard(spark.range(100)).first()[0] == 100
    with pytest.raises(Exception, match="fewer than"):
        merge.row_count_guard(spark.range(99)).collect()


def test_upsert(spark):
    terms = spark.createDataFrame([(1, "Dog", "dog", "en", [("Luck", "s")], [("s",)])], "entry_id bigint, term string, term_normalized string, language string, meanings array<struct<text:string,source_name:string>>, sources array<struct<name:string>>")
    pages = spark.createDataFrame([(1, "a", "DOG", "x", " luck "), (2, "b", "Yeni", None, "söz"), (3, "c", None, None, None)], "line_no bigint, slug string, term string, alias string, meaning string")
    got = {r.term_normalized: (r.term, r.language, r.meaning_count, r.source_count, r.is_new) for r in merge.lexicon_upsert(terms, pages, "p").collect()}
    assert got == {"dog": ("Dog", "en", 1, 2, False), "yeni": ("Yeni", "tr", 1, 1, True)}


def test_headings(spark):
    text = "front\n_Dog_.\nGood [1]\n\n\n\nfriend\n_Cat and Mouse_[2].\n_Owl_.\n \n[_x_.\n" + "_" + "y" * 85 + "_.\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = [(r.id, r.term, r.meaning) for r in parsers.heading_sections(df, ["id"]).orderBy("section").collect()]
    assert got[0] == (1, "Dog", "Good [1]\n\nfriend\n_Cat and Mouse_[2].")
    assert got[1][1] == "Owl"


def test_alias_split(spark):
    df = spark.createDataFrame([("Cat AND Mouse",), ("Sandy",), (None,)], "t string")
    assert [r[0] for r in df.select(parsers.alias_split(F.col("t"))).collect()][:2] == [["Cat", "Mouse"], []]


def test_pattern_pairs(spark):
    def pairs(text, pattern):
        df = spark.createDataFrame([(1, text)], "id int, text string")
        return [(r.term, r.meaning) for r in parsers.pattern_pairs(df, ["id"], pattern).orderBy("pos").collect()]

    assert pairs("_Dog_--a friend\nand more\n_Cat_—foe", parsers.DASH_PAIRS) == [("Dog", "a friend\nand more"), ("Cat", "foe")]
    assert pairs("=Dog.=.--good =Cat=--bad", parsers.EQUALS_PAIRS) == [("Dog", "good"), ("Cat", "bad")]
    assert pairs("HORSE'S HEAD. Luck ahead. 12, 3.\nOWL. Wise.", parsers.CAPITAL_PAIRS) == [("Horse'S Head", "Luck ahead.."), ("Owl", "Wise.")]


def test_transcripts_questions_phrases_symbols(spark):
    t = spark.createDataFrame([(1, "### Human: What does it mean if I dream about an owl? ### Assistant: Wise\nbird"), (2, "x ### Human: no"), (3, None)], "id int, text string")
    assert [(r.id, r.term, r.meaning) for r in parsers.transcripts(t, ["id"]).collect()] == [(1, "owl", "Wise\nbird")]
    q = spark.createDataFrame([(1, "Rüyada at görmek ne anlama gelir?", "iyi"), (2, "başka soru", "kötü"), (3, None, "x")], "id int, soru string, icerik string")
    assert [(r.term, list(r.aliases)) for r in parsers.questions(q, ["id"], "soru", "icerik").orderBy("id").collect()] == [("at", ["Rüyada at görmek ne anlama gelir?"]), ("başka soru", [])]
    w = spark.createDataFrame([(1, "{{x}}\n== h ==\n詩曰\n一二三四　一二三四五  六七八九十\n一二三四a五")], "id int, text string")
    assert [r.term for r in parsers.phrases(w, ["id"]).orderBy("line_pos", "pos").collect()] == ["一二三四五", "六七八九十"]
    s = spark.createDataFrame([(1, ["Dog", "dog", None], "Good. Very."), (2, ["DOG", "Cat"], "No end"), (3, [], "x"), (4, ["Owl"], None)], "ord int, symbols array<string>, interpretation string")
    assert sorted((r.term, r.meaning, r.ord) for r in parsers.symbol_rows(s, "ord").collect()) == [("Cat", "No end.", 2), ("Dog", "Good.", 1)]


def test_pages(spark):
    p60, p59 = "x" * 60, "y" * 59
    html = [("a", f"<h1 id='t'>Rüyada <b>At</b> &amp; Kuş görmek</h1><p>Dini {p60}</p><p>{p60}</p>"), ("b", f"<h1>T</h1><p>{p59}</p>"), ("c", f"<p>{p60}</p>"), ("d", f"<h1>K</h1><p>dini {p60}</p>"), ("e", None)]
    df = spark.createDataFrame(html, "slug string, html string")
    assert sorted((r.slug, r.term, r.meaning[:4]) for r in parsers.pages(df).collect()) == [("a", "At & Kuş", "xxxx"), ("d", "K", "dini")]


def test_readers(spark, tmp_path):
    import gzip
    import zipfile

    (tmp_path / "c.jsonl").write_text('{"k":"a","v":"1"}\nbroken\n{"k":"b","v":"2"}\n{"k":"a","v":"3"}\n', encoding="utf-8")
    log = readers.read_jsonl_cache(spark, str(tmp_path / "c.jsonl"), "k string, v string")
    assert sorted((r.k, r.v) for r in readers.cache_last_wins(log, ["k"]).collect()) == [("a", "3"), ("b", "2")]
    assert readers.read_jsonl_cache(spark, str(tmp_path / "none.jsonl"), "k string, v string").count() == 0
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.csv", '﻿Dream Symbol,Interpretation\nDog,"a\nb"\n')
    assert [tuple(r) for r in readers.read_zipped_csv(spark, str(tmp_path / "z.zip"), "m.csv", ["Dream Symbol", "Interpretation"]).collect()] == [("Dog", "a\nb")]
    (tmp_path / "t.csv").write_text('Word,Interpretation\nDog,"say ""hi""\nthere"\n', encoding="utf-8")
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), ["Interpretation", "Missing"]).first()[0] == 'say "hi"\nthere'
    with gzip.open(tmp_path / "b.txt.gz", "wb") as f:
        f.write("﻿hello".encode())
    assert readers.read_text(spark, str(tmp_path / "b.txt.gz")).first().text == "hello"
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": null}]')
    assert readers.read_json(spark, str(tmp_path / "j.json"), "a int").count() == 2


def test_appended_cache_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "cache")
    batch = lambda v, n: spark.createDataFrame([("a", v)] + [(f"k{v}{k}", "x" * 50) for k in range(n)], "k string, v string").coalesce(1)
    for v, n in (("first", 300), ("second", 1), ("third", 900), ("last", 5)):
        readers.write_cache(batch(v, n), path)
    log = readers.read_jsonl_cache(spark, path, "k string, v string")
    assert log.columns == ["line_no", "k", "v"] and log.count() == 1210
    assert {r.k: r.v for r in readers.cache_last_wins(log, ["k"]).collect()}["a"] == "last"


def test_batches_do_not_cross_blocks(spark):
    items = spark.createDataFrame([("en", k, 0, "text") for k in (0, 49_999, 50_000, 50_001, 120_000)], "lang string, entry_id bigint, slot int, text string")
    got = {r.entry_id: (r.block, r.batch) for r in translate.batch_fill(items).collect()}
    assert got == {0: (0, 0), 49_999: (0, 0), 50_000: (1, 0), 50_001: (1, 0), 120_000: (2, 0)}


def test_paged_source(spark):
    spark.dataSource.register(readers.paged_source("numbers", "n int", lambda offset, limit: [(offset + k,) for k in range(limit)]))
    rows = spark.read.format("numbers").option("total", 23).option("page", 10).load()
    assert sorted(r.n for r in rows.collect()) == list(range(23))
    assert sorted(r.n for r in spark.read.format("numbers").option("total", 23).option("page", 10).option("start", 20).load().collect()) == [20, 21, 22]


def test_batches(spark):
    lengths = [3700, 10, 3589, 3588, 1] + [5] * 60
    df = spark.createDataFrame([("tr", k, 0, "x" * n) for k, n in enumerate(lengths)], "lang string, entry_id bigint, slot int, text string")
    got = [r.batch for r in translate.batch_fill(df).orderBy("entry_id").collect()]
    batch, held, count, want = 0, 0, 0, []
    for n in lengths:
        if count and (held + n > 3600 or count >= 48):
            batch, held, count = batch + 1, 0, 0
        held, count = held + n + 1, count + 1
        want.append(batch)
    assert got == want


TERMS = "entry_id bigint, term string, term_normalized string, language string, meanings array<struct<text:string>>, sources array<struct<name:string>>"


def test_senses(spark):
    names = ["dog", "köpek", "狗", "hound", "perro"]
    langs = ["en", "tr", "zh-Hant", "en", "my"]
    terms = spark.createDataFrame([(k, n, n, g, [(f"m{k}",), (f"m{k}",)], [("s1",), ("s1",), ("s2",)]) for k, (n, g) in enumerate(zip(names, langs))], TERMS)
    order = sorted(range(5), key=lambda k: names[k])
    last = order[4]
    cache = [(k + 1, g, n, "犬" if k == last else "犬・") for k, (n, g) in enumerate(zip(names, langs))] + [(k + 10, g, f"m{k}", f"良い夢{k}") for k, g in enumerate(langs)]
    cache = spark.createDataFrame(cache, "line_no bigint, lang string, text string, v string")
    got = senses.sense_merge(terms, cache).orderBy("sense_no").collect()
    assert len(got) == 4 and {r.term for r in got} == {"犬"}
    assert [r.orig for r in got] == [names[k] for k in order[:4]]
    assert set(got[0].langs) == set(langs) and list(got[0].sources) == ["s1"] and list(got[0].meanings) == [f"良い夢{order[0]}"]
    index, payload = senses.build_index(terms, cache)
    assert index.count() == 1 and payload.count() == 4 and index.first().tone == 1


def test_shards(spark):
    keys = spark.createDataFrame([(f"k{n:04d}",) for n in range(300)], "key string")
    got = senses.shard_assign(keys).orderBy("i").collect()
    size = -(-300 // 128)
    assert [(r.key, r.shard, r.idx) for r in got] == [(f"k{n:04d}", n // size, n % size) for n in range(300)]
    assert senses.shard_assign(keys.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    readers.write_lexicon(merge.merge_lexicon(spark.createDataFrame([(1, "Dog", "en", "m", [], ("s", None, "u", None), 0)], ENTRY)), str(tmp_path / "lex"))
    assert spark.read.json(str(tmp_path / "lex/summary")).first().entry_count == 1
    readers.write_shards(spark.createDataFrame(pd.DataFrame({"shard": [1, 2], "x": [3, 4]})), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).where("shard = 2").first().x == 4


def test_translator_answers_are_checked(spark):
    items = spark.createDataFrame([("en", k, 0, f"t{k}") for k in range(60)] + [("tr", 1, 0, "bad"), ("tr", 2, 0, "good")], "lang string, entry_id bigint, slot int, text string")

    def call(lang, texts):
        if lang == "tr":
            if texts == ["bad"]:
                raise ValueError
            return [t.upper() for t in texts][:1]
        return [t.upper() for t in texts]

    got = {(r.lang, r.text): r.v for r in translate.translate_batches(items, call).collect()}
    assert got["en", "t59"] == "T59" and got["tr", "bad"] is None and got["tr", "good"] == "GOOD" and len(got) == 62
    assert translate.translate_batches(items, call, wait=0).where("failed").select("text").collect() == [("bad",)]

    def wrong(lang, texts):
        raise KeyError("a mistake in the program")

    with pytest.raises(Exception, match="a mistake in the program"):
        translate.translate_batches(items, wrong).collect()


def test_items_and_todo(spark):
    terms = spark.createDataFrame([(1, "Dog", "dog", "en", [("Dog",), ("A  friend.",), ("third",)], []), (2, "Dog", "dog", "en", [(None,)], []), (3, "x", "x", "fr", [("y",)], []), (4, None, None, "tr", None, None)], TERMS)
    items = translate.translation_items(terms)
    assert sorted((r.text, r.entry_id, r.slot) for r in items.collect()) == [("A friend.", 1, 2), ("Dog", 1, 0)]
    cache = spark.createDataFrame([("en", "Dog", None, 1)], "lang string, text string, v string, line_no bigint")
    assert [r.text for r in translate.translation_todo(items, cache).collect()] == ["A friend."]


def test_every_cache_line_is_looked_up(spark, tmp_path):
    rows = [(1, "en", "dog", "x"), (2, "en", "dog", "y"), (3, "tr", "dog", None), (4, None, "dog", "z")]
    spark.createDataFrame(rows, "line_no bigint, lang string, text string, v string").write.parquet(str(tmp_path / "translation_cache.parquet"))
    got = {r.line_no: r.told for r in QUERIES["translate_lookup"](spark, str(tmp_path)).collect()}
    assert got == {1: "y", 2: "y", 3: None, 4: None}


def test_nesting_keeps_all_meanings_of_a_wide_key(spark):
    rows = [(k, "Dog" if k % 2 else f"t{k}", "en", f"m{k // 4}", ["x"], f"s{k % 3}") for k in range(13, 53)] + [(100_000, "t14", "en", "far", [], "s0")]
    e = entries(spark, rows)
    parts = merge.nest(merge.merge_lexicon(e), merge.merge_meanings(e), merge.merge_sources(e), merge.merge_aliases(e), most=8).collect()
    dog = sorted((r for r in parts if r.term_normalized == "dog"), key=lambda r: r.part)
    assert [m.text for r in dog for m in r.meanings] == [f"m{k}" for k in range(3, 13)]
    assert len(dog) > 1 and dog[0].part == 0 and all(len(r.meanings) <= 8 for r in dog)
    assert [s.name for s in dog[0].sources] == ["s1", "s0", "s2"] and dog[0].aliases == ["x"] and all(r.sources is None and r.aliases is None for r in dog[1:])
    assert [[m.text for m in r.meanings] for r in parts if r.term_normalized == "t14"] == [["m3", "far"]]


def test_nested_lexicon_counts_all_meanings(spark, tmp_path):
    hot = spark.range(10_050).select(F.col("id").alias("ord"), F.lit("dog").alias("term"), F.lit("en").alias("language"), F.concat(F.lit("m"), "id").alias("meaning"), F.array(F.lit("x")).alias("aliases"))
    hot.withColumn("source", F.struct(F.lit("s").alias("name"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("license_note"))).write.parquet(str(tmp_path / "raw_entries.parquet"))
    assert [tuple(r) for r in QUERIES["nested_lexicon"](spark, str(tmp_path)).collect()] == [("dog", 10_050, 1, 1)]
