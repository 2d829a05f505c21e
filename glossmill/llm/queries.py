"""The queries of this subpackage: each takes (spark, sf_dir) and runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import canonical, dedup, langid, leakage, mixing, neardup, site_lines, subjects, truncation
from glossmill.session import checkpointed, table

LEAST_LIKENESS = 0.75
MIN_CHARS = 300
LEAK_WORDS = 8
LEAST_TEXTS = 5
LEAST_SHARE = 0.01
SUBJECT_SHARE = 0.25


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "raw_entries")
    return langid.mislabelled(entries, langid.train(entries))


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "raw_entries")
    return langid.languages(entries, langid.train(entries))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts = site_lines.site_texts(table(spark, d, "dream_terms"))
    return site_lines.repeated_lines(texts, LEAST_TEXTS, LEAST_SHARE).select("meaning_id", "line_no")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_repeated_lines(site_lines.site_texts(table(spark, d, "dream_terms")), LEAST_TEXTS, LEAST_SHARE)


def _forms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    terms = table(spark, d, "dream_terms")
    keys = terms.select(F.lit("term").alias("field"), F.col("entry_id").alias("id"), F.col("term_normalized").alias("text"))
    m = terms.select(F.explode("meanings").alias("m"))
    return keys, m.select(F.lit("text").alias("field"), F.col("m.meaning_id").alias("id"), F.col("m.text").alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, rows in zip(("term", "text"), _forms(spark, d), strict=True):
        forms = canonical.one_form(rows.where("text is not null").select("id", "text"), ["id"])
        parts.append(canonical.alike_pairs(checkpointed(forms.select("id", *canonical.print_columns())), "id").select(F.lit(name).alias("field"), "id_a", "id_b"))
    return parts[0].unionByName(parts[1])


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    keys, texts = _forms(spark, d)
    return canonical.one_form(keys.unionByName(texts), ["field", "id"]).select("field", "id", "text", "form")


def _interpretations(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_entries").select(F.lit(0).alias("kind"), F.col("ord").alias("id"), F.col("source.name").alias("source"), F.col("meaning").alias("text"))
    m = table(spark, d, "dream_terms").select(F.explode("meanings").alias("m"))
    return raw.unionByName(m.select(F.lit(1).alias("kind"), F.col("m.meaning_id").alias("id"), F.col("m.source_name").alias("source"), F.col("m.text").alias("text")))


def _field(kind: Column) -> Column:
    return F.when(kind == 0, "meaning").otherwise("text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _interpretations(spark, d)
    return truncation.scored(texts, truncation.train(texts)).where("cut").select(_field(F.col("kind")).alias("field"), "id")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    texts = _interpretations(spark, d)
    return truncation.shares(truncation.scored(texts, truncation.train(texts))).withColumn("field", _field(F.col("kind"))).drop("kind")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds in one run: a node's last bit is its kind."""
    return _interpretations(spark, d).select((F.col("id") * 2 + F.col("kind")).alias("node"), "kind", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.alike_pairs(_nodes(spark, d), LEAST_LIKENESS, MIN_CHARS)
    return pairs.select(_field(F.col("a") % 2).alias("field"), F.floor(F.col("a") / 2).alias("id_a"), F.floor(F.col("b") / 2).alias("id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    g = neardup.groups(_nodes(spark, d), LEAST_LIKENESS, MIN_CHARS)
    return g.select(_field(F.col("node") % 2).alias("field"), F.floor(F.col("node") / 2).alias("id"), F.floor(F.col("group") / 2).alias("group_id"), "links")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copy_links(dedup.meaning_fingerprints(table(spark, d, "dream_terms")))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return dedup.collapse(dedup.meaning_fingerprints(table(spark, d, "dream_terms"))).select("keep_id", "copies")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), LEAK_WORDS).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), LEAK_WORDS)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return subjects.assign(documents, subjects.fit(documents, table(spark, d, "subject_labels")), SUBJECT_SHARE).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = subjects.fit(documents, table(spark, d, "subject_labels"))
    return subjects.composition(subjects.assign(documents, model, SUBJECT_SHARE), documents, table(spark, d, "subjects"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_languages, p2_found, p2_clean, p3_found, p3_forms, p4_found, p4_shares, p5_found, p5_groups,
        p6_found, p6_records, p7_found, p7_leaks, p8_mix, p8_shares, p9_found, p9_composition,
    )
}
