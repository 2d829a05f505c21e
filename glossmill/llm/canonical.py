"""Problem 3: one stored form for text that looks the same.

Texts holding a code point that a mapping changes, or marks that need reordering or composition, are exploded to positioned code points and joined with a broadcast mapping (decompositions, look-alike letters, invisible
characters; a few thousand rows that depend on the Unicode version alone). Marks are ordered by combining class within
their cluster, and the string is rebuilt and recomposed. All other texts are already in the form and never explode.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.session import checkpointed, spread

# Letters of other scripts, and the Latin letters that they look like.
CYRILLIC = "аеорсухѕіјһԁԛԝѵүӏАВЕЅІЈКМНОРСТХҮԌԚԜѴӀ"
CYRILLIC_AS = "aeopcyxsijhdqwvylABESIJKMHOPCTXYGQWVI"
GREEK = "ονιραγυΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ"
GREEK_AS = "ovipayuABEZHIKMNOPTYXcj"
LATIN_SPECIAL = "ɑɡɩ"
LATIN_SPECIAL_AS = "agi"
# Characters that show nothing.
INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF)
# Blanks that look like the ordinary one.
BLANKS = (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>"}
_COMPAT_RANGES = ((0xFB00, 0xFB50), (0x2E80, 0x2FE0), (0x0132, 0x0134), (0x013F, 0x0141), (0x0149, 0x014A), (0x01C4, 0x01CD), (0x01F1, 0x01F4))


def _decomposed(cp: int) -> str | None:
    """The look-preserving decomposition of a code point, or None where it stands for itself."""
    c = chr(cp)
    d = unicodedata.decomposition(c)
    if not d or 0xAC00 <= cp < 0xD7A4:
        return None
    if d.startswith("<"):
        tag = d.split()[0]
        if tag not in _TAGS and not (tag == "<compat>" and any(a <= cp < b for a, b in _COMPAT_RANGES)):
            return None
        return unicodedata.normalize("NFD", "".join(_decomposed(ord(x)) or x for x in unicodedata.normalize("NFKD", c)))
    return unicodedata.normalize("NFD", c)


def mapping() -> tuple[tuple[int, str], ...]:
    """(code point, replacement) for every code point that is not kept as it is; replacements are fully decomposed."""
    out: dict[int, str] = {}
    for cp in range(0x80, 0x30000):
        if (d := _decomposed(cp)) is not None:
            out[cp] = d
    out |= {cp: "" for cp in INVISIBLE} | {cp: " " for cp in BLANKS}
    for a, b in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (LATIN_SPECIAL, LATIN_SPECIAL_AS)):
        out |= {ord(x): y for x, y in zip(a, b, strict=True)}
    # An accented look-alike decomposes to a look-alike base: map the base too.
    return tuple((cp, "".join(out.get(ord(x), x) if ord(x) != cp and len(s) > 1 else x for x in s)) for cp, s in sorted(out.items()))


_replaced: dict[int, str] = {}
_moved: list[re.Pattern] = []


def _tables() -> tuple[dict[int, str], list[re.Pattern]]:
    """The mapping, and patterns for the code points that it changes for good (not back by composition). Made once a worker."""
    if not _moved:
        _replaced.update(mapping())
        gone = [cp for cp, to in _replaced.items() if unicodedata.normalize("NFC", to) != chr(cp)]
        # Two steps: a set within the basic plane compiles to a bitmap. The others stand for their whole planes, which costs only time.
        _moved.append(re.compile("[" + "".join(re.escape(chr(cp)) for cp in gone if cp < 0x10000) + "]"))
        _moved.append(re.compile("[\U00010000-\U0002FFFF]"))
    return _replaced, _moved


def form_of(text: str) -> str:
    """The single form of one string."""
    return unicodedata.normalize("NFC", text.translate(_tables()[0]))


def _is_odd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    near, far = (p.search for p in _tables()[1])
    for s in batches:
        yield s.map(lambda t: t is not None and (not unicodedata.is_normalized("NFC", t) or near(t) is not None or far(t) is not None)).astype(bool)


_is_odd_udf = F.pandas_udf(_is_odd, T.BooleanType())


def _mapping_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(mapping(), columns=["cp", "to"]), "cp int, to string")


def _compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


_compose_udf = F.pandas_udf(_compose, T.StringType())


def _class_frame(spark: SparkSession) -> DataFrame:
    marks = [(cp, unicodedata.combining(chr(cp))) for cp in range(0x300, 0x1F000)]
    return spark.createDataFrame(pd.DataFrame([m for m in marks if m[1]], columns=["point", "ccc"]), "point int, ccc int")


def one_form(texts: DataFrame, key: list[str], col: str = "text", out: str = "form") -> DataFrame:
    """``key`` columns, ``col`` and ``out``, the text's single form. ``key`` must identify a row.

    Null gives null, empty gives empty; other columns are not read, so clashing names do no harm.
    """
    spark = texts.sparkSession
    base = spread(texts).select(*key, F.col(col).alias("__text")).withColumn("__odd", _is_odd_udf(F.when(F.octet_length("__text") != F.length("__text"), F.col("__text"))))
    calm = base.where("not __odd").select(*key, F.col("__text").alias(col), F.col("__text").alias(out))
    odd = base.where("__odd").select(*key, "__text")
    # ascii() of one character is its code point.
    chars = odd.select(*key, "__text", F.posexplode(F.split("__text", "")).alias("pos", "c")).withColumn("__text", F.when(F.col("pos") == 0, F.col("__text")))
    mapped = chars.withColumn("cp", F.ascii("c")).join(F.broadcast(_mapping_frame(spark)), "cp", "left")
    points = mapped.select(*key, "__text", "pos", F.posexplode(F.split(F.coalesce("to", "c"), "")).alias("sub", "c"))
    points = points.withColumn("point", F.ascii("c")).join(F.broadcast(_class_frame(spark)), "point", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    # A window and a grouping by the text: both as large as the one text, over one shuffle. Marks sort by class in their cluster.
    cluster = F.sum((F.col("ccc") == 0).cast("int")).over(Window.partitionBy(*key).orderBy("pos", "sub")).alias("cluster")
    numbered = points.select(*key, "__text", cluster, "ccc", "pos", "sub", "c")
    arrays = numbered.groupBy(*key).agg(F.first("__text", ignorenulls=True).alias(col), F.array_sort(F.collect_list(F.struct("cluster", "ccc", "pos", "sub", "c"))).alias("a"))
    rebuilt = arrays.select(*key, col, F.array_join(F.transform("a", lambda x: x["c"]), "").alias("s"))
    return calm.unionByName(rebuilt.select(*key, col, _compose_udf("s").alias(out)))


def print_columns(col: str = "text", form: str = "form") -> list[Column]:
    """128-bit hashes of the form (``f1``, ``f2``) and of the stored string (``s1``, ``s2``)."""
    return [F.xxhash64(form).alias("f1"), F.xxhash64(F.lit(1), form).alias("f2"), F.xxhash64(col).alias("s1"), F.xxhash64(F.lit(1), col).alias("s2")]


def alike_pairs(prints: DataFrame, id_col: str) -> DataFrame:
    """(``id_a``, ``id_b``), ``id_a`` < ``id_b``: rows with one form whose stored strings differ, from ``print_columns``.

    Strings are paired first, each once, and rows then join the pairs of their string: a form that a third of the rows share
    costs as much as its result, also where one of its strings is hot. Leave null texts out before.
    """
    rows = prints.select(F.col(id_col).alias("id"), "f1", "f2", "s1", "s2")
    strings = rows.select("f1", "f2", "s1", "s2").distinct()
    several = strings.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f1", "f2")
    few = checkpointed(strings.join(several, ["f1", "f2"]))
    a, b = few.alias("a"), few.alias("b")
    same = (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2"))
    once = (F.col("a.s1") < F.col("b.s1")) | ((F.col("a.s1") == F.col("b.s1")) & (F.col("a.s2") < F.col("b.s2")))
    pairs = a.join(b, same & once).select("a.f1", "a.f2", *[F.col(f"{x}.{c}").alias(f"{x}{c[1]}") for x in ("a", "b") for c in ("s1", "s2")])
    held = checkpointed(rows.join(several, ["f1", "f2"]).select("id", "s1", "s2"))
    left = held.select(F.col("id").alias("ia"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    right = held.select(F.col("id").alias("ib"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    met = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"])
    return met.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
