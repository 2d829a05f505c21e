"""Problem 5: texts reprinted with small changes, found by covering locality-sensitive hashing.

Likeness is the Jaccard index of the sets of 3-character substrings of the lower-cased text with blanks collapsed.

Every text gets a sketch of ``GROUPS`` x 14 coordinates by one-permutation min-hashing (two texts agree in a coordinate
with a probability equal to their likeness). The 14 coordinates of a group carry the 7 non-zero vectors of GF(2)^3, two
each. Each of the 7 non-zero vectors v is a mask that keeps the coordinates whose vector has an odd product with v (8 of
14) and drops the other 6; a kept selection is hashed to one bucket key. Any two differing vectors have a common
orthogonal v, so two sketches that differ in at most two coordinates of any group are guaranteed to share a bucket. Hence
any that differ in at most 3 x GROUPS - 1 coordinates in all (17 of 84) do, wherever these lie; more differences are caught
whenever they fall into the six of one mask.

Bucket rows carry 128 further min-hash bits, by which pairs that meet are compared in the join; those that agree three
standard deviations less than texts at the limit do are dropped. The others are compared by all coordinates of their sketches
(four standard deviations), since chance meetings grow with the square of the rows, and what is left is verified exactly. A bucket that a sample
shows to be hot is split into blocks that meet pair by pair, so that no task holds it whole; buckets have no size cap.

Texts that differ only in case, white space or punctuation form one fold; links are made between written forms (white
space and case aside) of different folds, each named by its smallest node, so that copies are never expanded into pairs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.canonical import form_of
from glossmill.session import checkpointed, spread

GROUPS = 6
VECTORS = 7
PER_VECTOR = 2
_SPOTS = GROUPS * VECTORS * PER_VECTOR
#: Further coordinates of one bit each.
_BITS = 128
#: Numbers of nodes are sent to all tasks up to this many; beyond it they are joined.
MAX_SENT = 2_000_000
#: A bucket with at least HOT of the sketches that fall into one of SAMPLED classes is split; a block has about HOT * SAMPLED sketches.
SAMPLED = 64
HOT = 64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Where an empty coordinate looks for a value, in turn.
_LOANS = {n: [np.random.default_rng(k).permutation(n) for k in range(40)] for n in (_SPOTS, _BITS)}
_LONGS = [f"g{k}" for k in range(2 * GROUPS)]
# ASCII symbols that count as punctuation though Unicode calls them symbols.
_ASCII_SYMBOLS = "$+<=>^`|~"
_dropped: list[re.Pattern] = []


def normal(text: str) -> str:
    """Lower case, every run of white space one blank, trimmed."""
    return " ".join(text.lower().split())


def folded(text: str) -> str:
    """Case, white space and punctuation disregarded."""
    if not _dropped:
        # Two steps: a set within the basic plane compiles to a bitmap.
        chars = [c for c in map(chr, range(sys.maxunicode + 1)) if c in _ASCII_SYMBOLS or c.isspace() or unicodedata.category(c)[0] in "PZ"]
        _dropped.extend(re.compile("[" + "".join(re.escape(c) for c in part) + "]+") for part in ([c for c in chars if c < "\U00010000"], [c for c in chars if c >= "\U00010000"]))
        _dropped.append(re.compile("[\U00010000-\U0010ffff]"))
    kept = _dropped[0].sub("", text.upper())
    return (_dropped[1].sub("", kept) if _dropped[2].search(kept) else kept).lower().replace("i̇", "i")


def _smallest(owner: np.ndarray, h: np.ndarray, n: int, spots: int) -> np.ndarray:
    """The smallest hash of each of ``n`` owners in each spot. A spot to which none falls borrows from others in a fixed order,
    else short texts would agree in being empty."""
    none = np.iinfo(np.uint64).max
    out = np.full(n * spots, none, np.uint64)
    np.minimum.at(out, owner * spots + ((h >> np.uint64(40)) % np.uint64(spots)).astype(np.int64), h & np.uint64(0xFFFFFFFFFF))
    out = out.reshape(n, spots)
    own, empty = out.copy(), out == none
    for loan in _LOANS[spots]:
        if not empty.any():
            break
        rows, at = np.nonzero(empty)
        out[rows, at] = own[rows, loan[at]]
        empty = out == none
    return out * np.uint64(0x94D049BB133111EB)


def sketches(texts: list[str]) -> np.ndarray:
    """A row of longs a text: two for the one-byte coordinates of each group, then two of single bits."""
    n, lengths = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(n), lengths)
    h = codes[:-2] * _MULTIPLIERS[0] + codes[1:-1] * _MULTIPLIERS[1] + codes[2:] * _MULTIPLIERS[2]
    inside = owner[:-2] == owner[2:]
    h, owner = h[inside], owner[:-2][inside]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (_smallest(owner, h, n, _SPOTS) >> np.uint64(56)).astype(np.uint8).reshape(n, GROUPS * PER_VECTOR, VECTORS)
    packed = np.concatenate([low, np.zeros((n, GROUPS * PER_VECTOR, 1), np.uint8)], axis=2)
    h *= _MULTIPLIERS[1]
    h ^= h >> np.uint64(31)
    bits = np.packbits((_smallest(owner, h, n, _BITS) >> np.uint64(63)).astype(np.uint8), axis=1)
    return np.concatenate([packed.reshape(n, -1), bits], axis=1).view(np.int64)


def likeness(a: str, b: str) -> float:
    """Jaccard index of the 3-gram sets; 0 where both are empty."""
    x, y = ({t[k : k + 3] for k in range(len(t) - 2)} for t in (normal(a), normal(b)))
    return len(x & y) / len(x | y) if x or y else 0.0


def _sketch_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), 1000):
            part = pdf.iloc[k : k + 1000]
            plain = [normal(t) for t in part["text"]]
            bare = np.frombuffer(b"".join(xxhash.xxh3_128_digest(folded(t).encode("utf-8", "surrogatepass")) for t in part["text"]), np.int64).reshape(-1, 2)
            written = np.frombuffer(b"".join(xxhash.xxh3_64_digest(t.encode("utf-8", "surrogatepass")) for t in plain), np.int64)
            out = pd.DataFrame(sketches(plain), columns=[*_LONGS, "s1", "s2"])
            out.insert(0, "node", part["node"].to_numpy())
            out.insert(1, "kind", part["kind"].to_numpy())
            yield out.assign(f1=bare[:, 0], f2=bare[:, 1], w=written)


def _bucket_keys() -> Column:
    """The 7 x GROUPS bucket keys of a sketch."""
    keys = []
    for g in range(GROUPS):
        for v in range(1, VECTORS + 1):
            kept = sum(0xFF << 8 * (m - 1) for m in range(1, VECTORS + 1) if (m & v).bit_count() % 2)
            parts = [F.col(_LONGS[PER_VECTOR * g + j]).bitwiseAND(F.lit(kept)) for j in range(PER_VECTOR)]
            keys.append(F.shiftrightunsigned(F.xxhash64(F.lit(g * 8 + v), "kind", *parts), 20))  # 44 bits: short rows to move, few chance meetings
    return F.array(*keys)


def _meetings(sketched: DataFrame, least: float) -> DataFrame:
    """(``a1, a2, b1, b2``): the single bits of different sketches of one kind that share a bucket and resemble each other."""
    each = lambda df: df.select("s1", "s2", F.explode(_bucket_keys()).alias("key"))
    keyed = each(sketched)
    sample = sketched.where(F.pmod(F.xxhash64("s1", "s2"), F.lit(SAMPLED)) == 0)
    hot = checkpointed(each(sample).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).select("key", (F.ceil(F.col("n") / HOT) + 1).cast("int").alias("blocks")))
    if n_hot := hot.count():
        own = F.pmod(F.xxhash64("s2", "s1"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.xxhash64("key", F.least(t, own), F.greatest(t, own)))
        place = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)
        keyed = keyed.join(F.broadcast(hot) if n_hot <= MAX_SENT else hot, "key", "left").select("s1", "s2", F.explode(place).alias("key"))
    agree = (1 + least) / 2
    floor = _BITS * agree - 3 * (_BITS * agree * (1 - agree)) ** 0.5
    differ = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    once = (F.col("x.s1") < F.col("y.s1")) | ((F.col("x.s1") == F.col("y.s1")) & (F.col("x.s2") < F.col("y.s2")))
    met = keyed.alias("x").join(keyed.alias("y"), (F.col("x.key") == F.col("y.key")) & once & (differ <= int(_BITS - floor)))
    return met.select(F.col("x.s1").alias("a1"), F.col("x.s2").alias("a2"), F.col("y.s1").alias("b1"), F.col("y.s2").alias("b2")).distinct()


def _resembling(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """``pairs`` (``a``, ``b``: nodes of texts that share a bucket) whose sketches agree in no fewer coordinates than four standard deviations
    under what texts at the limit do. The coordinates that a mask keeps agree in any case."""
    kept, agree = (VECTORS + 1) // 2 * PER_VECTOR, least + (1 - least) / 256
    floor = kept + (_SPOTS - kept) * agree - 4 * ((_SPOTS - kept) * agree * (1 - agree)) ** 0.5
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    picked = prints.join(F.broadcast(wanted) if wanted.count() <= MAX_SENT else wanted, "node", "left_semi")
    end = lambda x: picked.select(F.col("node").alias(x), *[F.col(c).alias(x + c) for c in _LONGS])
    # A long holds 7 coordinates of a byte. One bit is left of each byte that differs.
    low, high = 0x7F7F7F7F7F7F7F, 0x80808080808080
    apart = []
    for c in _LONGS:
        x = F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))
        apart.append(F.bit_count((x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high))))
    return pairs.join(end("a"), "a").join(end("b"), "b").where(sum(apart[1:], apart[0]) <= int(_SPOTS - floor)).select("a", "b")


def _verified(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            like = [likeness(a, b) for a, b in zip(pdf["ta"], pdf["tb"], strict=True)]
            keep = [j >= least and form_of(a) != form_of(b) for j, a, b in zip(like, pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.assign(likeness=like)[keep][["a", "b", "likeness"]]

    return run


def alike_nodes(texts: DataFrame, least: float = 0.75, min_chars: int = 300) -> tuple[DataFrame, DataFrame]:
    """Pairs and members of alike texts.

    ``texts`` has ``node`` (bigint, unique), ``kind`` (int; only texts of one kind are compared) and ``text``. Null texts
    and texts under ``min_chars`` characters take no part; an empty table gives empty results.

    Returns ``links`` (``a``, ``b``, ``likeness``) between the smallest nodes of different written forms, and ``members``
    (``node``, ``form``): each text's written form, named by its smallest node. Copies are never expanded into pairs here.
    """
    long = texts.where(F.length("text") >= min_chars).select("node", F.col("kind").cast("int").alias("kind"), "text")
    types = ", ".join(f"{c} bigint" for c in (*_LONGS, "s1", "s2", "f1", "f2", "w"))
    prints = checkpointed(spread(long).mapInPandas(_sketch_batches, f"node bigint, kind int, {types}"))
    forms = checkpointed(prints.groupBy("kind", "f1", "f2", "w").agg(F.min("node").alias("form"), F.first("s1").alias("s1"), F.first("s2").alias("s2")))
    met = _meetings(prints.select("kind", *_LONGS, "s1", "s2").distinct(), least)
    # Written forms of one sketch resemble each other as well.
    same = forms.groupBy("kind", "s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpointed(met.unionByName(same.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("s1").alias("b1"), F.col("s2").alias("b2")).distinct()))
    end = lambda x: forms.select("kind", *[F.col(c).alias(f"{x}{c[1:]}") for c in ("s1", "s2")], F.col("form").alias(x), F.col("f1").alias(f"{x}f1"), F.col("f2").alias(f"{x}f2"))
    told = met.join(end("a"), ["a1", "a2"]).join(end("b"), ["kind", "b1", "b2"]).where("af1 <> bf1 or af2 <> bf2")
    pairs = checkpointed(told.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = checkpointed(_resembling(pairs, prints, least))
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # The texts are by far the widest rows: up to a checked number of wanted nodes they are picked where they lie.
    picked = F.broadcast(wanted) if wanted.count() <= MAX_SENT else wanted
    needed = long.join(picked, "node", "left_semi").select("node", "text")
    told = pairs.join(needed.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(needed.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    links = told.select("a", "b", "ta", "tb").mapInPandas(_verified(least), "a bigint, b bigint, likeness double")
    return links, prints.select("node", "kind", "f1", "f2", "w").join(forms.select("kind", "f1", "f2", "w", "form"), ["kind", "f1", "f2", "w"]).select("node", "form")


def alike_pairs(texts: DataFrame, least: float = 0.75, min_chars: int = 300) -> DataFrame:
    """Every pair (``a``, ``b``) of nodes that are alike, copies expanded."""
    links, members = alike_nodes(texts, least, min_chars)
    links = checkpointed(links)
    ends = members.select(F.col("node").alias("na"), F.col("form").alias("a")), members.select(F.col("node").alias("nb"), F.col("form").alias("b"))
    full = links.join(ends[0], "a").join(ends[1], "b")
    return full.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))


def groups(texts: DataFrame, least: float = 0.75, min_chars: int = 300) -> DataFrame:
    """One row a text of ``min_chars`` or more: ``node``, ``group`` (smallest node of its connected component) and
    ``links`` (written forms it is linked to). Labels spread and halve their paths, so that rounds grow with the logarithm of a component's width."""
    links, members = alike_nodes(texts, least, min_chars)
    links = checkpointed(links.select("a", "b"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    label = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        spread_label = both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("other"))
        nearer = label.join(spread_label, "a", "left").select("a", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        parent = label.select(F.col("a").alias("label"), F.col("label").alias("up"))
        step = checkpointed(nearer.join(parent, "label", "left").select("a", F.least("label", "up").alias("label"), "was"))
        label = step.select("a", "label")
        if step.where("label <> was").isEmpty():
            break
    known = label.join(degree, "a").select(F.col("a").alias("form"), "label", "links")
    return members.join(known, "form", "left").select("node", F.coalesce("label", "form").alias("group"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
