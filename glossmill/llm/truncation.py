"""Problem 4: texts that stop before their end.

A logistic regression over hashed features of a text's closing (last characters, words and punctuation, what is put at a
cut's end, how the last words behave elsewhere: at sentence ends or inside, as whole words or not) and of its distance to
lengths at which unusually many texts of its kind stop. It is trained on intact values and on values cut on purpose: at
those lengths, at byte limits, and anywhere. Intact values without their final stop are trained as intact.

All different texts are trained on, whole, in shards of about ``SHARD``: in each of ``ROUNDS`` rounds every shard goes on from
the weights of the round before, and each weight becomes the mean of the shards', by how often they met its feature. Words and
runs of words are counted over all different texts, lengths and recurring last lines over all records. Counts are kept by
hash, in a fixed number of ``PLACES``, as weights are in ``DIM``: runs that share a place add up.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.session import checkpointed, spread

#: Different texts that are trained on in one task.
SHARD = 50_000
ROUNDS = 3
#: Steps of a shard in a round, at least; examples of a step; passes over the shard, at least.
STEPS = 60
BATCH = 4096
EPOCHS = 3
DIM = 1 << 18
PLACES = 1 << 24
#: Weights and counts are summed up in so many parts.
_PARTS = 64
TAIL = 80
#: Last lines (or whole texts) of at most this length that recur are known to be whole.
END_CHARS = 60
#: They are sent to all tasks up to this number; beyond it they are joined.
MAX_SENT = 2_000_000
_MARK = re.compile(r"\s*(\.\.\.+|…|\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|�+)$")
_MARK_ENDS = ("...", "…", "]", ")", "）", "�")
_STOP = ".!?。！？။"
_STOPS = frozenset(_STOP)
_INSIDE = re.compile(r"[.!?。！？။]\s*\S")
#: What stands between stops, and its stop; without one it is no sentence. (With a stop that must be there a long text without any is read again from each character.)
_SENTENCE = re.compile(r"([^.!?。！？။\n]+)([.!?。！？။]?)")
_WORDS = re.compile(r"[^\W_]+")
_CLOSERS = "\"'”’»)]」』）"
_SPACELESS = re.compile(r"[㐀-鿿぀-ヿက-႟]")
#: Two or more ``label: value`` fields: such a text ends without a stop.
_FIELDS = r"^\s*[^:;|\n]{1,40}:[^;|\n]+[;|\n]\s*[^:;|\n]{1,40}:[^;|\n]+"
_fields = re.compile(_FIELDS)


def _split_mark(text: str) -> tuple[str, str]:
    """The text without what was put at its end, and the kind of that mark ('' for none)."""
    text = text.rstrip()
    m = _MARK.search(text) if text.endswith(_MARK_ENDS) else None
    return (text[: m.start()].rstrip(), m[1][0] + m[1][-1]) if m else (text, "")


#: ASCII in lower case, blanks for all but letters and digits.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def _units(s: str) -> list[str]:
    """Words, or single characters in scripts without blanks."""
    if s.isascii():
        return s.encode().translate(_PLAIN).decode().split()
    s = s.lower()
    return list("".join(s.split())) if _SPACELESS.search(s) else _WORDS.findall(s)


class _Codes(dict):
    """A word's code, kept."""

    def __missing__(self, word: str) -> int:
        self[word] = code = crc32(word.encode("utf-8", "surrogatepass"))
        return code


_code = _Codes()
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_SALT, _MIX, _ALL = 0xA24BAED4963EE407, 0x94D049BB133111EB, (1 << 64) - 1


def _last(words: list[str]) -> list[int]:
    """Codes of the last four words, the last one first; -1 where there are not as many."""
    out = [_code[w] for w in words[:-5:-1]]
    return out + [-1] * (4 - len(out))


def _placed(last: list[list[int]]) -> np.ndarray:
    """Where the last word by itself and the last 1 to 4 words, one run each, of each row of ``_last`` are counted; -1 where there are not as many words."""
    codes = np.fromiter(chain.from_iterable(last), np.int64, 4 * len(last)).reshape(-1, 4)
    out, h = np.full((len(codes), 5), -1, np.int32), np.zeros(len(codes), np.uint64)
    place = lambda x: (((x ^ (x >> np.uint64(29))) * np.uint64(_MIX)) >> np.uint64(40)).astype(np.int32)
    for n in (1, 2, 3, 4):
        there = codes[:, n - 1] >= 0
        h += codes[:, n - 1].astype(np.uint64) * np.uint64(_STEP[n - 1])
        out[there, n] = place(h[there] + np.uint64(n * _SALT & _ALL))
        if n == 1:
            out[there, 0] = place(h[there])
    return out


def _places(words: list[str]) -> list[int]:
    return _placed([_last(words)])[0].tolist()


class Counts:
    """How words behave inside the whole sentences of one task's texts: ``final`` at their ends, ``inner`` inside (and single words anywhere)."""

    def __init__(self) -> None:
        self.final, self.inner = np.zeros(PLACES, np.uint32), np.zeros(PLACES, np.uint32)
        self.codes: list[int] = []
        self.sizes: list[int] = []

    def learn(self, text: str) -> None:
        for sentence, stop in _SENTENCE.findall(text):
            u = _units(sentence) if stop else None
            if u:
                self.codes += map(_code.__getitem__, u)
                self.sizes.append(len(u))
        if len(self.codes) > 500_000:
            self.add_up()

    def add_up(self) -> None:
        if len(_code) > 1_000_000:
            _code.clear()
        if not self.codes:
            return
        c, sizes = np.array(self.codes, np.uint64), np.array(self.sizes, np.int64)
        self.codes, self.sizes = [], []
        end = np.cumsum(sizes)
        at = np.arange(len(c)) - np.repeat(end - sizes, sizes)
        last = np.zeros(len(c), bool)
        last[end - 1] = True
        h = np.zeros(len(c), np.uint64)
        place = lambda x: (((x ^ (x >> np.uint64(29))) * np.uint64(_MIX)) >> np.uint64(40)).astype(np.int64)
        for n in (1, 2, 3, 4):
            h[n - 1 :] += c[: len(c) - n + 1] * np.uint64(_STEP[n - 1])
            if n == 1:
                np.add.at(self.inner, place(h), np.uint32(1))
            x, full = place(h + np.uint64(n * _SALT & _ALL)), at >= n - 1
            np.add.at(self.final, x[full & last], np.uint32(1))
            np.add.at(self.inner, x[full & ~last], np.uint32(1))

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """What was counted, by part."""
        self.add_up()
        size = PLACES // _PARTS
        for k in range(_PARTS):
            each = []
            for counts in (self.final, self.inner):
                own = counts[k * size : (k + 1) * size]
                held = np.flatnonzero(own)
                each += [np.diff(held, prepend=0).astype(np.uint32), own[held]]
            yield k, zlib.compress(pickle.dumps(each), 1)


def _summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The scales of one part of the places, over all tasks: 0 for what was seen once or never."""
    size = PLACES // _PARTS
    total = np.zeros((2, size), np.int64)
    for data in pdf["data"]:
        final_at, final_n, inner_at, inner_n = pickle.loads(zlib.decompress(data))
        total[0, np.cumsum(final_at, dtype=np.int64)] += final_n
        total[1, np.cumsum(inner_at, dtype=np.int64)] += inner_n
    scale = np.where(total > 1, np.log2(total + 1), 0).astype(np.uint8)
    return pd.DataFrame({"part": [key[0]], "data": [zlib.compress(scale.tobytes(), 1)]})


def _scale(n: int) -> int:
    return int(n + 1).bit_length() - 1


def _slot(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % DIM


class _Slots(dict):
    """Slots of features of few values, kept."""

    def __missing__(self, feature: str) -> int:
        self[feature] = at = _slot(feature)
        return at


_slots = _Slots()
_ENDS = (1, 2, 3, 4, 6, 8, 11, 15, 20, 30)
_E = crc32(b"e")

#: Slots of what counts tell, by script: of a word's scale, of a run's two scales, of the longest run known at ends.
_WORD = np.array([[_slot(f"w{s}{a}") for a in range(40)] for s in "ln"])
_RUN = np.array([[[[_slot(f"f{s}{n}{a}:{b}") for b in range(40)] for a in range(40)] for n in range(1, 5)] for s in "ln"])
_BEST = np.array([[_slot(f"b{s}{n}") for n in range(5)] for s in "ln"])


def _counted(places: np.ndarray, script: np.ndarray, final: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Six slots a row of what counts tell; DIM for none. ``script`` is -1 for texts that end in a stop, of which they tell nothing."""
    out = np.full((len(script), 6), DIM, np.int64)
    open_ = np.flatnonzero(script >= 0)
    p, s = places[open_], script[open_].astype(np.int64)
    f, g = final[p], inner[p]  # of place -1 anything: not read
    out[open_, 0] = _WORD[s, np.where(p[:, 0] >= 0, g[:, 0], 0)]
    best = np.zeros(len(open_), np.int64)
    for n in (1, 2, 3, 4):
        there = p[:, n] >= 0
        out[open_, n] = np.where(there, _RUN[s, n - 1, f[:, n], g[:, n]], DIM)
        best[there & (f[:, n] > 0)] = n
    out[open_, 5] = _BEST[s, best]
    return out


def _ends_plainly(text: str) -> bool:
    """The text ends in a stop that is no mark."""
    return text[-1:] in _STOPS and not text.endswith("...")


def features(tail: str, chars: int, bytes_: int, inner: bool, fields: bool, known: bool, spikes: dict, kind: int) -> tuple[list[int], list[int], int]:
    """Slots of one text's features, codes of its last words, and its script (1 without blanks, 0 other, -1: ends in a stop). ``tail`` is its end (up to TAIL characters), ``inner`` whether a sentence ends before it,
    ``fields`` whether the text is made of labelled fields, ``known`` whether its last line recurs."""
    if _ends_plainly(tail):
        return [_slots[f"stop{tail[-1]}"], _slots["stop"]], _NOWHERE, -1
    body, mark = _split_mark(tail)
    cut_off = len(tail.rstrip()) - len(body)
    closed = body.rstrip(_CLOSERS)
    if not mark and closed and closed[-1] in _STOP:
        return [_slots[f"stop{closed[-1]}"], _slots["stop"]], _NOWHERE, -1
    stopped = bool(closed) and closed[-1] in _STOP
    low = (closed.rstrip(_STOP) if stopped else body).lower()
    script = "n" if not low.isascii() and _SPACELESS.search(low[-12:]) else "l"
    last = low[-1:] or " "
    line = re.sub(r"\d+", "0", low.rsplit("\n", 1)[-1].strip()) if "\n" in low else ""
    slots = _slots
    near = 0
    if spikes:
        get, key = spikes.get, (kind, script)
        near = max(get((*key, "c", chars - cut_off), 0), get((*key, "c", chars), 0), get((*key, "b", bytes_ - cut_off), 0), get((*key, "b", bytes_), 0))
    out = [
        slots[f"m{mark}"], slots[f"F{fields}{bool(mark)}"], slots[f"s{stopped}{bool(mark)}"], slots["c" + script],
        slots["k" + (last if not last.isalnum() else "d" if last.isdigit() else "a")],
    ]
    if last.isdigit():
        out.append(slots["list" if re.search(r"[.。]\s*\d+(?:, ?\d+)*$", low) else "number"])
    ends = _ENDS if len(low) >= _ENDS[-1] else [n for n in _ENDS if len(low) >= n]
    if low.isascii():
        end = low.encode()
        out += [crc32(end[-n:], _E) % DIM for n in ends]
    else:
        out += [crc32(low[-n:].encode("utf-8", "surrogatepass"), _E) % DIM for n in ends]
    out += [_slot(f"L{line}") if line else slots["L"], slots[f"n{bool(line)}"], slots[f"K{known}{bool(mark)}"], slots[f"u{script}{inner}{_scale(chars)}"], slots[f"p{near}{bool(mark)}"]]
    return out, _last(_units(low)), int(script == "n")


_NOWHERE = [-1] * 4


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(lengths.sum())), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


class _Block:
    """Examples: slots (flat), where each one's begin, last words and script for counts, label (0 whole, 1 cut, 2 not known) and weight."""

    def __init__(self) -> None:
        self.rows: list[tuple[list[int], list[int], int]] = []
        self.y: list[int] = []
        self.weight: list[int] = []

    def add(self, row: tuple[list[int], list[int], int], y: int, weight: int = 1) -> None:
        self.rows.append(row)
        self.y.append(y)
        self.weight.append(weight)

    def packed(self) -> bytes:
        index, begin = _flat([r[0] for r in self.rows])
        places = _placed([r[1] for r in self.rows])
        return pickle.dumps((index.astype(np.int32), begin.astype(np.int32), places, np.array([r[2] for r in self.rows], np.int8), np.array(self.y, np.int8), np.array(self.weight, np.float32)))


def _logits(w: np.ndarray, index: np.ndarray, begin: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """``w`` has a last slot of 0."""
    return np.add.reduceat(w[index], begin) + w[counted].sum(1) if len(begin) else np.zeros(0)


def _trained(blocks: list[tuple], counts: tuple[np.ndarray, np.ndarray], w: np.ndarray, g2: np.ndarray, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, squared gradients and how often each slot was met after a shard's steps of L2-regularised AdaGrad. ``first``: the weights by which
    texts of unknown state join the whole (under 0.35) or the cut ones (over 0.8); without it they take no part."""
    batches = []
    for index, begin, places, script, y, weight in blocks:
        counted, y = _counted(places, script, *counts), y.astype(float)
        unknown = y == 2
        if first is not None and unknown.any():
            p = 1 / (1 + np.exp(-_logits(first, index, begin, counted)))
            y[unknown & (p < 0.35)], y[unknown & (p > 0.8)] = 0, 1
        end = np.append(begin[1:], len(index))
        for k in range(0, len(begin), BATCH):
            kept = np.flatnonzero(y[k : k + BATCH] < 2) + k
            if len(kept):
                sizes = (end - begin)[kept]
                owner = np.repeat(np.arange(len(kept)), sizes)
                stop = np.cumsum(sizes)
                at = np.repeat(begin[kept] - stop + sizes, sizes) + np.arange(stop[-1])
                batches.append((index[at], stop - sizes, owner, counted[kept], y[kept], weight[kept]))
    met = np.zeros(DIM + 1)
    for index, _, _, counted, _, _ in batches:
        met += np.bincount(index, minlength=DIM + 1) + np.bincount(counted.ravel(), minlength=DIM + 1)
    w, g2 = w.copy(), g2.copy()
    for _ in range(max(EPOCHS, -(-STEPS // max(len(batches), 1))) if batches else 0):
        for index, begin, owner, counted, y, weight in batches:
            off = (1 / (1 + np.exp(-_logits(w, index, begin, counted))) - y) * weight / len(y)
            g = np.bincount(index, off[owner], DIM + 1) + np.bincount(counted.ravel(), np.repeat(off, 6), DIM + 1) + 2e-6 * w
            g2 += g * g
            w -= 0.35 * g / np.sqrt(g2)
            w[DIM] = 0
    return w, g2, met


def _mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of the weights and squared gradients: the shards' mean, by how often they met the slots; what none met stays."""
    w, g2, met = 0, 0, 0
    for data in pdf.sort_values("shard")["data"]:
        own = np.frombuffer(zlib.decompress(data), np.float32).reshape(3, -1).astype(float)
        w, g2, met = w + own[0] * (own[2] + 1e-6), g2 + own[1] * (own[2] + 1e-6), met + own[2] + 1e-6
    return pd.DataFrame({"part": [key[0]], "data": [np.stack([w / met, g2 / met]).tobytes()]})


def _round(examples: DataFrame, counts: object, w: np.ndarray, g2: np.ndarray, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All shards once."""
    held = examples.sparkSession.sparkContext.broadcast((w, g2, first))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [pickle.loads(x) for pdf in batches for x in pdf["data"]]
        if not blocks:
            return
        own = [x[:DIM].reshape(_PARTS, -1) for x in _trained(blocks, _tables(counts.value), *held.value)]
        data = [zlib.compress(np.stack([x[k] for x in own]).astype(np.float32).tobytes(), 1) for k in range(_PARTS)]
        yield pd.DataFrame({"part": range(_PARTS), "shard": TaskContext.get().partitionId(), "data": data})

    rows = examples.where("what = 'x'").select("data").mapInPandas(run, "part int, shard int, data binary").groupBy("part").applyInPandas(_mean, "part int, data binary").toPandas().sort_values("part")
    if rows.empty:
        return w, g2
    both = np.concatenate([np.frombuffer(x).reshape(2, -1) for x in rows["data"]], axis=1)
    held.unpersist()
    return np.append(both[0], 0), np.append(both[1], 1e-4)


def _tables(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Scales at ends and inside, by place."""
    return np.frombuffer(counts, np.uint8, PLACES), np.frombuffer(counts, np.uint8, PLACES, PLACES)


class Model:
    """Weights, scales of counts, length spikes, and the table of recurring last lines."""

    def __init__(self, weights: np.ndarray, counts: bytes, spikes: dict, ends: DataFrame):
        self.weights, self.counts, self.spikes, self.ends = weights, counts, spikes, ends

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ends"}

    def score(self, pdf: pd.DataFrame) -> np.ndarray:
        columns = (pdf[c] for c in ("tail", "chars", "bytes", "inner", "fields", "known", "kind"))
        rows = [features(t, c, b, i, f, e, self.spikes, k) for t, c, b, i, f, e, k in zip(*columns, strict=True)]
        if not rows:
            return np.zeros(0)
        index, begin = _flat([r[0] for r in rows])
        counted = _counted(_placed([r[1] for r in rows]), np.array([r[2] for r in rows], np.int8), *_tables(self.counts))
        return 1 / (1 + np.exp(-_logits(self.weights, index, begin, counted)))


def closings(texts: DataFrame) -> DataFrame:
    """What is known of a text for scoring: its end, its lengths, and whether a sentence ends inside it."""
    end = F.rtrim("text")
    return texts.where("text is not null and trim(text) <> ''").select(
        "*", F.substring(end, -TAIL, TAIL).alias("tail"), F.length(end).alias("chars"), F.octet_length(end).alias("bytes"), F.col("text").rlike(r"[.!?。！？။]\s*\S").alias("inner"), F.col("text").rlike(_FIELDS).alias("fields")
    )


def _spikes(closed: DataFrame) -> dict:
    """How much more often texts without a final stop end at a length than at its neighbours: 0 (not), 1 (twice) or 2 (4 times)."""
    body = F.regexp_replace("tail", r"\s*(?:\.\.\.+|…|\[\s*(?:\.\.\.|…)\s*\]|�+)$", "")
    open_ = ~F.regexp_replace(body, r"""["'”’»)\]」』）]+$""", "").rlike(r"[.!?。！？။]$")
    cut_off = F.length("tail") - F.length(body)
    script = F.when(body.rlike(r"[㐀-鿿぀-ヿက-႟][^\n]{0,11}$"), "n").otherwise("l")
    ends = closed.where(open_).select("kind", script.alias("script"), F.array(F.struct(F.lit("c").alias("unit"), (F.col("chars") - cut_off).alias("len")), F.struct(F.lit("b").alias("unit"), (F.col("bytes") - F.octet_length("tail") + F.octet_length(body)).alias("len"))).alias("x"))
    counted = ends.select("kind", "script", F.explode("x").alias("x")).groupBy("kind", "script", "x.unit", "x.len").agg(F.count(F.lit(1)).alias("n"))
    # A window holds 13 lengths; a partition, the different lengths of one kind, script and unit.
    near = Window.partitionBy("kind", "script", "unit").orderBy("len").rangeBetween(-6, 6)
    around = F.transform(F.filter(F.collect_list(F.struct("len", "n")).over(near), lambda x: x["len"] != F.col("len")), lambda x: x["n"])
    padded = F.array_sort(F.concat(around, F.array_repeat(F.lit(0).cast("bigint"), 12 - F.size(around))))
    usual = (F.element_at(padded, 6) + F.element_at(padded, 7)) / 2
    told = counted.withColumn("usual", usual).where((F.col("n") >= 8) & (F.col("n") >= 2 * (F.col("usual") + 1)))
    return {(r[0], r[1], r[2], r[3]): r[4] for r in told.select("kind", "script", "unit", "len", F.when(F.col("n") >= 4 * (F.col("usual") + 1), 2).otherwise(1)).collect()}


def _last_line() -> Column:
    """The letters of a text's last line where that is short and the text has several, or is short itself; else null."""
    last = F.regexp_extract("tail", r"([^\n]*)$", 1)
    short = (F.length(last) <= END_CHARS) & (F.contains("tail", F.lit("\n")) | (F.col("chars") <= END_CHARS))
    return F.when(short, F.nullif(F.regexp_replace(F.lower(last), r"[^\p{L}]+", ""), F.lit("")))


def _ends(closed: DataFrame) -> DataFrame:
    """``line``: the last lines, without a stop, that at least five texts of one source end with."""
    unstopped = closed.where(~F.regexp_extract("tail", r"([^\n]*)$", 1).rlike(r"[.!?。！？။…�\]]\s*$")).select("source", _last_line().alias("line")).where("line is not null")
    counted = unstopped.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    return checkpointed(counted.where("n >= 5").select("line").distinct())


def _with_known(closed: DataFrame, ends: DataFrame) -> DataFrame:
    """``known``: the text's last line is one of ``ends``."""
    found = ends.select("line", F.lit(True).alias("known"))
    joined = closed.withColumn("line", _last_line()).join(F.broadcast(found) if ends.count() <= MAX_SENT else found, "line", "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def _examples(spikes: dict, seed: int) -> Callable:
    """Of each text, by task: examples (``what`` x, as they come) and counts (c, by part at the end)."""
    limits = defaultdict(list)
    for kind, script, unit, length in sorted(spikes):
        if unit == "c":
            limits[kind, script].append(length)

    def of(text: str, kind: int, known: bool = False) -> tuple[list[int], list[int], int]:
        t = text.rstrip()
        if _ends_plainly(t):
            return features(t[-TAIL:], 0, 0, False, False, known, spikes, kind)
        size = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        return features(t[-TAIL:], len(t), size, bool(_INSIDE.search(t)), bool(_fields.match(t)), known, spikes, kind)

    def examples(kind: int, text: str, known: bool, out: _Block, rng: np.random.Generator) -> None:
        t = text.rstrip()
        body, mark = _split_mark(t)
        closed_body = body.rstrip(_CLOSERS)
        whole = not mark and closed_body and closed_body[-1] in _STOP
        if whole:
            out.add(of(t, kind, known), 0)
            out.add(of(closed_body.rstrip(_STOP), kind), 0)
        elif not mark:
            fields = _fields.match(t)
            if fields or known or re.search(r"[.。]\s*\d+, ?\d+$", t) or (len(body) < 45 and not re.search(r"[.!?。！？။]", body)):
                # Whole values that end in no stop are few: they weigh more.
                out.add(of(t, kind, known), 0, 12 if fields or not _INSIDE.search(t) else 3)
            else:
                out.add(of(t, kind, known), 2)
        if not whole or len(t) <= 12:
            return
        script = "n" if _SPACELESS.search(t[-12:]) else "l"
        fitting = [x for x in limits[kind, script] if x < len(t) - 1]
        for _ in range(2):
            if fitting and rng.random() < 0.5:
                at = fitting[rng.integers(len(fitting))]
            else:
                least = max(20 if script == "n" else 40, len(t) // 8)
                if least >= len(t) - 1:
                    continue
                at = int(rng.integers(least, len(t) - 1))
            piece = t[:at].rstrip()
            if not piece or piece[-1] in _STOP + _CLOSERS or piece == closed_body.rstrip(_STOP):
                continue
            style = rng.random()
            if style < 0.3:
                piece += ("…", "...", " …", " [...]", " ...", "[…]", "�")[rng.integers(7)]
            out.add(of(piece, kind), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, rng = None, np.random.default_rng([seed, TaskContext.get().partitionId()])
        for pdf in batches:
            counts, out = counts or Counts(), _Block()
            for kind, text, known in zip(pdf["kind"], pdf["text"], pdf["known"], strict=True):
                counts.learn(text)
                examples(kind, text, known, out, rng)
            if out.rows:
                yield pd.DataFrame({"what": ["x"], "part": [0], "data": [out.packed()]})
        if counts:
            parts = list(counts.parts())
            yield pd.DataFrame({"what": "c", "part": [k for k, _ in parts], "data": [x for _, x in parts]})

    return run


def train(texts: DataFrame, sample: int | None = None, seed: int = 11) -> Model:
    """Fit on all different texts, or on about ``sample`` of them, chosen by a hash of their wording, if asked to. ``texts`` has ``kind`` (int), ``source`` and ``text``."""
    closed = closings(texts.select("kind", "source", "text"))
    spikes = _spikes(closed)
    n = texts.count()
    ends = _ends(closed)
    if sample is not None:
        closed = closed.where(F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFF)) / float(0x1000000) < sample / max(n, 1))
    shards = max(1, -(-min(n, sample or n) // SHARD))
    different = _with_known(closed, ends).select("kind", "text", "known").repartition(shards, "text").groupBy("kind", "text").agg(F.max("known").alias("known"))
    mixed = different.sortWithinPartitions(F.xxhash64("kind", "text"), "kind", "text")
    examples = checkpointed(mixed.mapInPandas(_examples(spikes, seed), "what string, part int, data binary"))
    summed = examples.where("what = 'c'").groupBy("part").applyInPandas(_summed, "part int, data binary").toPandas().sort_values("part")
    scales = [np.frombuffer(zlib.decompress(x), np.uint8).reshape(2, -1) for x in summed["data"]]
    counts = np.concatenate(scales, axis=1).tobytes() if scales else bytes(2 * PLACES)
    held = texts.sparkSession.sparkContext.broadcast(counts)
    w, g2, first = np.zeros(DIM + 1), np.full(DIM + 1, 1e-4), None
    for k in range(ROUNDS):
        w, g2 = _round(examples, held, w, g2, first)
        first = w if k == 0 else first
    held.unpersist()
    return Model(w, counts, spikes, ends)


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """(``kind``, ``id``, ``source``, ``probability``, ``cut``) of every text that is not null or blank.

    ``texts`` has ``kind`` (int), ``id``, ``source`` and ``text``; an empty table gives an empty result, repeated rows repeat.
    """
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in batches:
            p = m.score(pdf)
            yield pd.DataFrame({"kind": pdf["kind"], "id": pdf["id"], "source": pdf["source"], "probability": p, "cut": p >= 0.5})

    ready = _with_known(closings(spread(texts.select("kind", "id", "source", "text"))), model.ends).select("kind", "id", "source", "tail", "chars", "bytes", "inner", "fields", "known")
    return ready.mapInPandas(run, "kind int, id bigint, source string, probability double, cut boolean")


def shares(scores: DataFrame) -> DataFrame:
    """``kind, source, texts, cut_texts, cut_share`` for each source; texts without a source are one group (null)."""
    g = scores.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts"))
    return g.withColumn("cut_share", F.col("cut_texts") / F.col("texts"))
