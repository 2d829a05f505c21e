"""Problem 9: the subject areas of each document, by latent Dirichlet allocation.

Topics are fitted on all documents, with or without labels, by variational Bayes. A first, small topic model over the commonest
terms parts the documents into groups of one language each. Groups that share their commonest terms are one language. The
vocabulary goes by frequency alone, counted over all documents: a group's terms in at least ``LEAST_USES`` sentences, without
those that more than ``COMMON`` of some group's sentences and more than ``BROAD`` of their language's documents use, so that the
words of which all sentences are made play no part. For each group ``STARTS`` topic models of ``TOPICS`` topics are fitted, each
topic starting from one random document. Both models begin with some documents only (``MAX_FIT``, ``MAX_PARTING``), for a start near
the end; then come passes over all documents, in which what a topic holds is summed up over all of them and nothing of the
start is kept.

Labels serve only to read topics: a topic stands for the subject for which its top terms speak in labelled documents (all of
them), if they agree; topics whose terms speak for two subjects are left out, all others are background. Topics that stand for one subject are added up, as are
those of the background. A sentence treats the subject that holds most of its topic proportions, and a document treats each subject that a
quarter of its sentences treat. Every document is assigned.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import checkpointed, spread

#: Documents that topics start with, and those that the parting of languages starts with; then passes over all documents.
MAX_FIT = 4000
MAX_PARTING = 1500
PASSES = 2
PARTING_PASSES = 3
#: Labelled documents are sent to all tasks up to this number; beyond it they are joined.
MAX_SENT = 1_000_000
#: Terms of one group's model.
MAX_TERMS = 20_000
LEAST_USES = 5
COMMON = 0.1
BROAD = 0.4
GROUPS = 10
TOPICS = 32
#: Each start misses other subjects of a language, so there are several; models of a few of them are in memory at once.
STARTS = 8
STARTS_AT_ONCE = 2
ROUNDS = 20
TOP_TERMS = 15
#: Documents assigned at once.
_SLICE = 500
ALPHA = 0.05
ETA = 0.02
#: Prior of a sentence's proportions at assignment, where topics are already read as subjects.
ASSIGN_ALPHA = 0.01
_SENTENCE = re.compile(r"([.!?。！？])(?:\s+|(?=[^\s.!?。！？\d\"'”’»)]))|\n+")
_PLAIN = re.compile("[a-z]{2,}")
_HAN = re.compile("[㐀-鿿]")
_TERM = re.compile(r"[㐀-鿿]+|[^\W\d_]{2,}")


def sentences(text: str | None) -> list[str]:
    """Sentences with at least one letter or digit."""
    return [s for s in _SENTENCE.sub(r"\1\n", text).split("\n") if s and (s[0].isalnum() or any(map(str.isalnum, s)))] if text else []


def terms(sentence: str) -> list[str]:
    if sentence.isascii():
        return _PLAIN.findall(sentence.lower())
    words = _TERM.findall(sentence.lower())
    if not _HAN.search(sentence):
        return words
    out = []
    for w in words:
        if w[0] >= "㐀" and w[0] <= "鿿":
            out += [w[k : k + 2] for k in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 3
    return -1 / x - 1 / (x + 1) - 1 / (x + 2) + np.log(y) - 1 / (2 * y) - 1 / (12 * y * y)


def topics(bags: list[dict[int, int]], n_terms: int, k: int, seed: int, rounds: int) -> np.ndarray:
    """Dirichlet parameters (terms x topics) of ``k`` topics, by variational Bayes; each topic starts from one random bag."""
    rng = np.random.default_rng(seed)
    bags = [b for b in bags if b]
    lam = (0.1 + 0.1 * rng.random((n_terms, k))).astype(np.float32)
    if not bags:
        return lam
    index = np.fromiter((t for b in bags for t in b), np.int64)
    count = np.fromiter((n for b in bags for n in b.values()), np.float32)
    sizes = np.fromiter(map(len, bags), np.int64, len(bags))
    owner, begin = np.repeat(np.arange(len(bags)), sizes), np.cumsum(sizes) - sizes
    for j, x in enumerate(rng.integers(0, len(bags), k)):
        lam[list(bags[x]), j] += np.fromiter(bags[x].values(), np.float32)
    gamma = np.ones((len(bags), k), np.float32)
    for _ in range(rounds):
        beta = np.exp(_digamma(lam) - _digamma(lam.sum(0)))[index]
        for _ in range(2):  # gamma goes on from the round before
            part = np.exp(_digamma(gamma) - _digamma(gamma.sum(1, keepdims=True)))[owner]
            part *= beta
            part *= (count / np.maximum(part.sum(1), 1e-30))[:, None]
            gamma = ALPHA + np.add.reduceat(part, begin, axis=0)
        for j in range(k):
            lam[:, j] = np.bincount(index, part[:, j], n_terms) + ETA
    return lam


def _parting(counts: np.ndarray) -> np.ndarray:
    """Rates (terms x GROUPS) of topics that tell languages apart, from some documents (rows)."""
    rng = np.random.default_rng(1)
    n = counts.shape[1]
    phi = rng.dirichlet(np.ones(n), GROUPS).T if n else np.zeros((0, GROUPS))
    theta = np.full((len(counts), GROUPS), 1 / GROUPS)
    for _ in range(30 if len(counts) and n else 0):
        ratio = counts / np.maximum(theta @ phi.T, 1e-12)
        theta, phi = theta * (ratio @ phi) + 0.1, phi * (ratio.T @ theta) + 0.01
        theta, phi = theta / theta.sum(1, keepdims=True), phi / phi.sum(0)
    return phi


def _languages(used: np.ndarray) -> list[int]:
    """The language of each group. ``used``: the share of the group's documents that use a term (groups x terms)."""
    language = list(range(GROUPS))
    for g in range(GROUPS):
        for h in range(g):
            if np.minimum(used[g], used[h]).sum() > 0.3 * min(used[g].sum(), used[h].sum()):
                language = [language[h] if x == language[g] else x for x in language]
    return language


def _shares(phi: np.ndarray, index: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group proportions of documents, and each known term's parts; documents without a known term have all the same."""
    theta = np.full((len(sizes), GROUPS), 1 / GROUPS, np.float32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return theta, np.zeros((0, GROUPS))
    s = sizes[full]
    owner, begin = np.repeat(np.arange(len(full)), s), np.cumsum(s) - s
    like, own = phi.astype(np.float32)[index], theta[full]
    for _ in range(10):
        part = like * own[owner]
        part *= (count / np.maximum(part.sum(1), 1e-30))[:, None]
        own = 0.1 + np.add.reduceat(part, begin, axis=0)
        own /= own.sum(1, keepdims=True)
    theta[full] = own
    return theta, part


def _posterior(phi: np.ndarray, index: np.ndarray, owner: np.ndarray, begin: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Topic proportions of n sentences. ``begin`` marks the tokens' first positions, none empty."""
    like = phi[index]
    theta = np.full((n, phi.shape[1]), 1.0 / phi.shape[1], np.float32)
    for _ in range(rounds):
        part = like * theta[owner]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        theta = ASSIGN_ALPHA + np.add.reduceat(part, begin, axis=0)
        theta /= theta.sum(1, keepdims=True)
    return theta


class Model:
    """Terms, topics (terms x topics) and the subject of each topic (None for background)."""

    def __init__(self, vocabulary: dict[str, int], phi: np.ndarray, subject_of: list[str | None], top_terms: list[list[str]]):
        self.vocabulary, self.phi, self.subject_of, self.top_terms = vocabulary, phi.astype(np.float32), subject_of, top_terms


def _bags(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[list[list[int]], np.ndarray]:
    """Known terms of every sentence, and the text that each sentence is from."""
    get, bags, owner = vocabulary.get, [], []
    for k, text in enumerate(texts):
        for s in sentences(text):
            bags.append([i for t in terms(s) if (i := get(t)) is not None])
            owner.append(k)
    return bags, np.array(owner, np.int64)


class _Docs:
    """Documents as arrays: for each ``ids``, ``first`` (1: the parting starts with it, 2: topics start with it, 3: both), its sentences and number of
    different terms (``said``, ``sizes``); for each of these the ``term``, how often it stands there and in how many sentences (``count``, ``uses``)."""

    def __init__(self, *arrays: np.ndarray):
        self.ids, self.first, self.said, self.sizes, self.term, self.count, self.uses = arrays

    def packed(self) -> bytes:
        small = (np.int64, np.int8, np.int32, np.int32, np.int32, np.uint16, np.uint16)
        arrays = (self.ids, self.first, self.said, self.sizes, self.term, np.minimum(self.count, 65535), np.minimum(self.uses, 65535))
        return pickle.dumps([np.asarray(a).astype(t) for a, t in zip(arrays, small, strict=True)])

    def of(self, docs: np.ndarray) -> _Docs:
        """Some of the documents, by a mask."""
        at = np.repeat(docs, self.sizes)
        return _Docs(self.ids[docs], self.first[docs], self.said[docs], self.sizes[docs], self.term[at], self.count[at], self.uses[at])

    def known(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms that have a number (not -1) by it, with their counts; how many each document has."""
        index = number[self.term]
        kept = index >= 0
        sizes = np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes)[kept], minlength=len(self.sizes))
        return index[kept], self.count[kept].astype(np.float32), sizes


def _docs(data: bytes) -> _Docs:
    return _Docs(*pickle.loads(data))


def _each(df: DataFrame, held: object, make: Callable, add: Callable, columns: str = "data") -> DataFrame:
    """(``key``, ``task``, ``data``): what each task adds up over its documents. ``make(value)`` gives the task's totals, by key; ``add(value, totals, row)`` adds to them."""
    sent = df.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = make(sent.value)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                add(sent.value, totals, row)
        for key, x in totals.items():
            yield pd.DataFrame({"key": [key], "task": [TaskContext.get().partitionId()], "data": [zlib.compress(pickle.dumps(x), 1)]})

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in pdf.sort_values("task")["data"]:
            x = pickle.loads(zlib.decompress(data))
            total = x if total is None else total + x
        return pd.DataFrame({"key": [key[0]], "data": [pickle.dumps(total)]})

    # What tasks hand on grows with their number, not with the documents: no more of them than keep the cores busy.
    few = df.select(*columns.split()).coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    return few.mapInPandas(run, "key int, task int, data binary").groupBy("key").applyInPandas(summed, "key int, data binary")


def _total(*args: object) -> dict[int, np.ndarray]:
    return {r[0]: pickle.loads(r[1]) for r in _each(*args).collect()}


def _counted_terms(texts: DataFrame, n: int) -> list[tuple[str, int, int]]:
    """Terms of all documents, with the number of sentences and of documents that use them; without those too rare for any vocabulary."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses, docs = Counter(), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                own = [set(terms(s)) for s in sentences(text)]
                uses.update(chain.from_iterable(own))
                docs.update(set().union(*own))
                if len(docs) > 500_000:
                    yield pd.DataFrame([(t, k, docs[t]) for t, k in uses.items()], columns=["term", "n", "d"])
                    uses, docs = Counter(), Counter()
        yield pd.DataFrame([(t, k, docs[t]) for t, k in uses.items()], columns=["term", "n", "d"])

    counted = spread(texts).mapInPandas(count, "term string, n bigint, d bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = counted.where((F.col("n") >= LEAST_USES) | (F.col("d") >= 0.03 * n)).toPandas().sort_values("term")
    return list(kept.itertuples(index=False, name=None))


def _read(texts: DataFrame, number: dict[str, int]) -> DataFrame:
    """``data``: all documents as arrays of numbered terms."""
    held = texts.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = held.value.get
        for pdf in (pdf.iloc[k : k + 2000] for pdf in batches for k in range(0, len(pdf), 2000)):
            said, sizes, term, count, uses = [], [], [], [], []
            for text in pdf["text"]:
                each = [list(map(get, terms(s))) for s in sentences(text)]
                often, used = Counter(chain.from_iterable(each)), Counter(chain.from_iterable(map(set, each)))
                often.pop(None, None)
                said.append(len(each))
                sizes.append(len(often))
                term += often
                count += often.values()
                uses += map(used.__getitem__, often)
            yield pd.DataFrame({"data": [_Docs(pdf["doc_id"].to_numpy(), pdf["first"].to_numpy(), said, sizes, term, count, uses).packed()]})

    return checkpointed(spread(texts).mapInPandas(run, "data binary"))


def _apart(blocks: DataFrame, n_terms: int, parting: np.ndarray) -> DataFrame:
    """``grp``, ``data``: the documents by group. ``parting``: the terms that part languages."""
    number = np.full(n_terms, -1)
    number[parting] = np.arange(len(parting))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"data": [d.of(d.first & 1 > 0).packed() for d in map(_docs, pdf["data"])]})

    start, ids = [np.zeros((0, len(parting)), np.float32)], [np.zeros(0, np.int64)]
    for (data,) in blocks.mapInPandas(some, "data binary").collect():
        docs = _docs(data)
        index, count, sizes = docs.known(number)
        dense = np.zeros((len(sizes), len(parting)), np.float32)
        dense[np.repeat(np.arange(len(sizes)), sizes), index] = np.log1p(count)
        start.append(dense)
        ids.append(docs.ids)
    phi = _parting(np.concatenate(start)[np.argsort(np.concatenate(ids), kind="stable")])

    def add(value: tuple, totals: dict, row: tuple) -> None:
        index, count, sizes = _docs(row.data).known(value[0])
        _, part = _shares(value[1], index, np.log1p(count), sizes)
        for j in range(GROUPS):
            totals[0][:, j] += np.bincount(index, part[:, j], len(value[1]))

    for _ in range(PARTING_PASSES if len(parting) else 0):
        got = _total(blocks, (number, phi), lambda v: {0: np.zeros(v[1].shape)}, add)
        phi = sum(got.values()) + 0.01
        phi /= phi.sum(0)
    held = blocks.sparkSession.sparkContext.broadcast((number, phi))

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for docs in map(_docs, pdf["data"]):
                index, count, sizes = docs.known(held.value[0])
                own = np.where(sizes > 0, _shares(held.value[1], index, np.log1p(count), sizes)[0].argmax(1), 0)
                kept = np.unique(own)
                yield pd.DataFrame({"grp": kept, "data": [docs.of(own == g).packed() for g in kept]})

    return checkpointed(blocks.mapInPandas(grouped, "grp int, data binary"))


def _chosen(parts: DataFrame, counted: list[tuple[str, int, int]], parting: np.ndarray) -> dict[int, np.ndarray]:
    """The terms of each group's model, the most used first."""
    n = len(counted)

    def add(_: object, totals: dict, row: tuple) -> None:
        docs = _docs(row.data)
        own = totals.setdefault(row.grp, np.zeros(2 * n + 2))
        own[:n] += np.bincount(docs.term, docs.uses, n)
        own[n : 2 * n] += np.bincount(docs.term, minlength=n)
        own[2 * n :] += docs.said.sum(), len(docs.ids)

    got = _total(parts, None, lambda _: {}, add, "grp data")
    used = np.zeros((GROUPS, len(parting)))
    for g, x in got.items():
        used[g] = x[n : 2 * n][parting] / max(x[-1], 1)
    language = _languages(used)
    often, broad = np.zeros(n, bool), np.zeros(n, bool)
    for x in got.values():
        often |= x[:n] > COMMON * x[-2]
    for tongue in set(language):
        own = [x for g, x in got.items() if language[g] == tongue]
        if own:
            broad |= sum(x[n : 2 * n] for x in own) > BROAD * sum(x[-1] for x in own)
    out = {}
    for g, x in got.items():
        at = np.flatnonzero((x[:n] >= LEAST_USES) & ~(often & broad))
        out[g] = at[np.argsort(-x[at], kind="stable")][:MAX_TERMS]
    return out


def _fit_groups(parts: DataFrame, chosen: dict[int, np.ndarray], n_terms: int, rounds: int) -> dict[tuple[int, int], np.ndarray]:
    """The topics of every group and start: Dirichlet parameters (the group's terms x topics)."""
    number = np.full((GROUPS, n_terms), -1, np.int32)
    for g, at in chosen.items():
        number[g, at] = np.arange(len(at))
    sizes = {g: len(chosen.get(g, ())) for g in range(GROUPS)}
    held = parts.sparkSession.sparkContext.broadcast(number)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"grp": pdf["grp"], "data": [d.of(d.first & 2 > 0).packed() for d in map(_docs, pdf["data"])]})

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grp, start = map(int, key)
        bags: dict[int, dict[int, int]] = {}
        for docs in map(_docs, pdf["data"]):
            index, count, own = docs.known(held.value[grp])
            end = np.cumsum(own)
            for i, a, b in zip(docs.ids.tolist(), (end - own).tolist(), end.tolist(), strict=True):
                bags[i] = dict(zip(index[a:b].tolist(), count[a:b].tolist(), strict=True))
        lam = topics([bags[i] for i in sorted(bags)], sizes[grp], TOPICS, grp + 100 * start, rounds)
        return pd.DataFrame({"grp": [grp], "start": [start], "data": [lam.astype(np.float32).tobytes()]})

    first = checkpointed(parts.mapInPandas(some, "grp int, data binary"))

    def add(value: dict, totals: dict, row: tuple) -> None:
        docs = _docs(row.data)
        index, count, own = docs.known(held.value[row.grp])
        full = own[own > 0]
        if not len(full):
            return
        owner, begin = np.repeat(np.arange(len(full)), full), np.cumsum(full) - full
        for start in sorted(s for g, s in value if g == row.grp):
            beta = value[row.grp, start][index]
            gamma = np.ones((len(full), TOPICS), np.float32)
            for _ in range(3):
                part = np.exp(_digamma(gamma) - _digamma(gamma.sum(1, keepdims=True))).astype(np.float32)[owner]
                part *= beta
                part *= (count / np.maximum(part.sum(1), 1e-30))[:, None]
                gamma = ALPHA + np.add.reduceat(part, begin, axis=0)
            total = totals.setdefault(row.grp * STARTS + start, np.zeros((sizes[row.grp], TOPICS), np.float32))
            for j in range(TOPICS):
                total[:, j] += np.bincount(index, part[:, j], len(total))

    out = {}
    for begin in range(0, STARTS, STARTS_AT_ONCE):
        each = first.select("*", F.explode(F.sequence(F.lit(begin), F.lit(min(begin + STARTS_AT_ONCE, STARTS) - 1))).alias("start"))
        apart = each.repartition(GROUPS * STARTS_AT_ONCE, "grp", "start")  # so that small groups are not put into one task
        rows = apart.groupBy("grp", "start").applyInPandas(one, "grp int, start int, data binary").collect()
        lams = {(r[0], r[1]): np.frombuffer(r[2], np.float32).reshape(-1, TOPICS) for r in rows if sizes[r[0]]}
        for _ in range(PASSES if rounds else 0):
            beta = {k: np.exp(_digamma(lam) - _digamma(lam.sum(0))).astype(np.float32) for k, lam in lams.items()}
            got = _total(parts, beta, lambda _: {}, add, "grp data")
            lams |= {(k // STARTS, k % STARTS): x + ETA for k, x in got.items()}
        out |= lams
    return out


def _rates(labelled: DataFrame, vocabulary: dict[str, int]) -> pd.DataFrame:
    """(``subject``, ``term``, ``n``): sentences of documents of a subject that use a term, a document of several counting in parts; ``term`` '' counts sentences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: Counter = Counter()
            for text, subjects in zip(pdf["text"], pdf["subjects"], strict=True):
                own = sorted(set(subjects) - {"none"}) or [""]
                for s in sentences(text):
                    for t in {*(t for t in terms(s) if t in vocabulary), ""}:
                        for subject in own:
                            total[subject, t] += 1 / len(own)
            yield pd.DataFrame([(s, t, n) for (s, t), n in total.items()], columns=["subject", "term", "n"])

    return spread(labelled).mapInPandas(count, "subject string, term string, n double").groupBy("subject", "term").agg(F.sum("n").alias("n")).toPandas()


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int | None = None, rounds: int = ROUNDS) -> Model:
    """Fit topics on all documents and read them by the labelled ones: all, or at most ``max_labelled``, chosen by a hash of their id, if asked to.

    Without documents or labels the model has no subject.
    """
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    by_doc = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    known = checkpointed(by_doc if max_labelled is None else by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    n, n_known = texts.count(), known.count()
    nothing = Model({}, np.zeros((0, 1)), [None], [[]])
    if not n or not n_known:
        return nothing
    counts = _counted_terms(texts, n)
    place = F.xxhash64("doc_id", F.lit(9)).bitwiseAND(F.lit(0xFFFFFFFF)) / float(1 << 32)
    first = (place < MAX_PARTING / n).cast("int") + (place < MAX_FIT / n).cast("int") * 2
    blocks = _read(texts.withColumn("first", first), {t: k for k, (t, _, _) in enumerate(counts)})
    parting = np.array([k for k, (_, _, d) in enumerate(counts) if d >= 0.03 * n], np.int64)
    parts = _apart(blocks, len(counts), parting)
    chosen = _chosen(parts, counts, parting)
    fitted = _fit_groups(parts, chosen, len(counts), rounds)
    own = sorted({int(i) for at in chosen.values() for i in at})  # in the order of terms
    vocabulary = {counts[i][0]: k for k, i in enumerate(own)}
    if not vocabulary:
        return nothing
    counted = _rates(texts.join(F.broadcast(known) if n_known <= MAX_SENT else known, "doc_id"), vocabulary)
    names = sorted(set(counted["subject"]) - {""})
    column = {s: k for k, s in enumerate([*names, ""])}
    total, uses = np.zeros(len(column)), np.zeros((len(vocabulary), len(column)))
    for subject, term, k in counted.itertuples(index=False):
        if term:
            uses[vocabulary[term], column[subject]] = k
        else:
            total[column[subject]] = k
    rate = uses / np.maximum(total, 1e-9)
    speaks = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12)
    ordered = list(vocabulary)
    merged: dict[str | None, np.ndarray] = {}
    for (grp, _), lam in sorted(fitted.items()):
        at = np.searchsorted(own, chosen[grp])
        for j in range(TOPICS):
            weight = lam[:, j]
            top = np.argsort(-weight, kind="stable")[:TOP_TERMS]
            points = (speaks[at[top]] * weight[top, None]).sum(0) / weight[top].sum()
            best = int(points.argmax())
            subject = names[best] if best < len(names) and points[best] > 0.5 else None
            if subject is None and np.sort(points[: len(names)])[-2:].sum() > 0.6:
                continue  # two subjects in one topic
            np.add.at(merged.setdefault(subject, np.zeros(len(vocabulary))), at, weight)
    merged.setdefault(None, np.zeros(len(vocabulary)))
    keys = sorted(merged, key=lambda k: k or "")
    phi = np.stack([merged[k] + 1e-6 for k in keys], axis=1)
    phi /= phi.sum(0)
    tops = [[ordered[i] for i in np.argsort(-phi[:, j])[:TOP_TERMS]] for j in range(len(keys))]
    return Model(vocabulary, phi, keys, tops)


def assign(documents: DataFrame, model: Model, least: float = 0.25) -> DataFrame:
    """(``doc_id``, ``subject``, ``share``): the subjects that at least ``least`` of a document's sentences treat.

    Null or empty texts have no subject and no row; repeated rows give repeated results; an empty table gives an empty one.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        names = sorted({s for s in m.subject_of if s})
        column = np.array([names.index(s) if s else len(names) for s in m.subject_of], np.int64)
        for pdf in (pdf.iloc[k : k + _SLICE] for pdf in batches for k in range(0, len(pdf), _SLICE)):
            bags, owner = _bags(list(pdf["text"]), m.vocabulary)
            n_docs = len(pdf)
            if not len(bags) or not names:
                continue
            sizes = np.fromiter(map(len, bags), np.int64, len(bags))
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            index = np.fromiter((i for b in bags for i in b), np.int64, int(sizes.sum()))
            s = sizes[full]
            theta = _posterior(m.phi, index, np.repeat(np.arange(len(full)), s), np.cumsum(s) - s, len(full))
            by_subject = np.zeros((len(full), len(names) + 1))
            for j, c in enumerate(column):
                by_subject[:, c] += theta[:, j]
            subject = by_subject[:, :-1].argmax(1)
            clear = by_subject[np.arange(len(full)), subject] >= 0.5
            counts = np.bincount(owner[full[clear]] * len(names) + subject[clear], minlength=n_docs * len(names)).reshape(n_docs, len(names))
            share = counts / np.maximum(np.bincount(owner, minlength=n_docs), 1)[:, None]
            d, c = np.nonzero(share >= least)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject": [names[x] for x in c], "share": share[d, c]})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, subject string, share double")


def composition(assigned: DataFrame, documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """``subject, documents, document_share, characters, character_share`` for each subject of ``subjects``; shares may overlap."""
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    total = sizes.agg(F.count(F.lit(1)).alias("all_docs"), F.sum("chars").alias("all_chars"))
    got = assigned.select("doc_id", "subject").distinct().join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("characters"))
    out = subjects.select("subject").join(got, "subject", "left").na.fill(0).join(F.broadcast(total))  # one row
    return out.select("subject", "documents", (F.col("documents") / F.col("all_docs")).alias("document_share"), "characters", (F.col("characters") / F.col("all_chars")).alias("character_share"))
