"""Problem 7: wording of held-out items inside corpus documents.

Corpus documents are cut into shards of bounded size; each shard gets a suffix array over all of its words, and every suffix
of every held-out item is binary-searched in it. The range of suffixes that share its first ``min_words`` words gives all
locations, each of which is followed to the end of its match for the longest verbatim one.

Words are numbered within a shard; documents end in numbers of their own, so that no match crosses them. Items are sent to
the tasks in blocks of bounded size, each searched in all shards, and the longest matches of all blocks are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import spread

_WORD = re.compile(r"\w+")
#: Words of a shard (a longer document is a shard of its own).
SHARD_WORDS = 1_000_000
#: Characters of items that are searched at once; more items make more blocks.
BLOCK_CHARS = 16_000_000
#: Matches of a shard that are followed at once.
_AT_ONCE = 1_000_000


def words(text: str | None) -> list[str]:
    """Maximal runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an array of numbers from 0.

    Numbers (later, places of suffixes) are packed side by side into one sort key, as many as fit; only suffixes that are not
    told apart yet are sorted again, by what stands behind the part already compared."""
    n = len(tokens)
    if n < 2:
        return np.arange(n)
    bits = int(max(n, tokens.max()) + 1).bit_length()
    per = max(2, 63 // bits)

    def keys(rank: np.ndarray, at: np.ndarray | None, step: int) -> np.ndarray:
        """Of each position (``at``: only those), the ranks at 0, step, 2 * step ... in one number; 0 beyond the end."""
        padded = np.concatenate([rank + 1, np.zeros(step * (per - 1), np.int64)])
        key = np.zeros(n if at is None else len(at), np.int64)
        for j in range(per):
            key = (key << bits) | (padded[j * step : j * step + n] if at is None else padded[at + j * step])
        return key

    key = keys(tokens.astype(np.int64), None, 1)
    order = np.argsort(key)
    slots, rank, ordered, step = np.arange(n), np.empty(n, np.int64), key[order], per
    moved = order
    while True:
        begins = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank[moved] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(slots)), 0))]
        open_ = ~(begins & np.concatenate([begins[1:], [True]]))
        if not open_.any():
            return order
        slots, moved = slots[open_], moved[open_]
        key = keys(rank, moved, step)
        by = np.argsort(key)
        moved, ordered, step = moved[by], key[by], step * per
        order[slots] = moved


class _Numbers(dict):
    """Gives every new word the next number."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Index:
    """Suffixes of a block of held-out items, and the search of a shard for them."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int):
        self.min_words, self.vocabulary = min_words, _Numbers()
        parts, owner, left = [], [], []
        for item, text in items:
            ids = [self.vocabulary[w] for w in words(text)]
            parts += [*ids, -1]
            owner += [item] * (len(ids) + 1)
            left += [*range(len(ids), 0, -1), 0]
        self.tokens = np.array([*parts, -1], np.int64)
        starts = np.flatnonzero(np.array(left, np.int64) >= min_words)
        self.starts, self.owner, self.left = starts, np.array(owner, np.int64)[starts], np.array(left, np.int64)[starts]
        self.before = np.where(starts > 0, self.tokens[starts - 1], -1)

    def search(self, docs: list[np.ndarray], ids: list[int], numbered: int) -> pd.DataFrame:
        """All (document, item) with a match, its longest length in words and the word at which that begins.

        The documents' words are numbered under ``numbered``."""
        m = self.min_words
        out = pd.DataFrame({"doc_id": [], "item_id": [], "n_words": [], "at_word": []}, dtype=np.int64)
        if not docs or not len(self.starts):
            return out
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        ends = np.cumsum(sizes)
        flat = np.empty(ends[-1], np.int64)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        flat[inner] = np.concatenate(docs)
        flat[ends - 1] = numbered + np.arange(len(docs))
        order = suffix_array(flat)
        padded = np.concatenate([flat, np.full(m, -1)])
        low = self._bound(padded, order, False)
        hits = self._bound(padded, order, True) - low
        upto = np.cumsum(hits)
        for first in range(0, int(upto[-1]), _AT_ONCE):
            nth = np.arange(first, min(first + _AT_ONCE, int(upto[-1])))
            query = np.searchsorted(upto, nth, "right")
            at = order[nth - (upto - hits)[query] + low[query]]
            # Where the words before agree as well, this is part of a longer match.
            begins = (at == 0) | (flat[at - 1] != self.before[query])
            query, at = query[begins], at[begins]
            length = np.full(len(query), m)
            alive = np.arange(len(query))
            while len(alive):
                n = length[alive]
                x, y = at[alive] + n, self.starts[query[alive]] + n
                same = (n < self.left[query[alive]]) & (flat[np.minimum(x, len(flat) - 1)] == self.tokens[np.minimum(y, len(self.tokens) - 1)])
                alive = alive[same]
                length[alive] += 1
            doc = np.searchsorted(ends, at, "right")
            part = pd.DataFrame({"doc_id": np.array(ids, np.int64)[doc], "item_id": self.owner[query], "n_words": length, "at_word": at - (ends - sizes)[doc]})
            out = pd.concat([out, part]).sort_values(["n_words", "at_word"], ascending=[False, True]).drop_duplicates(["doc_id", "item_id"])
        return out

    def _bound(self, padded: np.ndarray, order: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of all item suffixes at once, by their first words."""
        steps = np.arange(self.min_words)
        wanted = self.tokens[self.starts[:, None] + steps]
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            found, want = padded[order[mid][:, None] + steps], wanted[open_]
            differ = found != want
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            less = differ[rows, first] & (found[rows, first] < want[rows, first])
            up = less | (~differ.any(1) if right else False)
            lo[open_[up]] = mid[up] + 1
            hi[open_[~up]] = mid[~up]
        return lo


def _search_block(documents: DataFrame, items: list[tuple[int, str | None]], min_words: int) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(held.value, min_words)
        numbers, docs, ids, n = _Numbers(index.vocabulary), [], [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if text:
                    w = words(text)
                    docs.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
                    ids.append(doc_id)
                    n += len(w) + 1
                    if n >= SHARD_WORDS:
                        yield index.search(docs, ids, len(numbers))
                        numbers, docs, ids, n = _Numbers(index.vocabulary), [], [], 0
        yield index.search(docs, ids, len(numbers))

    return documents.mapInPandas(run, "doc_id bigint, item_id bigint, n_words bigint, at_word bigint")


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 8) -> DataFrame:
    """(``doc_id``, ``item_id``, ``n_words``, ``at_word``): one row for each document that holds at least ``min_words``
    consecutive words of an item, with the longest match and where it begins (the first of the longest).

    Null or empty texts match nothing; repeated rows of one doc_id count as one document; empty tables give an empty result.
    Items are collected block by block, ``BLOCK_CHARS`` characters of them at a time.
    """
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS) or 1
    texts = spread(documents.select("doc_id", "text"))
    wanted = items.select("item_id", "text")
    parts = []
    for k in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else wanted
        parts.append(_search_block(texts, [(r[0], r[1]) for r in block.collect()], min_words))
    found = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("n_words", (-F.col("at_word")).alias("back"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_words", (-F.col("m.back")).alias("at_word"))


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = 8) -> DataFrame:
    """The documents that hold no wording of any item."""
    hit = leaks(documents, items, min_words).select("doc_id").distinct()
    return documents.join(hit, "doc_id", "left_anti")
