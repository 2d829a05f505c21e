"""Problem 1: the language of each entry and of each one-language stretch.

Error-correcting output codes: every language has a codeword of 15 bits, any two of which differ in 8. For each bit a binary
classifier over hashed character n-grams (1 to 3, with word boundaries) gives signed log-odds; a piece of text gets the
language whose codeword has the least logistic loss against its 15 scores. Confidence is that language's share of exp(-loss),
so a small lead over the runner-up shows as a low one; under 0.9 (a lead of about 2.2) the result is flagged as ambiguous.

Classifiers are fitted on a bounded sample of labelled rows (``SAMPLE_PER_LANGUAGE``), twice: sentences that the first fit
contradicts are left out of the second. Scores add up over words, so a task scores each distinct word once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.session import spread

LANGUAGES = ("en", "tr", "de", "es", "zh-Hant", "ja", "my")
# Codes by which a language is called.
CODES = {"en": "en", "eng": "en", "tr": "tr", "tur": "tr", "de": "de", "deu": "de", "ger": "de", "es": "es", "spa": "es", "zh": "zh-Hant", "zho": "zh-Hant", "chi": "zh-Hant", "ja": "ja", "jpn": "ja", "my": "my", "mya": "my", "bur": "my"}
# Labels that name no language though they look like a code.
PLACEHOLDERS = ("und", "unk", "unknown", "n/a", "na", "none", "null", "mul", "mis", "zxx", "xx", "xxx", "other", "auto", "-", "?")
SAMPLE_PER_LANGUAGE = 800
BITS = 15
BUCKETS = 1 << 15
_CACHE = 200_000
_WORD = re.compile(r"[㐀-鿿々]{1,2}|[぀-ゟ]{1,3}|[゠-ヿ]{1,3}|[က-႟]{1,4}|[^\W\d_က-႟぀-鿿]+")
_PIECE = re.compile(r"(?<=[.!?。！？။])(?:\s+|(?=[^\s.!?。！？။\d]))|\s*\n\s*|\s+/\s+")
_ENDED = re.compile(r"[.!?。！？။]\s*$")
_TURKISH = str.maketrans("çğıöşüâîû", "cgiosuaiu")
# Any distinct numbers from 1 to 15 do: codewords are rows of a 16 x 16 Hadamard matrix.
CODEWORDS = np.array([[1.0 if ((k + 3) & b).bit_count() % 2 else -1.0 for b in range(1, BITS + 1)] for k in range(len(LANGUAGES))])


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[k : k + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in (1, 2, 3) for k in range(len(w) - n + 1) if w[k : k + n] not in ("^", "$")]


def fit(samples: dict[str, list[str]]) -> np.ndarray:
    """Log-odds of every n-gram bucket for every bit, from texts by language. A language without texts has no say."""
    counts = np.zeros((len(LANGUAGES), BUCKETS))
    for k, lang in enumerate(LANGUAGES):
        seen = Counter(w for t in samples.get(lang, ()) for w in words(t))
        for w, n in seen.items():
            for g in _grams(w):
                counts[k, g] += n
    present = counts.sum(1) > 0
    rate = (counts + 0.02) / (counts.sum(1, keepdims=True) + 0.02 * BUCKETS)
    out = np.zeros((BUCKETS, BITS), np.float32)
    for b in range(BITS):
        plus, minus = (CODEWORDS[:, b] > 0) & present, (CODEWORDS[:, b] < 0) & present
        if plus.any() and minus.any():
            out[:, b] = np.log(rate[plus].mean(0)) - np.log(rate[minus].mean(0))
    return out


class Scorer:
    """Scores pieces of text with the fitted classifiers; keeps the scores of words it has seen, up to a bound."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.rows, self.vectors, self.sizes = weights, {}, [], []

    def _row(self, word: str) -> int:
        if len(self.rows) >= _CACHE:
            self.rows, self.vectors, self.sizes = {}, [], []
        g = _grams(word)
        self.rows[word] = len(self.vectors)
        self.vectors.append(self.weights[g].sum(0))
        self.sizes.append(len(g))
        return self.rows[word]

    def losses(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Loss of each language's codeword for each piece (a list of words), and the pieces' n-gram counts."""
        sums, sizes = np.zeros((len(pieces), BITS)), np.zeros(len(pieces))
        for start in range(0, len(pieces), 20_000):
            part = pieces[start : start + 20_000]
            flat = [w for p in part for w in p]
            if len(self.rows) + len(set(flat)) > _CACHE:
                self.rows, self.vectors, self.sizes = {}, [], []
            get = self.rows.get
            index = np.array([r if (r := get(w)) is not None else self._row(w) for w in flat], np.int64)
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            owner = np.repeat(np.arange(len(part)), lengths)
            if len(index):
                v, s = np.array(self.vectors, np.float32), np.array(self.sizes, float)
                first = np.flatnonzero(lengths)
                at = (np.cumsum(lengths) - lengths)[first]
                sums[start + first] = np.add.reduceat(v[index], at, axis=0)
                sizes[start : start + len(part)] = np.bincount(owner, s[index], len(part))
        f = 2.0 * sums / np.sqrt(np.maximum(sizes, 1))[:, None] / 3.0
        margins = f[:, None, :] * CODEWORDS[None]
        return np.logaddexp(0, -margins).sum(2), sizes


def confidence(losses: np.ndarray) -> np.ndarray:
    """The best language's share of exp(-loss)."""
    e = np.exp(losses.min(1, keepdims=True) - losses)
    return 1 / e.sum(1)


def named_language(label: str | None) -> str | None:
    """The tag that a label stands for, '?' for another language's name, None where it names none."""
    if label is None or not (short := label.strip().lower()) or short in PLACEHOLDERS:
        return None
    head = re.split(r"[-_ ]", short)[0]
    return CODES.get(short) or CODES.get(head) or "?"


def _stretches(pieces: list[str], langs: np.ndarray, sure: np.ndarray, size: np.ndarray) -> list[tuple[int, str, float]]:
    """Merge neighbouring pieces of one language; unsure pieces go with what stands before them, or after at the start."""
    out: list[list] = []
    waiting = 0.0
    for k in range(len(pieces)):
        if size[k] == 0:
            continue
        weak = sure[k] < 0.9 or size[k] < 24 or (size[k] < 48 and k == len(pieces) - 1 and not _ENDED.search(pieces[k]))
        if not out:
            if weak and waiting == 0 and any(size[j] >= 24 and sure[j] >= 0.9 for j in range(k + 1, len(pieces))):
                waiting = size[k]
                continue
            out.append([langs[k], sure[k] * size[k], size[k]])
        elif weak or langs[k] == out[-1][0]:
            out[-1][1] += (sure[k] if langs[k] == out[-1][0] else 0) * size[k]
            out[-1][2] += size[k]
        else:
            out.append([langs[k], sure[k] * size[k], size[k]])
    return [(n, LANGUAGES[lang], float(c / s)) for n, (lang, c, s) in enumerate(out)]


def train(entries: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, text: str = "meaning") -> np.ndarray:
    """Fit on at most about ``per_language`` labelled rows a language, chosen by a hash of the row's text."""
    short = F.lower(F.trim("language"))
    named = F.coalesce(*[F.when(short.isin([k for k, v in CODES.items() if v == lang]), lang) for lang in LANGUAGES])
    rows = entries.select(named.alias("lang"), F.col(text).alias("t"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().where("lang is not null").collect()}
    if not sizes:
        return fit({})
    chosen = F.xxhash64("t").bitwiseAND(F.lit(0xFFFFFF)) / float(0x1000000)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(per_language / n))])[F.col("lang")]
    # Copies of one text are chosen together and learned once.
    sample = rows.where(F.col("lang").isNotNull() & F.col("t").isNotNull() & (chosen < share)).select("lang", "t").distinct().sort("lang", "t").collect()
    by: dict[str, list[str]] = {}
    for r in sample:
        by.setdefault(r[0], []).append(r[1])
    first = Scorer(fit(by))
    clean: dict[str, list[str]] = {}
    for lang, texts in by.items():
        pieces = [p for t in texts for p in _PIECE.split(t) if p]
        losses, _ = first.losses([words(p) for p in pieces])
        best = losses.argmin(1)
        clean[lang] = [p for p, k in zip(pieces, best, strict=True) if LANGUAGES[k] == lang]
    # Turkish is often typed without its own letters.
    clean["tr"] = clean.get("tr", []) + [t.lower().translate(_TURKISH) for t in clean.get("tr", [])]
    return fit(clean)


def languages(entries: DataFrame, weights: np.ndarray) -> DataFrame:
    """(``ord``, ``seg``, ``language``, ``confidence``, ``ambiguous``, ``label``, ``stretches``): the stretches of each entry's meaning.

    ``label`` is the tag that the entry's own label names ('?': another language; null: none). Entries whose term or meaning
    is null or blank give no row; a meaning without any letter takes the language of its term. ``ambiguous`` marks a
    confidence under 0.9. Repeated rows give repeated results.
    """
    held = entries.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for pdf in batches:
            pieces, terms, spans = [], [], []
            for term, meaning in zip(pdf["term"], pdf["meaning"], strict=True):
                own = [p for p in _PIECE.split(meaning) if p and not p.isspace()]
                spans.append((len(pieces), len(pieces) + len(own)))
                pieces += own
                terms.append(words(term))
            bags = [words(p) for p in pieces]
            losses, sizes = scorer.losses(bags)
            term_losses, _ = scorer.losses(terms)
            lang, sure = losses.argmin(1), confidence(losses)
            rows = []
            for k, (ord_, label) in enumerate(zip(pdf["ord"], pdf["language"], strict=True)):
                a, b = spans[k]
                named = named_language(label)
                total = sizes[a:b].sum()
                if b - a <= 1 or total < 40:
                    # Little text: the pieces together, with the term as a weaker witness.
                    n = np.maximum(sizes[a:b], 1)
                    loss = (losses[a:b] * n[:, None]).sum(0) / max(n.sum(), 1) if b > a else 0
                    if total < 40:
                        loss = loss + 0.3 * term_losses[k]
                    loss = np.atleast_2d(loss)
                    found = [(0, LANGUAGES[int(loss.argmin())], float(confidence(loss)[0]))]
                else:
                    found = _stretches(pieces[a:b], lang[a:b], sure[a:b], sizes[a:b])
                rows += [(ord_, n, x, c, c < 0.9, named, len(found)) for n, x, c in found]
            yield pd.DataFrame(rows, columns=["ord", "seg", "language", "confidence", "ambiguous", "label", "stretches"])

    usable = entries.select("ord", "term", "meaning", "language").where(r"term rlike '(?U)\\S' and meaning rlike '(?U)\\S'")
    return spread(usable).mapInPandas(run, "ord bigint, seg int, language string, confidence double, ambiguous boolean, label string, stretches int")


def mislabelled(entries: DataFrame, weights: np.ndarray) -> DataFrame:
    """(``ord``, ``seg``, ``language``) of the entries whose label is missing or wrong, or whose meaning is in several languages."""
    found = languages(entries, weights)
    return found.where("stretches > 1 or label is null or label <> language").select("ord", "seg", "language")
