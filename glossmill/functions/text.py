"""Column functions on text. All but the four at the end are built-in expressions and stay in generated code."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space as a character class body (Java's plain \s knows ASCII only).
WS = r"\t-\r\x1c-\x20\x85\xa0  -     　"
KANJI = "[一-鿿々]"
#: Runs that make keywords: index building takes a wider katakana class than matching.
# The two classes.
RUNS_BUILD = "[一-鿿々]+|[ァ-・ー]+|[a-z0-9]+"
RUNS_MATCH = "[一-鿿々]+|[ァ-ヴー]+|[a-z0-9]+"
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))
#: Punctuation left out of lookup keys, as a character class body.
KEY_PUNCTUATION = r"「」『』()\[\]。、.,!?！?・…\"'"


def strip(x: Column) -> Column:
    """Both ends without white space."""
    return F.regexp_replace(F.regexp_replace(x, f"^[{WS}]+", ""), f"[{WS}]+$", "")


def clean_text(x: Column) -> Column:
    """White space runs as one blank, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), f"[{WS}]+", " "))


def casefold(x: Column) -> Column:
    """Lower case with sharp s as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalize_text(x: Column) -> Column:
    """Unix line ends, at most one empty line, single blanks, trimmed."""
    y = F.replace(F.coalesce(x, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(y, "\n{3,}", "\n\n"), "[ \t]+", " "))


def meaning_key(x: Column) -> Column:
    return casefold(clean_text(x))


def fold_kana(x: Column) -> Column:
    """Katakana as hiragana."""
    return F.translate(x, _KATAKANA, _HIRAGANA)


def normalize_key(x: Column) -> Column:
    """Compatibility form, lower case, single blanks. Text within ASCII never leaves the JVM's fast path."""
    whole = F.coalesce(x, F.lit(""))
    plain = F.octet_length(whole) == F.length(whole)
    form = F.when(plain, whole).otherwise(nfkc(F.when(~plain, whole)))
    return F.trim(F.regexp_replace(F.lower(form), f"[{WS}]+", " "))


def merge_key(norm: Column) -> Column:
    """Lookup key of a normalized term: no punctuation, no white space."""
    return F.regexp_replace(norm, f"[{KEY_PUNCTUATION}{WS}]", "")


def phrase_key(norm: Column) -> Column:
    """``merge_key`` with katakana folded."""
    return merge_key(fold_kana(norm))


def runs(norm: Column, pattern: str = RUNS_MATCH) -> Column:
    """All script runs; hiragana makes none."""
    return F.regexp_extract_all(norm, F.lit(f"({pattern})"), F.lit(1))


def _literals(xs: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def keyword_classes(norm: Column, stop: Sequence[str], stop_latin: Sequence[str]) -> tuple[Column, Column, Column]:
    """Kanji, kana and Latin keywords of a normalized term, duplicates kept."""
    kept = F.filter(runs(norm), lambda r: ~F.array_contains(_literals(stop), r))
    kanji = F.filter(kept, lambda r: r.rlike(f"^{KANJI}+$"))
    latin = F.filter(kept, lambda r: r.rlike("^[a-z0-9]{3,}$") & ~F.array_contains(_literals(stop_latin), r))
    other = F.transform(F.filter(kept, lambda r: ~r.rlike(f"^({KANJI}+|[a-z0-9]+)$") & (F.length(r) >= 2)), fold_kana)
    return kanji, other, latin


def text_pad(norm: Column) -> Column:
    """Letters and digits in words, a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(norm, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def shortest(parts: Column) -> Column:
    """The shortest string, the first of equals; null of none."""
    indexed = F.transform(parts, lambda p, k: F.struct(F.length(p).alias("n"), k.alias("k"), p.alias("p")))
    return F.get(F.array_sort(indexed), 0)["p"]


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def clean_term(norm: Column) -> Column:
    """A translated term without artifacts: doubled forms, leading pronouns, comma variants, index letters, stock endings."""
    # The patterns of this function.
    twice, run_on = r"^(.+?)\s*/\s*\1$", r"^(.{4,20})\1$"
    pronoun, seen = "^(あなた|わたし|私|彼女|彼)(は|が|の)", "^(.{2,}?)(の夢)?を見る(こと|の)?$"

    def first_group(pattern: str) -> Callable[[Column], Column]:
        return lambda t: F.when(t.rlike(pattern), F.trim(F.regexp_extract(t, pattern, 1))).otherwise(t)

    def without_pronoun(t: Column) -> Column:
        return let(F.trim(F.regexp_replace(t, pronoun, "")), lambda bare: F.when(bare == "", t).otherwise(bare))

    def one_part(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, "、"), lambda p: F.trim(p)), lambda p: p != "")
        return F.when(F.contains(t, F.lit("、")), F.coalesce(shortest(parts), t)).otherwise(t)

    t = norm
    for step in (first_group(twice), without_pronoun, one_part, first_group(run_on)):
        t = let(t, step)
    t = F.regexp_replace(t, "(?<=[一-鿿ぁ-んァ-ヶー])[a-z]$", "")
    t = let(t, first_group(seen))
    return F.trim(F.regexp_replace(t, "(?<=[一-鿿ァ-ヶ])[のにでをへとがはも]$", ""))


def split_sentences(x: Column, ends: str = ".!?。！？") -> Column:
    """Pieces that end with a sentence end; the blanks between them are dropped."""
    return F.filter(F.split(x, f"(?<=[{ends}])\\s*"), lambda p: p != "")


def truncate_sentences(x: Column, limit: int) -> Column:
    """Whole sentences up to ``limit`` characters, stopping at 60 % of it; the first is kept even if it is longer."""
    clean = clean_text(x)
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, part: Column) -> Column:
        over = (acc["out"] != "") & (F.length(acc["out"]) + F.length(part) + 1 > limit)
        grown = F.trim(F.concat(acc["out"], F.lit(" "), part))
        out = F.when(acc["done"] | over, acc["out"]).otherwise(grown)
        return F.struct(out.alias("out"), (acc["done"] | over | (F.length(grown) * 10 >= limit * 6)).alias("done"))

    folded = F.aggregate(split_sentences(clean), start, step, lambda acc: acc["out"])
    return F.when(F.length(clean) <= limit, clean).otherwise(F.trim(folded))


def truncated(x: Column, limit: int) -> Column:
    """``truncate_sentences`` of an expression that is computed once."""
    return let(x, lambda y: truncate_sentences(y, limit))


# Stock endings of Turkish pages that are cut before translation.
TURKISH_CUTS = (r"(?isu)Ayrıca şu rüya tabir[\p{L}\p{N}_]* ve yorumlara bakınız.*$", r"(?isu)Bu rüya tabiri şu kaynaklardan.*$")


def source_text(language: Column, text: Column, limit: int = 280) -> Column:
    """The text that is translated for a meaning; lookups must use the same."""
    cut = clean_text(text)
    for pattern in TURKISH_CUTS:
        cut = F.trim(F.regexp_replace(cut, pattern, ""))
    return truncated(F.when(language == "tr", cut).otherwise(clean_text(text)), limit)


def clean_meaning(x: Column, limit: int = 220) -> Column:
    """A translated meaning without cross references, cut at a sentence end if that leaves 40 % of the limit."""
    t = clean_text(x)
    # Cross references at the beginning.
    for pattern in ("^（「[^」]{1,30}」[^）]{0,10}）\\s*", "^参照[:：]\\s*[^。]{1,40}[。 ]\\s*", "^見る[;；]\\s*\\S{1,20}\\s*"):
        t = F.trim(F.regexp_replace(t, pattern, ""))

    def cut(c: Column) -> Column:
        last = F.length(c) - F.locate("。", F.reverse(c))  # 0-based; the length where there is none
        found = F.contains(c, F.lit("。")) & (last * 10 >= limit * 4)
        return F.when(found, F.substring(c, F.lit(1), last + 1)).otherwise(F.concat(F.rtrim(c), F.lit("…")))

    return F.trim(let(t, lambda y: F.when(F.length(y) > limit, let(F.substring(y, 1, limit), cut)).otherwise(y)))


def occurrences(x: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(word), F.lit("")))) / len(word)).cast("int")


def tone(joined: Column, original: Column, good: Sequence[str], ill: Sequence[str]) -> Column:
    """-1, 0 or 1: good words minus ill words, and two for an explicit mark in the original."""
    score = sum((occurrences(joined, w) for w in good), F.lit(0)) - sum((occurrences(joined, w) for w in ill), F.lit(0))
    score = score + F.when(F.contains(original, F.lit("吉")), 2).otherwise(0) - F.when(F.contains(original, F.lit("凶")), 2).otherwise(0)
    return F.signum(score).cast("tinyint")


def clause_complete(x: Column) -> Column:
    """Whether a clause can stand alone; tests apply in this order."""
    # Endings.
    return (
        F.when(x.rlike("(こと|もの|ため|とき|よう|さま)$"), True)
        .when(x.rlike("[してにをがはでとやのへ、か]$"), False)
        .when(x.rlike("(なり|あり|おり|され|でき|しまい|ており|に入り)$"), False)
        .otherwise(True)
    )


# Endings that close a sentence.
_STRONG = "(こと|です|ます|でしょう|ください|しれません)$"


def pack_clauses(sentence: Column, limit: int) -> Column:
    """The longest run of leading comma clauses within the limit that ends completely; empty under 8 characters."""
    clauses = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(sentence, F.lit("")), "[。!?！？]$", ""), "、"), lambda p: F.trim(p)), lambda s: s != "")
    prefixes = F.transform(clauses, lambda _, k: F.array_join(F.slice(clauses, F.lit(1), k + 1), "、"))
    # Once one is too long, no longer one is taken.
    fitting = F.filter(prefixes, lambda p: F.length(p) <= limit)
    strong = F.exists(clauses, lambda s: s.rlike(_STRONG))
    good = F.filter(fitting, lambda p: (~strong | p.rlike(_STRONG)) & clause_complete(p))
    best = F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit(""))
    return F.when(F.length(best) >= 8, best).otherwise("")


def summarize(x: Column, limit: int = 110) -> Column:
    """Leading sentences up to the limit, stopping at 55 % of it; an over-long first one is packed by clauses."""
    parts = F.filter(F.split(clean_text(x), "(?<=[。!?！？])"), lambda p: F.trim(p) != "")
    first = F.get(parts, 0)
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, part: Column) -> Column:
        over = (acc["out"] != "") & (F.length(acc["out"]) + F.length(part) > limit)
        grown = F.concat(acc["out"], part)
        return F.struct(F.when(acc["done"] | over, acc["out"]).otherwise(grown).alias("out"), (acc["done"] | over | (F.length(grown) * 100 >= limit * 55)).alias("done"))

    packed = pack_clauses(first, limit - 2)
    whole = F.trim(F.aggregate(parts, start, step, lambda acc: acc["out"]))
    return F.when(F.length(first) > limit, F.when(packed == "", "").otherwise(F.concat(packed, F.lit("。")))).otherwise(whole)


def essence(x: Column) -> Column:
    """What a meaning says comes of it: of the first three sentences, the first that yields a complete short core."""
    sentences = F.slice(F.filter(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), f"[{WS}]+", ""), "(?<=[。!?！？])"), lambda p: p != ""), 1, 3)
    # What leads up to the core, and what follows it.
    lead = "^.{0,42}?(?:ことは|場合(?:は|、)|のは、?|は、|なら、?)(.+)$"
    tail = "^(.*?)(?:こと|の)?(?:を意味します|を意味する|を示しています|を示します|を表しています|を表します|と解釈されます|とされています|と言われています|の(?:兆し|兆候|前兆|しるし)です|を告げています|につながります)$"

    def group(pattern: str, least: int) -> Callable[[Column], Column]:
        return lambda c: let(F.regexp_extract(c, pattern, 1), lambda g: F.when(F.length(g) >= least, g).otherwise(c))

    def judged(c: Column) -> Column:
        said = c.rlike("(言いました|言われました|によると|曰く|参照)")
        fits = (F.length(c) >= 6) & (F.length(c) <= 55) & clause_complete(c)
        return F.when(said, "").when(fits, c).when(F.length(c) > 55, pack_clauses(c, 48)).otherwise("")

    def core(s: Column) -> Column:
        c = let(F.regexp_replace(s, "[。!?！？]$", ""), group(lead, 6))
        c = let(F.regexp_replace(c, "^(それは|これは|あなたが|あなたの)", ""), group(tail, 2))
        return let(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[「」『』()（）]", ""), "^[、。・]+", ""), "[、。]$", ""), judged)

    return F.coalesce(F.get(F.filter(F.transform(sentences, core), lambda c: c != ""), 0), F.lit(""))


def scene(x: Column) -> Column:
    """The first sentence of a text; over 26 characters, cut to 24 at its last comma if that leaves more than 8."""
    s = strip(F.split(F.coalesce(x, F.lit("")), "[。!?！？\n]")[0])
    head = F.substring(s, 1, 24)
    comma = F.length(head) - F.locate("、", F.reverse(head))
    cut = F.when(F.contains(head, F.lit("、")) & (comma > 8), F.substring(head, F.lit(1), comma)).otherwise(head)
    return F.when(F.length(s) > 26, F.concat(cut, F.lit("…"))).otherwise(s)


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", " ")


# Four functions for which Spark has no built-in; vectorized over Arrow.


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; null stays null."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def full_casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding."""
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML character references resolved."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Capitals after every non-letter."""
    return s.map(str.title, na_action="ignore")
