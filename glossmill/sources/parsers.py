"""Parsers from raw shapes to entries: (``term``, ``meaning``, ``aliases``) and the input's key columns.

Every parser drops rows whose term or meaning is null or empty after cleaning, and takes the key columns to keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import text as X

BOOK_START, BOOK_END = "*** START OF THE PROJECT GUTENBERG EBOOK", "*** END OF THE PROJECT GUTENBERG EBOOK"


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every column has something but white space."""
    for c in columns:
        df = df.where(F.length(X.strip(F.coalesce(c, F.lit("")))) > 0)
    return df


def _entries(df: DataFrame, key: Sequence[str], term: Column, meaning: Column, aliases: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    out = df.select(*key, term.alias("term"), meaning.alias("meaning"), (none if aliases is None else aliases).alias("aliases"))
    return out.where("term <> '' and meaning <> ''")


def marker_slice(text: Column, start: str | None = None, end: str | None = None, entry: str | None = None) -> Column:
    """What stands after ``start``, before ``end`` and from ``entry`` on; a missing marker cuts nothing."""
    t = text
    if start:
        t = F.when(F.contains(t, F.lit(start)), F.substring(t, F.locate(start, t) + len(start), F.length(t))).otherwise(t)
    if end:
        t = F.substring_index(t, end, 1)
    if entry:
        t = F.when(F.contains(t, F.lit(entry)), F.substring(t, F.locate(entry, t), F.length(t))).otherwise(t)
    return t


def is_heading(line: Column) -> Column:
    """An underscored heading of at most 80 characters with a final dot."""
    s = X.strip(line)
    # The form of a heading.
    return F.length(s).between(1, 80) & ~F.startswith(s, F.lit("[")) & s.rlike(r"^_[^_\n]{1,80}_\.$")


def heading_term(line: Column) -> Column:
    """A heading without footnotes, final dots and underscores."""
    s = F.regexp_replace(X.strip(F.regexp_replace(line, r"\[\d+\]", "")), r"\.+$", "")
    return X.strip(F.regexp_replace(s, "^_+|_+$", ""))


def alias_split(term: Column) -> Column:
    """The parts around the word 'and', but for the term itself; none where ' and ' does not occur."""
    parts = F.filter(F.transform(F.split(term, r"(?i)\band\b"), X.strip), lambda p: (p != "") & (X.casefold(p) != X.casefold(term)))
    return F.when(F.contains(F.lower(term), F.lit(" and ")), parts).otherwise(F.array().cast("array<string>"))


def heading_sections(books: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Sections of a text: a heading opens one, the lines after it are its body. Lines before the first heading and
    headings without a body are dropped. A text is sessionized within its own rows."""
    lines = books.select(*key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))
    head = is_heading(F.col("line"))
    section = F.sum(head.cast("int")).over(Window.partitionBy(*key).orderBy("pos"))
    marked = lines.select(*key, "pos", "line", head.alias("head"), section.alias("section")).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    grouped = marked.groupBy(*key, "section").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("heading"), body.alias("body"))
    term = heading_term(F.col("heading"))
    return _entries(grouped, [*key, "section"], term, X.normalize_text(F.col("body")), alias_split(term))


def first_sentence(x: Column) -> Column:
    """Up to the first '. ', with a final dot."""
    s = X.strip(F.substring_index(X.strip(x), ". ", 1))
    return F.when((s != "") & ~F.endswith(s, F.lit(".")), F.concat(s, F.lit("."))).otherwise(s)


def symbol_rows(rows: DataFrame, order: str, symbols: str = "symbols", text: str = "interpretation") -> DataFrame:
    """One entry a casefolded symbol: the first row that names it wins (within a row, its first mention)."""
    ready = rows.where(F.length(X.strip(F.coalesce(text, F.lit("")))) > 0)
    each = ready.select(F.col(order).alias("ord"), F.posexplode(symbols).alias("at", "symbol"), first_sentence(F.col(text)).alias("meaning"))
    named = each.withColumn("symbol", X.strip(F.coalesce("symbol", F.lit("")))).where("symbol <> ''").withColumn("key", X.casefold(F.col("symbol")))
    won = named.groupBy("key").agg(F.min(F.struct("ord", "at", "symbol", "meaning")).alias("w"))
    return won.select(F.col("w.ord").alias("ord"), X.title_case("w.symbol").alias("term"), F.col("key").alias("term_normalized"), F.col("w.meaning").alias("meaning"))


def field_map(rows: DataFrame, key: Sequence[str], term: str, meaning: str, alias: str | None = None) -> DataFrame:
    """Term and meaning from two columns; an optional third is the alias."""
    a = None if alias is None else F.filter(F.array(X.strip(F.coalesce(f"`{alias}`", F.lit("")))), lambda v: v != "")
    return _entries(rows, key, X.strip(F.coalesce(f"`{term}`", F.lit(""))), X.normalize_text(F.col(f"`{meaning}`")), a)


def questions(rows: DataFrame, key: Sequence[str], question: str, answer: str, pattern: str = r"(?iu)rüyada\s+(.+?)\s+görmek\s+ne anlama gelir") -> DataFrame:
    """The captured part of a question is the term, else the whole question; a differing question is the alias."""
    q = X.normalize_text(F.col(question))
    found = X.strip(F.regexp_extract(q, pattern, 1))
    term = F.when(q.rlike(pattern), found).otherwise(q)
    alias = F.when(X.casefold(q) != X.casefold(term), F.array(q)).otherwise(F.array().cast("array<string>"))
    return _entries(rows, key, term, X.normalize_text(F.col(answer)), alias)


def nested_phrases(payload: DataFrame, key: Sequence[str], array: str, field: str) -> DataFrame:
    """Each element's phrase is both term and meaning."""
    one = payload.select(*key, F.explode(array).alias("e")).select(*key, X.normalize_text(F.col(f"e.{field}")).alias("p"))
    return _entries(one, key, F.col("p"), F.col("p"))


def transcripts(rows: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Two-turn transcripts that begin with the stock question; others are dropped."""
    pattern = r"(?is)^### Human:\s*What does it mean if I dream about an?\s+(.+?)\?\s*### Assistant:\s*(.+)"
    t = X.strip(F.coalesce(text, F.lit("")))
    return _entries(rows, key, X.strip(F.regexp_extract(t, pattern, 1)), X.normalize_text(F.regexp_extract(t, pattern, 2)))


def phrases(rows: DataFrame, key: Sequence[str], text: str = "text", skip: Sequence[str] = ("詩曰",)) -> DataFrame:
    """Phrases of wiki text: lines without markup, split at ideographic blanks or two blanks; at least 5 characters, none Latin."""
    lines = rows.select(*key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_pos", "line"))
    line = X.strip(F.col("line"))
    kept = lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").rlike(r"^(\{\{|==)") & ~F.col("line").isin(list(skip)))
    each = kept.select(*key, "line_pos", F.posexplode(F.transform(F.split("line", f"　+|[{X.WS}]{{2,}}"), X.strip)).alias("pos", "phrase"))
    good = each.where((F.length("phrase") >= 5) & ~F.col("phrase").rlike(r"[A-Za-z{}\[\]|=#]"))
    return good.select(*key, "line_pos", "pos", F.col("phrase").alias("term"), F.col("phrase").alias("meaning"))


#: Patterns of term-meaning pairs in running text; the meaning goes up to the next heading.
# How the three books set term and meaning apart.
DASH_PAIRS = r"(?ms)^\s*_([^_\n]{1,80})_[-—]+(.*?)(?=^\s*_[^_\n]{1,80}_[-—]+|\z)"
EQUALS_PAIRS = r"(?ms)=([^=\n]{1,80})=\.?--(.*?)(?==[^=\n]{1,80}=\.?--|\z)"
CAPITAL_PAIRS = r"(?ms)^([A-Z][A-Z' -]{1,60})\. (.*?)(?=^[A-Z][A-Z' -]{1,60}\. |\z)"


def pattern_pairs(books: DataFrame, key: Sequence[str], pattern: str, text: str = "text", start: str | None = None, end: str | None = None) -> DataFrame:
    """Pairs found by a pattern with two groups, in order (``pos``). Capitals are title-cased and their number lists cut."""
    core = marker_slice(marker_slice(F.col(text), BOOK_START, BOOK_END), None, None, start)
    core = F.substring_index(core, end, 1) if end else core
    both = F.arrays_zip(F.regexp_extract_all(core, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(core, F.lit(pattern), F.lit(2)).alias("m"))
    found = books.select(*key, F.posexplode(both).alias("pos", "p")).select(*key, "pos", F.col("p.t").alias("t"), F.col("p.m").alias("m"))
    term, meaning = X.strip(F.col("t")), X.normalize_text(F.col("m"))
    if pattern == CAPITAL_PAIRS:
        term, meaning = X.strip(X.title_case("t")), F.regexp_replace(meaning, r"\s+\d+(?:,\s*\d+)*\.$", ".")
    if pattern == EQUALS_PAIRS:
        term = F.regexp_replace(term, r"\.+$", "")
    return _entries(found, [*key, "pos"], term, meaning)


def page_paragraphs(html: Column) -> Column:
    """Bodies of paragraphs without tags, of at least 60 characters."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.split(X.unescape(F.array_join(F.transform(bodies, lambda b: F.regexp_replace(X.strip_tags(b), f"[{X.WS}]+", " ")), "\u0001")), "\u0001"), lambda p: F.length(X.clean_text(p)) >= 60)


def pages(rows: DataFrame, slug: str = "slug", html: str = "html") -> DataFrame:
    """(``slug``, ``term``, ``alias``, ``meaning``) of crawled pages: first heading, first general paragraph up to 600 characters.

    Pages without heading, title, term or long paragraph are dropped.
    """
    head = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    t = rows.select(slug, X.unescape(X.strip_tags(head)).alias("alias"), page_paragraphs(F.coalesce(html, F.lit(""))).alias("ps"))
    t = t.select(slug, X.clean_text(F.col("alias")).alias("alias"), F.transform("ps", X.clean_text).alias("ps")).where("alias <> '' and size(ps) > 0")
    # Paragraph openings passed over, and the words around a heading's term.
    general = F.coalesce(F.get(F.filter("ps", lambda p: ~p.rlike(r"(?iu)^(dini|psikolojik)\b")), 0), F.get("ps", 0))
    term = X.strip(F.regexp_replace(X.strip(F.regexp_replace("alias", r"(?i)^r[uü]yada\s+", "")), r"(?i)\s+g[oö]rmek$", ""))
    return t.select(slug, term.alias("term"), "alias", F.substring(general, 1, 600).alias("meaning")).where("term <> ''")


def sitemap_slugs(maps: DataFrame, text: str = "text") -> DataFrame:
    """Distinct page names of sitemap files."""
    return maps.select(F.explode(F.regexp_extract_all(text, F.lit(r"<loc>[^<]*/([^/<]+\.html)</loc>"), F.lit(1))).alias("slug")).distinct()
