"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from glossmill.functions import pack
from glossmill.functions.text import RUNS_MATCH

_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_P = r"""[「」『』()\[\]。、.,!?！?・…"'']"""
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_W}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"


def fold(x: str) -> str:
    return f"replace(lower(replace({x}, 'İ', 'i̇')), 'ß', 'ss')"


def normalize(x: str) -> str:
    lines = f"replace(coalesce({x}, ''), chr(13) || chr(10), chr(10))"
    return strip(rf"regexp_replace(regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")


def norm_key(x: str) -> str:
    return f"trim(regexp_replace(lower(replace(coalesce({x}, ''), 'İ', 'i̇')), '{_W}+', ' ', 'g'))"


def phrase_key(n: str) -> str:
    return f"regexp_replace(regexp_replace(translate({n}, '{_KATAKANA}', '{_HIRAGANA}'), '{_P}', '', 'g'), '{_W}', '', 'g')"


def words(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def tone(text: str, original: str) -> str:
    def times(w: str) -> str:
        return f"(length({text}) - length(replace({text}, '{w}', ''))) // {len(w)}"

    score = " + ".join(map(times, pack.TONE_GOOD)) + "".join(f" - {times(w)}" for w in pack.TONE_ILL)
    return f"sign({score} + case when contains({original}, '吉') then 2 else 0 end - case when contains({original}, '凶') then 2 else 0 end)::bigint"


_KEYED = f"""
keyed as (
  select *, {fold("t")} as key, md5({fold(clean("meaning"))}) as mkey
  from (select ord, {clean("term")} as t, language, meaning, aliases, source from raw_entries)
  where t <> '' and {clean("meaning")} <> '' and not (coalesce(language, '') = 'en' and length(t) = 1)
)"""
_MERGED = f"""
{_KEYED},
heads as (select key, t, language, row_number() over (partition by key order by ord) as n from keyed),
counts as (select key, count(distinct mkey) as meaning_count, count(distinct (coalesce(source.name, chr(1)), coalesce(source.url, chr(1)))) as source_count, min(ord) as first_ord from keyed group by key),
merged as (select c.key as term_normalized, h.t as term, h.language, meaning_count, source_count, first_ord from counts c join heads h on c.key = h.key and h.n = 1)"""
_PAGES = """
pages as (
  select slug, min(line_no) as line_no, max(line_no) as last_line, arg_max((term, alias, meaning), line_no) as v from page_cache where slug is not null group by slug
)"""
_BOOKS = r"""
books as (
  select entry_id, 'Preface' || chr(10) || '*** START ***' || chr(10) || 'front matter' || chr(10)
    || array_to_string(list_transform(meanings, lambda m: '_' || term || '_.' || chr(10) || coalesce(m.text, '')), chr(10))
    || chr(10) || '*** END ***' || chr(10) || 'back matter' as text
  from dream_terms where term is not null and meanings is not null
),
core as (select entry_id, string_split(string_split(text, '*** START ***')[2], '*** END ***')[1] as text from books)"""


def _truncated(x: str, limit: int) -> str:
    pieces = rf"list_filter(string_split(regexp_replace({x}, '([.!?。！？])\s*', '\1' || chr(2), 'g'), chr(2)), lambda p: p <> '')"
    step = f"""case when suffix(a, chr(1)) then a when a <> '' and length(a) + length(p) + 1 > {limit} then a || chr(1)
      when length(trim(a || ' ' || p)) * 10 >= {limit} * 6 then trim(a || ' ' || p) || chr(1) else trim(a || ' ' || p) end"""
    return f"case when length({x}) <= {limit} then {x} else replace(list_reduce({pieces}, lambda a, p: {step}, ''), chr(1), '') end"


_CUTS = (r"(?is)Ayrıca şu rüya tabir[\pL\pN_]* ve yorumlara bakınız.*$", r"(?is)Bu rüya tabiri şu kaynaklardan.*$")


def _source_text(lang: str, x: str) -> str:
    cut = clean(x)
    for p in _CUTS:
        cut = f"trim(regexp_replace({cut}, '{p}', ''))"
    return f"case when {lang} = 'tr' then {cut} else {clean(x)} end"


_LANGS = "('en', 'tr', 'zh-Hant', 'my')"
_ITEMS = f"""
ready as (
  select language as lang, entry_id, 0 as slot, {clean("term")} as text, '' as own from dream_terms where language in {_LANGS}
  union all
  select lang, entry_id, slot, {_truncated("c", 280)} as text, own from (
    select lang, entry_id, slot, own, {_source_text("lang", "x")} as c from (
      select language as lang, entry_id, unnest(range(1, least(2, len(meanings)) + 1)) as slot, {clean("term")} as own, unnest(list_transform(meanings[1:2], lambda m: m.text)) as x
      from dream_terms where language in {_LANGS}))
),
items as (select lang, text, arg_min((entry_id, slot), (entry_id, slot)) as f from ready where text <> '' and text <> own group by lang, text)"""

_INDEX = f"""
idx as (
  select line_no as row_no, string_split(v, '、')[1] as term, substr(coalesce(text, ''), 1, 48) as orig, v, {tone("v", "coalesce(text, '')")} as tone
  from translation_cache where v is not null and v <> ''
),
normed as (select *, {norm_key("term")} as norm, {norm_key("orig")} as orig_norm from idx),
runs as (
  select *, {phrase_key("norm")} as phrase, case when regexp_full_match(norm, '[a-z0-9 .''-]+') then norm end as latin_phrase,
    list_filter(regexp_extract_all(norm, '{RUNS_MATCH}'), lambda r: not list_contains({words(pack.MATCH_STOP)}, r)) as kept,
    list_filter(regexp_extract_all(orig_norm, '{RUNS_MATCH}'), lambda r: regexp_full_match(r, '[a-z0-9]{{3,}}') and not list_contains({words(pack.MATCH_STOP_LATIN)}, r)) as more
  from normed
),
classes as (
  select *, list_filter(kept, lambda r: regexp_full_match(r, '[一-鿿々]+')) as kanji,
    list_filter(kept, lambda r: regexp_full_match(r, '[a-z0-9]{{3,}}') and not list_contains({words(pack.MATCH_STOP_LATIN)}, r)) as own_latin,
    list_transform(list_filter(kept, lambda r: regexp_full_match(r, '[ァ-ヴー]+') and length(r) >= 2), lambda r: translate(r, '{_KATAKANA}', '{_HIRAGANA}')) as other
  from runs
),
firsts as (
  select row_no, list(w order by k) as extra from (
    select row_no, w, min(k) as k from (select row_no, own_latin, unnest(more) as w, unnest(range(1, len(more) + 1)) as k from classes) where not list_contains(own_latin, w) group by row_no, w)
  group by row_no
),
feats as (select c.*, list_concat(own_latin, coalesce(extra, [])) as latin from classes c left join firsts using (row_no))"""
_BRIDGE = "list_filter([" + ", ".join(f"case when list_contains(other_set, '{a}') or regexp_matches(fold, '(^|[^ぁ-ん一-鿿々]){a}') then '{b}' end" for a, b in pack.KANA_BRIDGE) + "], lambda x: x is not null)"
_CONTEXT = f"""
dn as (select ord, {norm_key("meaning")} as norm from raw_entries where meaning is not null),
df as (select ord, norm, {phrase_key("norm")} as fold, regexp_extract_all(norm, '{RUNS_MATCH}') as rs from dn),
ds as (
  select ord, fold, ' ' || trim(regexp_replace(norm, '[^\\pL\\pN]+', ' ', 'g')) || ' ' as pad, list_filter(rs, lambda r: regexp_full_match(r, '[一-鿿々]+')) as kr,
    list_distinct(list_transform(list_filter(rs, lambda r: regexp_full_match(r, '[ァ-ヴー]+')), lambda r: translate(r, '{_KATAKANA}', '{_HIRAGANA}'))) as other_set,
    list_distinct(list_filter(rs, lambda r: regexp_full_match(r, '[a-z0-9]+'))) as latin_set
  from df where fold <> ''
),
ctx as (select ord, fold, pad, list_concat(kr, {_BRIDGE}) as kanji_runs, other_set, latin_set from ds)"""
_CANDIDATES = f"""
{_INDEX}, {_CONTEXT},
pairs as (
  select ord, row_no, term, phrase, tone, v,
    coalesce(case when latin_phrase is not null then length(latin_phrase) >= 3 and contains(pad, ' ' || latin_phrase || ' ') else length(phrase) >= 3 and contains(fold, phrase) end, false) as phrase_hit,
    coalesce(list_sum(list_transform(kanji, lambda k: case when len(list_filter(kanji_runs, lambda r: contains(r, k))) > 0 then 20 * length(k) * length(k) else 0 end)), 0)
      + coalesce(list_sum(list_transform(other, lambda k: case when list_contains(other_set, k) or (length(k) >= 3 and contains(fold, k)) then 12 * length(k) * length(k) else 0 end)), 0) as jg,
    coalesce(list_sum(list_transform(kanji, lambda k: 20 * length(k) * length(k))), 0) + coalesce(list_sum(list_transform(other, lambda k: 12 * length(k) * length(k))), 0) as ja,
    coalesce(list_sum(list_transform(latin, lambda k: case when list_contains(latin_set, k) then 15 * length(k) else 0 end)), 0) as lg,
    coalesce(list_sum(list_transform(latin, lambda k: 15 * length(k))), 0) as la
  from ctx cross join feats
),
judged as (
  select *, ja > 0 and jg = ja as ja_full, ja > 0 and ((jg = ja) or (10 * jg >= 6 * ja and jg >= 60)) as ja_ok, la > 0 and 10 * lg >= 6 * la as latin_ok from pairs
),
cand as (
  select ord, row_no, term, phrase, tone, v, phrase_hit, ja_full,
    (case when phrase_hit then 60 + 20 * length(phrase) else 0 end + case when ja_ok then jg else 0 end + case when latin_ok then lg else 0 end + case when ja_full and length(term) <= 2 then 60 else 0 end)::bigint as score
  from judged where phrase_hit or ja_ok or latin_ok
),
topk as (
  select *, row_number() over (partition by ord order by score desc, length(phrase) desc, length(term), row_no) as place from cand where score > 0 qualify place <= 12
)"""
# The original terms as a whole, not their first 48 characters.
_CANDIDATES_WHOLE = _CANDIDATES.replace("substr(coalesce(text, ''), 1, 48)", "coalesce(text, '')")
_SHARED = "len(list_filter(a.ks, lambda x: list_contains(r.kanji, x)))"
_DIVERSE = f"""
{_CANDIDATES},
ranked as (select c.ord, c.row_no, c.score, c.ja_full, c.phrase, f.kanji, row_number() over (partition by c.ord order by c.score desc, length(c.phrase) desc, length(c.term), c.row_no) as k from cand c join feats f using (row_no) where c.score > 0),
walk as (
  select distinct ord, 0::bigint as k, null::bigint as row_no, null::bigint as score, false as taken, 0 as n, []::struct(p varchar, f boolean, ks varchar[])[] as acc from ranked
  union all
  select ord, k, row_no, score, taken, n + taken::integer, case when taken then list_append(acc, {{'p': phrase, 'f': ja_full, 'ks': kanji}}) else acc end
  from (
    select r.*, w.n, w.acc,
      len(list_filter(w.acc, lambda a: contains(r.phrase, a.p) or contains(a.p, r.phrase) or (a.f and r.ja_full and len(a.ks) > 0 and len(a.ks) = len(r.kanji) and {_SHARED} = len(a.ks)))) = 0
      and not (len(r.kanji) > 0 and len(list_filter(w.acc, lambda a: {_SHARED} > 0)) >= 2) as taken
    from walk w join ranked r on r.ord = w.ord and r.k = w.k + 1 where w.n < 12)
)"""
_POOL = f"""
{_CANDIDATES},
short as (select *, count(*) filter (length(term) <= 14) over (partition by ord) as n_short from topk),
pool as (select *, row_number() over (partition by ord order by place) as pool_place from short where n_short < 3 or length(term) <= 14 qualify pool_place <= 6)"""


def _hits(x: str, ws: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, '{w}')::bigint" for w in ws) + ")"


_THEMES = "[" + ", ".join(f"{{'theme': '{t}', 'theme_no': {n}, 'hits': {_hits('v', ws)}}}" for n, (t, ws) in enumerate(pack.THEMES.items())) + "]"


def _any(x: str, ws: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in ws) + ")"


_UPSERT = f"""
{_PAGES},
added as (select * from (select {fold(clean("v[1]"))} as key, line_no as ord, {strip("coalesce(v[3], '')")} as meaning, {strip("coalesce(v[2], '')")} as alias from pages) where key <> '' and meaning <> ''),
old as (select * from dream_terms where term_normalized is not null)"""

SQL: dict[str, str] = {
    "merge_lexicon": f"with {_MERGED} select * from merged",
    "merge_meanings": f"with {_KEYED} select key as term_normalized, ord, md5(meaning) as text_md5, source.name as source_name from keyed qualify row_number() over (partition by key, mkey order by ord) = 1",
    "merge_sources": f"with {_KEYED} select key as term_normalized, ord, source.name as name, source.url as url, source.license_note as license_note from keyed qualify row_number() over (partition by key, source.name, source.url order by ord) = 1",
    "merge_aliases": f"with {_KEYED}, a as (select distinct key as term_normalized, unnest(aliases) as alias from keyed) select term_normalized, alias, {fold('alias')} as sort_key from a where alias is not null",
    "lexicon_upsert": f"""with {_PAGES},
p as (select {clean("v[1]")} as term, line_no as ord, {strip("coalesce(v[3], '')")} as meaning from pages),
pk as (select *, {fold("term")} as key from p where term <> '' and meaning <> ''),
old as (select * from dream_terms where term_normalized is not null),
heads as (select term_normalized as key, 0 as rank, entry_id as ord, term, language from old union all select key, 1, ord, term, 'tr' from pk),
h as (select * from heads qualify row_number() over (partition by key order by rank, ord) = 1),
om as (select term_normalized as key, unnest(list_transform(meanings, lambda m: m.text)) as text from old),
ms as (select key, {fold(clean("text"))} as m from om where text is not null union select key, {fold(clean("meaning"))} from pk),
ss as (select term_normalized as key, unnest(list_transform(sources, lambda s: s.name)) as name from old union select key, 'Crawled pages' from pk)
select h.key as term_normalized, h.term, h.language, coalesce(mc, 0) as meaning_count, coalesce(sc, 0) as source_count, h.rank = 1 as is_new
from h left join (select key, count(*) as mc from ms group by key) using (key) left join (select key, count(distinct name) as sc from ss group by key) using (key)""",
    "upsert_meanings": f"""with {_UPSERT},
m as (select term_normalized as key, 0 as rank, entry_id as ord, unnest(meanings) as m, unnest(range(len(meanings))) as pos from old),
u as (select key, rank, ord, pos, m.text as text, m.source_name as source_name from m where m.text is not null union all select key, 1, ord, 0, meaning, 'Crawled pages' from added)
select key as term_normalized, rank = 1 as is_new, ord, md5(text) as text_md5, source_name from u qualify row_number() over (partition by key, {fold(clean("text"))} order by rank, ord, pos) = 1""",
    "upsert_sources": f"""with {_UPSERT},
m as (select term_normalized as key, 0 as rank, entry_id as ord, unnest(sources) as s, unnest(range(len(sources))) as pos from old),
u as (select key, rank, ord, pos, s.name as name, s.url as url from m where s.name is not null union all select key, 1, ord, 0, 'Crawled pages', 'https://pages.example' from added)
select key as term_normalized, name, url, rank = 1 as is_new from u qualify row_number() over (partition by key, name order by rank, ord, pos) = 1""",
    "upsert_aliases": f"""with {_UPSERT},
u as (select term_normalized as key, unnest(aliases) as alias from old union select key, alias from added where alias <> '')
select key as term_normalized, alias, {fold("alias")} as sort_key from u where alias is not null""",
    "lexicon_summary": f"with {_MERGED} select count(*) as entry_count, count(distinct language) as language_count, sum(meaning_count)::bigint as meaning_total from merged",
    "language_counts": f"with {_MERGED} select language, count(*) as entries from merged group by language",
    "source_count": "select count(distinct s.name) as source_count from (select unnest(sources) as s from dream_terms)",
    "lang_explode_counts": "select language, count(distinct term_normalized) as entries from dream_terms where term_normalized is not null and language is not null group by language",
    "row_count_guard": f"with {_MERGED} select count(*) as n_rows from merged",
    "union_sources": f"with {_PAGES} select 0 as rank, source.name as source_name, count(*) as entries, min(ord) as first_ord from raw_entries group by source.name union all select 1, 'Crawled pages', count(*), min(line_no) from pages",
    "nested_lexicon": f"with {_MERGED}, a as (select key, count(distinct x) as n from (select key, unnest(aliases) as x from keyed) where x is not null group by key) select term_normalized, meaning_count as n_meanings, source_count as n_sources, coalesce(n, 0) as n_aliases from merged left join a on a.key = term_normalized",
    "required_fields": f"with r as (select source.name as source_name, {strip("coalesce(term, '')")} <> '' and {strip("coalesce(meaning, '')")} <> '' as ok from raw_entries) select source_name, count(*) filter (ok) as kept, count(*) filter (not ok) as dropped from r group by source_name",
    "field_map": f"select * from (select ord, {strip("coalesce(term, '')")} as term, md5({normalize('meaning')}) as meaning_md5 from raw_entries) where term <> '' and meaning_md5 <> md5('')",
    "nested_explode": f"select entry_id, md5(t) as meaning_md5 from (select entry_id, {normalize('x')} as t from (select entry_id, unnest(list_transform(meanings, lambda m: m.text)) as x from dream_terms)) where t <> ''",
    "first_sentence": f"with s as (select ord, {strip("string_split(" + strip('meaning') + ", '. ')[1]")} as x from raw_entries where meaning is not null) select ord, md5(case when x <> '' and not suffix(x, '.') then x || '.' else x end) as sentence_md5 from s",
    "symbol_first_wins": f"""with e as (select ord, meaning, unnest(aliases) as symbol, unnest(range(len(aliases))) as nth from raw_entries where {strip("coalesce(meaning, '')")} <> ''),
n as (select ord, nth, {strip("coalesce(symbol, '')")} as symbol, {strip("string_split(" + strip('meaning') + ", '. ')[1]")} as x from e),
k as (select *, {fold("symbol")} as key from n where symbol <> '' qualify row_number() over (partition by key order by ord, nth) = 1)
select key as term_normalized, ord, md5(case when x <> '' and not suffix(x, '.') then x || '.' else x end) as meaning_md5 from k""",
    "qa_pairs": f"""with t as (select line_no, term, meaning from page_cache where term is not null and meaning is not null)
select * from (select line_no, {strip('term')} as term, md5({normalize('meaning')}) as meaning_md5 from t) where term <> '' and meaning_md5 <> md5('')""",
    "regex_capture_or_default": rf"""with q as (select line_no, {normalize("alias || case when line_no % 3 > 0 then ' ne anlama gelir?' else '?' end")} as q, {normalize("meaning")} as m from page_cache where alias is not null),
t as (select line_no, q, m, regexp_matches(q, '(?i)rüyada\s+(.+?)\s+görmek\s+ne anlama gelir') as hit, {strip("regexp_extract(q, '(?i)rüyada\\s+(.+?)\\s+görmek\\s+ne anlama gelir', 1)")} as found from q)
select * from (select line_no, case when hit then found else q end as term, case when hit and {fold("found")} <> {fold("q")} then 1 else 0 end::bigint as n_aliases from t where m <> '') where term <> ''""",
    "alias_split": rf"""with t as (select ord, term || ' and ' || coalesce(source.name, 'x') as t from raw_entries where term is not null)
select ord, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '(?i)\band\b'), lambda p: {strip("p")}), lambda p: p <> '' and {fold("p")} <> {fold("t")}), '|') as aliases from t""",
    "phrase_split": rf"""with t as (select ord, {strip("unnest(string_split(replace(translate(meaning, '，。', chr(12288) || chr(12288)), chr(13), chr(10)), chr(10)))")} as line from raw_entries where meaning is not null),
p as (select ord, unnest(parts) as raw, unnest(range(len(parts))) as pos from (select ord, regexp_split_to_array(line, '\x{{3000}}+|{_W}{{2,}}') as parts from t where line <> '' and not regexp_matches(line, '^(\{{\{{|==)') and line <> '詩曰')),
q as (select ord, pos, {strip("raw")} as term from p)
select ord, pos, term from q where length(term) >= 5 and not regexp_matches(term, '[A-Za-z{{}}\[\]|=#]')""",
    "page_extract": rf"""with p as (select line_no, {clean("alias")} as alias, {clean("meaning")} as g from page_cache where slug is not null),
k as (select *, {strip("regexp_replace(" + strip("regexp_replace(alias, '(?i)^r[uü]yada\\s+', '')") + ", '(?i)\\s+g[oö]rmek$', '')")} as term from p where alias <> '' and length('Dini: ' || g) >= 60)
select line_no, term, alias, md5(substr(case when length(g) >= 60 then g else trim('Dini: ' || g) end, 1, 600)) as meaning_md5 from k where term <> ''""",
    "page_paragraphs": f"select line_no, ((length(trim('Dini: ' || {clean('meaning')})) >= 60)::bigint + (length({clean('meaning')}) >= 60)::bigint) as paragraphs from page_cache where slug is not null",
    "sitemap_slugs": "select distinct slug || '.html' as slug from page_cache where slug is not null",
    "crawl_todo": "select slug from page_cache where slug is not null group by slug having count(meaning) = 0",
    "cache_last_wins": "select lang, md5(text) as text_md5, arg_max_null(v, line_no) as v, min(line_no) as first_line, max(line_no) as last_line from translation_cache where lang is not null and text is not null group by lang, text",
    "page_last_wins": f"with {_PAGES} select slug, v[1] as term, line_no, last_line from pages",
    "marker_slice": f"with {_BOOKS} select entry_id, md5(case when contains(text, '_') then substr(text, instr(text, '_')) else text end) as core_md5 from core",
    "heading_filter": rf"with {_BOOKS}, l as (select entry_id, {strip('unnest(string_split(text, chr(10)))')} as line from books) select entry_id, count(*) filter (length(line) between 1 and 80 and not prefix(line, '[') and regexp_full_match(line, '_[^_\n]{{1,80}}_\.')) as headings, count(*) as n_lines from l group by entry_id",
    "heading_sections": rf"""with {_BOOKS},
l as (select entry_id, unnest(ls) as line, unnest(range(len(ls))) as pos from (select entry_id, regexp_split_to_array(text, '\r\n|\r|\n') as ls from core)),
h as (select *, (length({strip("line")}) between 1 and 80 and not prefix({strip("line")}, '[') and regexp_full_match({strip("line")}, '_[^_\n]{{1,80}}_\.')) as head from l),
s as (select *, count(*) filter (head) over (partition by entry_id order by pos) as section from h),
g as (select entry_id, section, max(line) filter (head) as heading, string_agg(line, chr(10) order by pos) filter (not head) as body from s where section > 0 group by entry_id, section),
t as (select entry_id, section, {strip("regexp_replace(regexp_replace(" + strip("regexp_replace(heading, '\\[\\d+\\]', '', 'g')") + ", '\\.+$', ''), '^_+|_+$', '', 'g')")} as term, {normalize("body")} as meaning from g)
select entry_id, section, term, md5(meaning) as meaning_md5 from t where term <> '' and meaning <> ''""",
    "pattern_pairs": f"""with t as (select entry_id, {strip("term")} as term, unnest(list_transform(meanings, lambda m: coalesce(m.text, ''))) as x, unnest(range(len(meanings))) as pos from dream_terms where regexp_full_match(term, '[^_\n]{{1,80}}')),
n as (select entry_id, pos, term, {normalize("regexp_replace(x, '^[-—]+', '')")} as meaning from t)
select entry_id, pos, term, md5(meaning) as meaning_md5 from n where meaning <> '' and term <> ''""",
    "batch_fill": f"""with recursive {_ITEMS},
n as (select lang, f[1] as entry_id, f[2] as slot, f[1] // 50000 as block, length(text) as n, row_number() over (partition by lang, f[1] // 50000 order by f[1], f[2]) as k from items),
r as (
  select lang, entry_id, slot, block, k, 0 as batch, n + 1 as held, 1 as size from n where k = 1
  union all
  select n.lang, n.entry_id, n.slot, n.block, n.k, r.batch + (r.held + n.n > 3600 or r.size >= 48)::integer, case when r.held + n.n > 3600 or r.size >= 48 then n.n + 1 else r.held + n.n + 1 end,
    case when r.held + n.n > 3600 or r.size >= 48 then 1 else r.size + 1 end
  from r join n on n.lang = r.lang and n.block = r.block and n.k = r.k + 1
)
select lang, entry_id, slot, block, batch from r""",
    "translation_items": f"with {_ITEMS} select lang, md5(text) as text_md5, f[1] as entry_id, f[2]::bigint as slot from items",
    "translation_todo": f"with {_ITEMS} select lang, count(*) as items from items where (lang, text) not in (select (lang, text) from translation_cache where lang is not null and text is not null) group by lang",
    "translate_lookup": "with c as (select lang, text, arg_max_null(v, line_no) as told from translation_cache group by lang, text) select line_no, told from translation_cache left join c using (lang, text)",
    "shortest_surface": "select term_normalized, term from raw_entries where term_normalized is not null and term is not null qualify row_number() over (partition by term_normalized order by length(term), ord) = 1",
    "capped_meanings": """with m as (select term_normalized, unnest(meanings) as m from dream_terms where term_normalized is not null),
f as (select term_normalized, substr(m.text, 1, 36) as p, min(m.meaning_id) as meaning_id from m where m.text is not null group by 1, 2)
select term_normalized, row_number() over (partition by term_normalized order by meaning_id) as place, meaning_id from f qualify place <= 3""",
    "tone_score": f"with {_INDEX.split('normed as')[0].rstrip().rstrip(',')} select row_no, tone from idx",
    "shard_assign": """with k as (select distinct term_normalized as key from dream_terms where term_normalized is not null),
i as (select key, row_number() over (order by key) - 1 as i, count(*) over () as n from k),
z as (select key, i, (n + 127) // 128 as size from i) select key, i, least(i // size, 127) as shard, i - least(i // size, 127) * size as idx from z""",
    "shard_lookup": """with k as (select distinct term_normalized as key from dream_terms where term_normalized is not null),
i as (select key, row_number() over (order by key) - 1 as i, count(*) over () as n from k),
z as (select key, i, (n + 127) // 128 as size from i), f as (select term_normalized as key, arg_min(term, entry_id) as term, arg_min(meaning_count, entry_id) as meaning_count from dream_terms group by term_normalized)
select i as row_no, least(i // size, 127) as shard, i - least(i // size, 127) * size as idx, term, key, meaning_count::bigint as meaning_count from z join f using (key) where i % 50 = 0""",
    "lexicon_features": f"with {_INDEX} select row_no, phrase, array_to_string(kanji, '|') as kanji, array_to_string(other, '|') as other, array_to_string(latin, '|') as latin from feats",
    "keyword_classes": f"with {_INDEX} select kw, count(*) as uses from (select unnest(list_concat(list_concat(kanji, other), latin)) as kw from feats) group by kw",
    "synonym_bridge": f"with {_CONTEXT} select ord, array_to_string(kanji_runs, '|') as runs from ctx",
    "match_candidates": f"with {_CANDIDATES_WHOLE} select ord, row_no, score, phrase_hit, ja_full from cand where score > 0",
    "match_topk": f"with {_CANDIDATES_WHOLE} select ord, row_no, score, place from topk",
    "match_diverse": f"with recursive {_DIVERSE} select ord, row_no, score, n as place from walk where taken",
    "theme_scores": f"""with {_CANDIDATES},
i as (select ord, place, v, case when tone <> 0 then tone else sign({_hits("v", pack.READING_GOOD)} - {_hits("v", pack.READING_ILL)})::bigint end as polarity from topk),
h as (select ord, place, polarity, unnest({_THEMES}) as h from i),
g as (select ord, h.theme as theme, h.theme_no as theme_no, sum(h.hits)::bigint as score, sum(polarity * h.hits)::bigint as polarity, min(place) as first_place from h where h.hits > 0 group by all)
select ord, theme, score, polarity, first_place, row_number() over (partition by ord order by score desc, first_place, theme_no) as rank from g""",
    "pair_insight": "select ord, case " + " ".join(f"when {_any('meaning', a)} and {_any('meaning', b)} then {n}" for n, (a, b) in enumerate(pack.PAIR_RULES, 1)) + " else 0 end::bigint as rule from raw_entries where meaning is not null",
    "reading_pool": f"with {_POOL} select ord, row_no, pool_place from pool",
    "tone_mood": f"with {_POOL}, g as (select ord, count(*) filter (tone = 1) as good, count(*) filter (tone = -1) as ill from pool group by ord) select ord, good, ill, case when good > 0 and ill > 0 then 'mixed' when good > 0 then 'pos' when ill > 0 then 'neg' else 'neutral' end as mood from g",
    "tone_digest": f"with {_CANDIDATES}, g as (select ord, count(*) filter (tone = 1) as good, count(*) filter (tone = -1) as ill from topk group by ord) select ord, case when good = 0 and ill = 0 then '中' else concat_ws(' / ', case when good > 0 then '吉' || good end, case when ill > 0 then '注意' || ill end) end as digest from g",
    "dict_search": f"""with {_INDEX},
q as (select query, {norm_key("query")} as q from (select distinct term as query from idx where row_no % 50 = 0)),
z as (select query, q, {phrase_key("q")} as fold from q),
r as (select query, row_no, length(term) as n, case when phrase = fold then 4 when prefix(phrase, fold) then 3 when contains(phrase, fold) then 2 when contains(latin_phrase, q) then 1 when contains(orig_norm, q) and length(q) >= 3 then 1 else 0 end::bigint as rank from feats cross join z where fold <> '')
select query, row_no, rank, row_number() over (partition by query order by rank desc, n, row_no) as place from r where rank > 0 qualify place <= 20""",
    "stride_sample": f"""with {_INDEX}, n as (select count(*) as n from feats), t as (select row_no, term, (((row_no - 5) % n) + n) % n as step from feats, n)
select row_no, term from t where step % 97 = 0 and length(term) between 1 and 4 and not regexp_matches(term, '[a-z]') order by step limit 8""",
    "history_latest60": "select user_id, event_id, row_number() over (partition by user_id order by ts desc nulls last, event_id desc) as place from events qualify place <= 60",
    "history_delete": "select event_id, user_id from events where event_id not in (1, 5, 50)",
    "event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events where ts is not null group by all",
}
