"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from glossmill.llm.canonical import mapping

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pN_]+'), lambda w: w <> '')"

P7 = rf"""
with iw as (select item_id, {_WORDS} as w from eval_items where text is not null),
ig as (select distinct item_id, array_to_string(w[k:k+7], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 6)) as k from iw)),
dw as (select doc_id, {_WORDS} as w from documents where text is not null),
dg as (select distinct doc_id, array_to_string(w[k:k+7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as k from dw))
select distinct doc_id, item_id from dg join ig using (g)
"""

P7_LEAKS = rf"""
with iw as (select item_id, {_WORDS} as w from eval_items where text is not null),
ig as (select item_id, k, array_to_string(w[k:k+7], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 6)) as k from iw)),
dw as (select doc_id, {_WORDS} as w from documents where text is not null),
dg as (select doc_id, k, array_to_string(w[k:k+7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as k from dw)),
met as (select doc_id, item_id, dg.k as d, dg.k - ig.k as shift from dg join ig using (g)),
runs as (select *, d - row_number() over (partition by doc_id, item_id, shift order by d) as run from met),
long as (select doc_id, item_id, count(*) + 7 as n_words, min(d) - 1 as at_word from runs group by doc_id, item_id, shift, run)
select doc_id, item_id, n_words, at_word from long qualify row_number() over (partition by doc_id, item_id order by n_words desc, at_word) = 1
"""

_LETTERS = r"regexp_replace(replace(lower(upper(m.text)), 'i̇', 'i'), '[\p{P}\p{S}\p{Z}\p{Cf}\p{Nd}\x00-\x09\x0B-\x1F\x7F-\x9F]+', '', 'g')"

P2 = rf"""
with m as (select unnest(meanings) as m from dream_terms),
t as (select m.meaning_id as meaning_id, m.source_name as s, {_LETTERS} as x from m where m.source_name is not null and m.text is not null),
l as (select meaning_id, s, unnest(string_split(x, chr(10))) as line, unnest(range(1, len(string_split(x, chr(10))) + 1)) as line_no from t),
n as (select m.source_name as s, count(*) as total from m group by 1),
c as (select s, line, count(distinct meaning_id) as texts from l where line <> '' group by all),
r as (select s, line from c join n using (s) where texts >= 5 and texts >= 0.01 * total)
select meaning_id, line_no::integer as line_no from l join r using (s, line)
"""

_DROP = r"[\pP\pZ\s$+<=>^`|~]+"


def _fold(x: str) -> str:
    return f"replace(lower(regexp_replace(upper({x}), '{_DROP}', '', 'g')), 'i̇', 'i')"


_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '[;|\r\n]+'), lambda p: trim(p)), lambda p: p <> '')"
_FIELDED = rf"len({_PARTS}) >= 2 and len(list_filter({_PARTS}, lambda p: regexp_matches(p, '(?s)^[^:：]+[:：]\s*\S'))) = len({_PARTS})"
_RECORDS = f"""
m as (select term_normalized, unnest(meanings) as m from dream_terms),
t as (select m.meaning_id as id, {_fold("coalesce(term_normalized, '')")} as k, m.text as text from m where m.text is not null),
c as (select id, k, case when {_FIELDED} then array_to_string(list_sort(list_transform({_PARTS}, lambda p: {_fold("p")})), chr(1)) else {_fold("text")} end as form from t),
g as (select k, form, min(id) as keep_id, count(*) as copies from c group by k, form)"""

P2_CLEAN = P2.replace("select meaning_id, line_no::integer as line_no from l join r using (s, line)", "").rstrip() + """,
d as (select meaning_id, list(line_no) as gone from l join r using (s, line) group by meaning_id)
select m.meaning_id as meaning_id, m.source_name as source_name,
  case when gone is null then m.text else array_to_string(list_filter(string_split(m.text, chr(10)), lambda x, k: not list_contains(gone, k)), chr(10)) end as text
from m left join d on d.meaning_id = m.meaning_id"""

def _forms() -> str:
    """``forms``: field, id, text and its single form, by a table of replacements and composition."""
    table = ", ".join(f"({cp}, '{to.replace(chr(39), chr(39) * 2)}')" for cp, to in mapping())
    return f"""
mapping(cp, r) as (values {table}),
texts as (
  select 'term' as field, entry_id as id, term_normalized as text from dream_terms
  union all select 'text', m.meaning_id, m.text from (select unnest(meanings) as m from dream_terms)
),
chars as (select field, id, c, k from (select field, id, unnest(cs) as c, unnest(range(len(cs))) as k from (select field, id, regexp_extract_all(text, '(?s).') as cs from texts where text is not null))),
built as (select field, id, nfc_normalize(string_agg(coalesce(r, c), '' order by k)) as form from chars left join mapping on cp = unicode(c) group by field, id),
forms as (select field, id, text, case when text is not null then coalesce(form, '') end as form from texts left join built using (field, id))"""


SQL: dict[str, str] = {
    "p2_found": P2,
    "p2_clean": P2_CLEAN,
    "p3_forms": f"with {_forms()} select * from forms",
    "p3_found": f"with {_forms()} select a.field, a.id as id_a, b.id as id_b from forms a join forms b on a.field = b.field and a.form = b.form and a.text <> b.text and a.id < b.id",
    "p6_found": f"with {_RECORDS} select keep_id, id as copy_id from c join g using (k, form) where id <> keep_id",
    "p6_records": f"with {_RECORDS} select keep_id, copies from g",
    "p7_found": P7,
    "p7_leaks": P7_LEAKS,
}
