"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op3_warc"] = r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload) as n, sha1(payload) as digest, sha256(payload) as k from p),
g as (select k, max(page_id) as last from q where n >= 1000 group by k)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when last is not null and page_id <> last then 'revisit' else 'response' end as record_type,
       case when last is not null and page_id <> last then last end as refers_to
from q left join g using (k)
"""

SQL["op5_line_dedup"] = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
  from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, coalesce(k.doc_id <> r.last, false) as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""

SQL["op7_decontaminate"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, least(8, len(w)) as n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
       from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), sizes where i + n - 1 <= len(w)),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from h)) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, cast(item_id as varchar) as s from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""

SQL["op2_near_dedup"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 1], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
rare as (select s from s group by s having count(*) > 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (s) join rare using (s) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on r.b = e.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from m left join n using (doc_id)
"""

SQL["op6_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
w as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as win from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from d)),
f as (select win, min((doc_id, i)) as first from w group by win having count(*) > 1),
g as (select distinct doc_id, p from (select w.doc_id, unnest(range(w.i, w.i + 20)) as p from w join f using (win) where (w.doc_id, w.i) > f.first)),
t as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
k as (select t.doc_id, count(*) filter (g.p is not null) as n_removed, string_agg(word, ' ' order by t.p) filter (g.p is null) as kept
      from t left join g on g.doc_id = t.doc_id and g.p = t.p group by t.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""

SQL["op1_suffix_dedup"] = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, pos, substring(h, 2 * pos + 1, 698) as c from (select doc_id, h, unnest(range(0, len(h) // 2, 300)) as pos from d)),
w as (select doc_id, pos + j as i, substring(c, 2 * j - 1, 100) as win from (select doc_id, pos, c, unnest(range(1, greatest(len(c) // 2 - 48, 1))) as j from c)),
f as (select win, min(doc_id) as first from w group by win having count(*) > 1),
g as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from w join f using (win) where doc_id > first),
n as (select doc_id, i, sum(case when gap <= 50 then 0 else 1 end) over (partition by doc_id order by i) as run from g),
r as (select doc_id, run, min(i) as s, max(i) + 50 as e from n group by doc_id, run),
p as (select doc_id, e, lead(s) over (partition by doc_id order by s) as next from r
      union all select doc_id, 1, min(s) from r group by doc_id),
k as (select d.doc_id, coalesce(string_agg(substring(h, 2 * e - 1, 2 * (coalesce(next, len(h) // 2 + 1) - e)), '' order by e), '') as kept
      from d join p using (doc_id) group by d.doc_id),
t as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans from r group by doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join k using (doc_id) left join t using (doc_id)
"""


def _quality() -> str:
    from .quality import COMMON, MAX_CHARS_JSD, MAX_REPEATED, MAX_WORDS_JSD, MIN_CHARS, MIN_WORDS

    common = " ".join(f"when '{k}' then [{', '.join(repr(w) for w in v.split())}]" for k, v in COMMON.items())
    codes = ", ".join(map(repr, COMMON))
    size = lambda x: f"(length(t) - length(regexp_replace(t, '{x}', '', 'g')))"
    classes = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09\x0B-\x0D]", r"\n", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x00-\x08\x0E-\x1F]", r"[^\x00-\x7F]"]
    jsd = lambda p, q: f"(select sqrt(greatest(sum(case when a > 0 then 0.5 * a * log2(2 * a / (a + b)) else 0 end + case when b > 0 then 0.5 * b * log2(2 * b / (a + b)) else 0 end), 0)) from (select unnest({p}) as a, unnest({q}) as b))"
    return rf"""
with t as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         case when lower(lang) in ({codes}) then lower(lang) else 'other' end as lang
  from documents),
d as (
  select *, cast(len(w) as bigint) as n_words, case lang {common} else [] end as common, list_transform(w, lambda x: lower(x)) as low,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         list_transform([{', '.join(map(size, classes))}], lambda x: x / greatest(length(t), 1)) as p
  from t),
f as (select *, list_transform(common, lambda c: len(list_filter(low, lambda x: x = c)) / greatest(n_words, 1)) as q from d),
win as (select doc_id, i, w[i:i + 2] as win from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from t)),
again as (select doc_id, win from win group by doc_id, win having count(*) > 1),
rep as (select doc_id, count(distinct pos) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as pos from win join again using (doc_id, win)) group by doc_id),
means as (select lang, k, 'p' as what, avg(x) as x from (select lang, unnest(p) as x, unnest(range(1, len(p) + 1)) as k from f) group by lang, k
          union all select lang, k, 'q', avg(x) from (select lang, unnest(q) as x, unnest(range(1, len(q) + 1)) as k from f) group by lang, k),
refs as (select lang, coalesce(list(x order by k) filter (what = 'p'), []) as rp, coalesce(list(x order by k) filter (what = 'q'), []) as rq from means group by lang),
b as (
  select f.doc_id, n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         n_words < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEATED} * n_words as base_failed,
         case when length(t) >= {MIN_CHARS} then {jsd("p", "rp")} else 0 end as chars_jsd,
         case when n_words >= {MIN_WORDS} and f.lang <> 'other'
              then {jsd("list_prepend(greatest(1 - list_sum(q), 0), q)", "list_prepend(greatest(1 - list_sum(rq), 0), rq)")} else 0 end as words_jsd
  from f join refs using (lang) left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (chars_jsd > {MAX_CHARS_JSD} or words_jsd > {MAX_WORDS_JSD}) as kept
from b
"""


SQL["op9_quality"] = _quality()


def _secrets() -> str:
    from .secrets import BASE, RULES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {quoted(r.kind)}, {quoted(r.pattern)}, {r.least})" for i, r in enumerate(RULES))
    # regexp_extract takes no group from a column
    group = " ".join(f"when {i} then length(regexp_extract(m, pattern, {r.group}))" for i, r in enumerate(RULES))
    begin, end = "chr(57344)", "chr(57345)"
    counts = ", ".join(f"count(*) filter (kind = {i}) as n_{r.kind}" for i, r in enumerate(BASE))
    line = "string_agg(name || ':' || s || ':' || e, ',' order by s, kind)"
    return rf"""
with rules(kind, name, pattern, least) as (values {rules}),
p as (
  select doc_id, kind, name, pattern, least, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as k
  from (select doc_id, rules.*, string_split(regexp_replace(coalesce(text, ''), pattern, {begin} || '\0' || {end}, 'g'), {begin}) as parts from documents, rules)),
m as (
  select *, string_split(part, {end})[1] as m,
         sum(length(part) - case when k > 1 then 1 else 0 end) over (partition by doc_id, kind order by k rows between unbounded preceding and 1 preceding) as s
  from p),
f as (select doc_id, kind, name, cast(s as bigint) as s, cast(s + length(m) as bigint) as e from m where k > 1 and case kind {group} end >= least),
a as (select doc_id, {counts}, {line} filter (kind < {len(BASE)}) as base, {line} as spans from f group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join a using (doc_id)
"""


SQL["op10_secrets"] = _secrets()
