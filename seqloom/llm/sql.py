"""DuckDB's answers to the queries that SQL can express over whole tables."""

_LETTERS = "regexp_replace(upper({}), '[^A-Z]', '', 'g')"
_FASTA = f"select rec_ordinal, {_LETTERS.format('sequence')} as s from fasta where sequence is not null"
_CLEAN = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"

P1_FOUND = f"""
with f as ({_FASTA}), classes as (select s, min(rec_ordinal) as c from f where length(s) >= 11 group by s),
k as (select distinct c, substr(s, i::bigint, 11) as w from classes, lateral unnest(generate_series(1, length(s) - 10)) as t(i)),
n as (select c, count(*) as n from k group by c),
both_in as (select a.c as a, b.c as b, count(*) as m from k a join k b on a.w = b.w and a.c < b.c group by 1, 2),
near as (select a, b from both_in join n x on x.c = a join n y on y.c = b where m / (x.n + y.n - m) >= 0.6),
members as (select rec_ordinal, c from f join classes using (s))
select least(x.rec_ordinal, y.rec_ordinal) as rec_a, greatest(x.rec_ordinal, y.rec_ordinal) as rec_b
from near join members x on x.c = a join members y on y.c = b"""

_CANON = f"""
canon as (
  select 'fasta' as tbl, s as canon, rec_ordinal::bigint as key from ({_FASTA}) where length(s) > 0
  union all
  select 'reference_groups', {_CLEAN.format('target_group_id')} || '|' || coalesce(list_aggregate(list_sort(list_distinct(list_filter(
    list_transform(regexp_split_to_array(array_to_string(member_ids, ';'), '[;,]'), lambda x: {_CLEAN.format('x')}), lambda x: x <> ''))), 'string_agg', ','), ''),
    group_ordinal::bigint
  from reference_groups where target_group_id is not null and member_ids is not null)"""

P2_FOUND = f"""with {_CANON}, firsts as (select *, min(key) over (partition by tbl, canon) as a from canon)
select tbl, a as key_a, key as key_b from firsts where key <> a"""

P2_COLLAPSED = f"with {_CANON} select tbl, min(key) as representative, count(*) as copies from canon group by tbl, canon"

_LEDGER = """ledger as (select ordinal, min(k) as key from (select ordinal, regexp_replace(lower(trim(key)), '^0x', '') as k from sample_keys) where regexp_matches(k, '^[0-9a-f]{32}$') group by ordinal)"""


def _draw(name: str, rows: str, ledger: str) -> str:
    """CTEs of a draw from `rows` of fragments with a ledger (ordinal, key, origin); `name` is the selection."""
    return f"""{name}_once as (select ordinal, min(run_id) as run_id, min(coalesce(piece_no, -1)) as piece_no from {rows} where ordinal is not null group by ordinal),
{name}_rows as (select o.*, l.key, l.origin, sha256('seqloom-ledger-1|' || ordinal) as priority from {name}_once o left join {ledger} l using (ordinal)),
{name}_ranked as (select *, row_number() over (partition by run_id, piece_no, key is null order by priority, ordinal) as r,
  ceil(count(*) over w * 0.125::double) - count(key) over w as quota from {name}_rows window w as (partition by run_id, piece_no)),
{name} as (select ordinal, run_id, piece_no, coalesce(origin, 'growth') as origin, coalesce(key, priority) as priority from {name}_ranked where key is not null or r <= quota)"""


P3_SAMPLE = f"with {_LEDGER}, first_ as (select *, 'ledger' as origin from ledger), {_draw('s', 'fragments', 'first_')} select * from s"
P3_GROWN = f"""with {_LEDGER}, first_ as (select *, 'ledger' as origin from ledger),
early_rows as (select * from fragments where coalesce(piece_no, -1) * 2 <= (select coalesce(max(piece_no), 0) from fragments)), {_draw('e', 'early_rows', 'first_')},
second_ as (select ordinal, key, origin from first_ union all select ordinal, priority, origin from e where origin = 'growth'), {_draw('s', 'fragments', 'second_')}
select s.ordinal, s.run_id, s.origin, e.ordinal is not null as early from s full join e on s.ordinal = e.ordinal"""

P4_FOUND = f"""
with f as ({_FASTA}), r as (select distinct ordinal, {_LETTERS.format('r1')} as s from fragments),
fw as (select rec_ordinal as k, i - 1 as a, substr(s, i::bigint, 42) as w from f, lateral unnest(generate_series(1, length(s) - 41)) as t(i)),
rw as (select ordinal as k, i - 1 as a, substr(s, i::bigint, 42) as w from r, lateral unnest(generate_series(1, length(s) - 41)) as t(i)),
held as (select w, min(k) as lo, max(k) as hi from fw group by w),
hits as (select 'fasta' as tbl, k, a from fw join held using (w) where lo < hi union all select 'fragments', k, a from rw join held using (w)),
marked as (select *, case when a <= lag(a) over (partition by tbl, k order by a) + 42 then 0 else 1 end as fresh from hits),
numbered as (select *, sum(fresh) over (partition by tbl, k order by a) as stretch from marked)
select tbl, k::bigint as rec_key, min(a)::bigint as span_start, (max(a) + 42)::bigint as span_end from numbered group by tbl, k, stretch"""

_WORDS = r"regexp_extract_all(lower(regexp_replace({}, '\\+[nrt]', ' ', 'g')), '[a-z0-9]+')"
_GRAMS = """select {key}, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select {key}, {words} as w from {tbl} where text is not null),
  lateral unnest(generate_series(1, len(w) - 11)) as t(i)"""
P7_FOUND = f"""
with i as (select distinct * from ({_GRAMS.format(key='item_id', words=_WORDS.format('text'), tbl='eval_items')})),
d as ({_GRAMS.format(key='doc_id', words=_WORDS.format('text'), tbl='documents')})
select distinct doc_id, item_id from d join i using (g)"""

_PLACED = """select {key}, i - 1 as pos, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select {key}, {words} as w from {tbl} where text is not null),
  lateral unnest(generate_series(1, len(w) - 11)) as t(i)"""
P7_MATCHES = f"""
with i as ({_PLACED.format(key='item_id', words=_WORDS.format('text'), tbl='eval_items')}),
d as ({_PLACED.format(key='doc_id', words=_WORDS.format('text'), tbl='documents')}),
m as (select distinct doc_id, item_id, d.pos - i.pos as diagonal, d.pos as pos from d join i using (g)),
n as (select *, pos - row_number() over (partition by doc_id, item_id, diagonal order by pos) as island from m),
spans as (select doc_id, item_id, count(*) + 11 as longest, min(pos) as place from n group by doc_id, item_id, diagonal, island)
select doc_id, item_id, max(longest)::bigint as longest, arg_min(place, {{'l': -longest, 'p': place}})::bigint as word_offset from spans group by 1, 2"""

P7_CLEAN = f"select doc_id, source from documents where doc_id not in (select doc_id from ({P7_FOUND}))"

P4_SHARES = f"""
with spans as ({P4_FOUND}), sizes as (
  select 'fasta' as tbl, rec_ordinal::bigint as rec_key, coalesce(max(length({_LETTERS.format('sequence')})), 0)::bigint as n_letters from fasta group by rec_ordinal
  union all select 'fragments', ordinal, coalesce(max(length({_LETTERS.format('r1')})), 0)::bigint from fragments group by ordinal),
sums as (select tbl, rec_key, sum(span_end - span_start)::bigint as covered from spans group by 1, 2)
select tbl, rec_key, n_letters, coalesce(covered, 0)::bigint as covered, case when n_letters > 0 then coalesce(covered, 0) / n_letters else 0.0::double end as share
from sizes left join sums using (tbl, rec_key)"""

P1_GROUPS = f"""
with recursive f as ({_FASTA}), classes as (select s, min(rec_ordinal) as c from f where length(s) > 0 group by s),
k as (select distinct c, substr(s, i::bigint, 11) as w from classes, lateral unnest(generate_series(1, length(s) - 10)) as t(i)),
n as (select c, count(*) as n from k group by c),
both_in as (select a.c as a, b.c as b, count(*) as m from k a join k b on a.w = b.w and a.c < b.c group by 1, 2),
near as (select a, b from both_in join n x on x.c = a join n y on y.c = b where m / (x.n + y.n - m) >= 0.6),
edges as (select a, b from near union all select b, a from near),
reach as (select c, c as g from classes union select e.b, r.g from reach r join edges e on e.a = r.c),
grouped as (select c, min(g) as g from reach group by c), linked as (select a as c, count(*) as links from edges group by a),
evidence as (select group_ordinal, sum(cross_group_ambiguous_fragments) as ambiguous from (select distinct run_id, group_ordinal, cross_group_ambiguous_fragments from group_evidence) group by group_ordinal),
named as (select lower(trim(representative_id)) as name, sum(ambiguous)::bigint as ambiguous from reference_groups join evidence using (group_ordinal) where representative_id is not null group by 1)
select f.rec_ordinal, g as group_rec, coalesce(links, 0)::bigint as links, ambiguous
from f join classes using (s) join grouped using (c) left join linked using (c) join fasta r on r.rec_ordinal = f.rec_ordinal left join named on name = lower(trim(r.id))"""

P5_SIZES = """with own as (select ordinal, min(run_id) as run_id from fragments where ordinal is not null group by ordinal), n as (select run_id, count(*) as n from own group by run_id)
select run_id, least(n, capacity)::bigint as sampled, least(n, capacity)::bigint as fragments, 0::bigint as strangers from n join sampling_design using (run_id)"""
P6_PLACED = "select doc_id, count(*) as texts, 0::bigint as gaps, 0::bigint as overfull from documents group by doc_id"
P8_REJOINED = "select doc_id, sha256(text) as digest from documents where text is not null"

SQL = {
    "p1_found": P1_FOUND, "p1_groups": P1_GROUPS, "p2_found": P2_FOUND, "p2_collapsed": P2_COLLAPSED, "p3_sample": P3_SAMPLE, "p3_grown": P3_GROWN,
    "p4_found": P4_FOUND, "p4_shares": P4_SHARES, "p5_sizes": P5_SIZES, "p6_placed": P6_PLACED, "p7_found": P7_FOUND, "p7_matches": P7_MATCHES, "p7_clean": P7_CLEAN, "p8_rejoined": P8_REJOINED,
}
