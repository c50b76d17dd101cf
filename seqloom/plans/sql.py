"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from seqloom.constants import ALPHABET, COMPLEMENT, DUST_THRESHOLD, DUST_WINDOW, FORWARD_CODE, KMER, MIN_COVERED, MIN_HITS, REVERSE_CODE, TOP_ROWS

_LETTERS = "regexp_replace(upper({}), '[^A-Z]', '', 'g')"
_RC = f"translate(reverse({{}}), '{ALPHABET}', '{COMPLEMENT}')"
_CANON = f"least(sequence, {_RC.format('sequence')})"
_REC = f"""rec as (select * from (select rec_ordinal, source, regexp_extract(trim(id), '^(\\S+)', 1) as id,
  trim(regexp_replace(trim(coalesce(description, '')), '^\\|+', '')) as description, {_LETTERS.format('sequence')} as sequence,
  coalesce(lower(trim(source)) = 'host.fa', false) as is_host from fasta) where id <> '' and regexp_matches(sequence, '^[{ALPHABET}]+$'))"""
_ONCE = "once as (select ordinal, min(run_id) as run_id, min(r1) as r1, min(r2) as r2 from fragments where ordinal is not null group by ordinal)"
_ENDS = "ends as (select ordinal, 1 as mate, r1 as sequence from once where r1 is not null union all select ordinal, 2, r2 from once where r2 is not null)"


def _kmers(keys: str, source: str, canonical: bool = True) -> str:
    w = f"substr(t, i::bigint, {KMER})"
    f, r = f"translate({w}, '{ALPHABET}', '{FORWARD_CODE}')", f"translate(reverse({w}), '{ALPHABET}', '{REVERSE_CODE}')"
    code = f"least({f}, {r})" if canonical else f
    return f"""(select {keys}, (i - 1)::int as pos, {code} as kmer
  from (select {keys}, regexp_replace(upper(sequence), '[^{ALPHABET}]', '-', 'g') as t from {source}) x, lateral unnest(generate_series(1, length(t) - {KMER - 1})) as s(i)
  where not contains({w}, '-'))"""


_TK = f"tk as (select kmer, count(distinct rec_ordinal) as records from {_kmers('rec_ordinal', '(select * from rec where not is_host)')} group by kmer)"
_EK = f"ek as (select * from {_kmers('ordinal, mate', 'ends')})"
_HITS = "h as (select ordinal, mate, pos from ek where kmer in (select kmer from tk))"
_STATES = f"""w as (select *, least({KMER}, coalesce(pos - lag(pos) over (partition by ordinal, mate order by pos), {KMER})) as new from h),
per as (select ordinal, mate, count(*) as hits, sum(new)::bigint as covered from w group by 1, 2),
seen as (select distinct ordinal, mate from ek),
states as (select e.ordinal, e.mate, coalesce(hits, 0)::bigint as hits, coalesce(covered, 0)::bigint as covered, hits is not null as present, s.ordinal is not null as evaluable,
  coalesce(hits >= {MIN_HITS} and covered >= {MIN_COVERED}, false) as chain_ok
  from ends e left join per using (ordinal, mate) left join seen s on s.ordinal = e.ordinal and s.mate = e.mate)"""
_VERDICTS = """verdicts as (select o.ordinal, case when bool_or(present) and bool_or(chain_ok) then 'Pass' when coalesce(bool_or(evaluable), false) then 'Negative' else 'NotEvaluable' end as verdict
  from once o left join states using (ordinal) group by o.ordinal)"""
# The low-complexity mask by its definition. A perfect interval ends with a triplet that occurs in it before, so those are
# the ends looked at; reads in which no triplet comes five times within the window have none.
_DUST = f"""tri0 as (select ordinal, mate, i as pos, substr(upper(sequence), i::bigint, 3) as t from ends, lateral unnest(generate_series(1, length(sequence) - 2)) as s(i)),
tri1 as (select *, regexp_matches(t, '^[ACGT]{{3}}$') as good, count(*) filter (not regexp_matches(t, '^[ACGT]{{3}}$')) over (partition by ordinal, mate order by pos) as brk from tri0),
tri as (select ordinal, mate, pos, t, brk, min(pos) over (partition by ordinal, mate, brk) as head from tri1 where good),
many as (select distinct ordinal, mate from (select ordinal, mate, pos - lag(pos, 4) over (partition by ordinal, mate, t order by pos) as d from tri) where d < {DUST_WINDOW - 2}),
pairs as (select a.ordinal, a.mate, a.pos as a, b.pos as b, a.head from tri a join many using (ordinal, mate) join tri b on a.ordinal = b.ordinal and a.mate = b.mate and a.t = b.t and a.brk = b.brk and a.pos < b.pos and b.pos - a.pos < {DUST_WINDOW - 2}),
per_end as (select ordinal, mate, i, b, count(*) as c from pairs, lateral unnest(generate_series(greatest(head, b - {DUST_WINDOW - 3}), a)) as s(i) group by 1, 2, 3, 4),
scored as (select ordinal, mate, i, b, sum(c) over (partition by ordinal, mate, i order by b) / (b - i) as score from per_end),
high as (select * from scored where score > {DUST_THRESHOLD / 10}),
perfect as (select ordinal, mate, i - 1 as s, b + 2 as e from high h where not exists (select 1 from high x where x.ordinal = h.ordinal and x.mate = h.mate and x.i >= h.i and x.b <= h.b and x.score > h.score)),
begun as (select *, case when s <= max(e) over (partition by ordinal, mate order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from perfect),
pieces as (select *, sum(fresh) over (partition by ordinal, mate order by s, e) as piece from begun),
mask as (select ordinal, mate, min(s)::int as s, max(e)::int as e from pieces group by ordinal, mate, piece)"""
_OPEN = "not exists (select 1 from mask m where m.ordinal = {0}.ordinal and m.mate = {0}.mate and m.s <= {0}.pos and {0}.pos < m.e)"
_MASKED = _STATES.replace("seen as (select distinct ordinal, mate from ek)", f"seen as (select distinct ordinal, mate from ek where {_OPEN.format('ek')}),\nshown as (select distinct ordinal, mate from h where {_OPEN.format('h')})").replace(
    "hits is not null as present", "exists (select 1 from shown x where x.ordinal = e.ordinal and x.mate = e.mate) as present")
_MASKED_GATE = f"with {_REC}, {_ONCE}, {_ENDS}, {_TK}, {_EK}, {_HITS}, {_DUST}, {_MASKED}, {_VERDICTS}"
_GATE = f"with {_REC}, {_ONCE}, {_ENDS}, {_TK}, {_EK}, {_HITS}, {_STATES}, {_VERDICTS}"

_GROUPS = f"""members as (select sha256({_CANON}) as digest, id, min(description) as description, max(length(sequence)) as n from rec where not is_host group by 1, 2),
grouped as (select 'sha256:' || digest as target_group_id, list(id order by id) as ids, first(id order by id) as representative_id, first(description order by id) as representative_description,
  max(n)::bigint as representative_length from members group by digest),
numbered as (select *, row_number() over (order by target_group_id) - 1 as group_ordinal from grouped)"""

_CONTIGS = f"""contigs_ as (select 'host_' || (row_number() over (order by rec_ordinal) - 1) as name, 'HOST' as role, null::bigint as target_group_ordinal, sequence from rec where is_host
union all select 'target_' || group_ordinal, 'TARGET', group_ordinal, arg_min(sequence, rec_ordinal) from numbered n join rec r on not is_host and r.id = n.representative_id and 'sha256:' || sha256({_CANON}) = n.target_group_id group by group_ordinal)"""

_READ_ID = "regexp_replace(regexp_extract(id, '^\\s*(\\S+)', 1), '/[12]$', '')"
_KEYED = f"""keyed as (select ordinal, run_id, id, substr(sha256('seqloom-fragment-v1||' || length(id) || '|' || id || '|' || ordinal), 1, 32) as key
  from (select ordinal, min(run_id) as run_id, min(coalesce({_READ_ID}, '')) as id from fragments where ordinal is not null group by ordinal))"""
_DESIGN = "design as (select run_id, max(capacity) as k from sampling_design group by run_id)"
_SCREEN = "screen as (select * from (select keyed.*, k, row_number() over (partition by run_id order by key, ordinal) as r from keyed join design using (run_id)) where r <= k)"
_FULL = "full_ as (select * from (select keyed.*, k, row_number() over (partition by run_id order by key, ordinal) as r from keyed join design using (run_id) join verdicts using (ordinal) where verdict = 'Pass') where r <= k)"
_SCALARS = """counts as (select run_id, count(*) as n, count(*) filter (verdict = 'Pass') as passed from keyed join verdicts using (ordinal) group by run_id),
sized as (select d.run_id, lower(mode) as mode, lower(precision) as precision, capacity, coalesce(n, 0) as input_fragments, case when lower(mode) = 'full' then coalesce(passed, 0) else coalesce(n, 0) end as population
  from sampling_design d left join counts using (run_id)),
scalars as (select *, least(population, capacity) as selected, case precision when 'fast' then 1.0::double / 10000 when 'standard' then 1.0::double / 100000 when 'sensitive' then 1.0::double / 1000000 end as delta from sized)"""

_USABLE = """u as (select ordinal, mate, upper(role) as role, target_group_ordinal, greatest(coalesce(alignment_score, 0), 0) as alignment_score, query_length, query_start, query_end,
  target_start, target_end, coalesce(supplementary, false) as supplementary, greatest(coalesce(alignment_score, 0), 0) / query_length as ratio
  from hits where query_length > 0 and ordinal is not null and mate is not null and (upper(role) = 'HOST' or (upper(role) = 'TARGET' and target_group_ordinal is not null)))"""
_BEST = """b as (select ordinal, mate, count(*) as hits, max(ratio) filter (role = 'HOST') as best_host, max(ratio) filter (role = 'TARGET') as best_target from u group by 1, 2)"""
_TIED = """t as (select ordinal, mate, target_group_ordinal, bool_or(exists (select 1 from u h where h.ordinal = x.ordinal and h.mate = x.mate and h.role = 'HOST' and (h.supplementary or x.supplementary)
    and (x.query_end <= h.query_start or h.query_end <= x.query_start))) as split
  from u x join b using (ordinal, mate) where role = 'TARGET' group by 1, 2, 3 having bool_or(ratio = best_target))"""
_KIND = """f as (select ordinal, count(best_target) as target_ends, bool_or(coalesce(best_host >= best_target, false)) as confounded, bool_or(best_target is null and best_host is not null) as host_only from b group by ordinal),
g as (select ordinal, target_group_ordinal as group_ordinal, count(*) as in_ends, bool_or(split) as split from t group by 1, 2),
c as (select ordinal, count(*) filter (in_ends = target_ends) as common from g join f using (ordinal) group by ordinal),
kinds as (select f.*, coalesce(common, 0) as common, case when target_ends = 0 then 'NoTargetEvidence' when confounded then 'Confounded' when common = 1 then 'Supporting' else 'Unresolved' end as kind from f left join c using (ordinal)),
chosen as (select ordinal, kind, group_ordinal, split, kind = 'Supporting' and target_ends = 1 and host_only as lone from kinds join g using (ordinal) where kind = 'Confounded' or common = 0 or in_ends = target_ends)"""
_ADJ = f"{_USABLE}, {_BEST}, {_TIED}, {_KIND}"
_RUN = "runs as (select ordinal, min(run_id) as run_id from fragments where ordinal is not null group by ordinal)"
_INTERVALS = """intervals as (select * from (select ordinal, run_id, c.group_ordinal, least(target_start, target_end) as start, least(greatest(target_start, target_end), representative_length) as "end"
  from chosen c join u using (ordinal) join b using (ordinal, mate) join runs using (ordinal) left join reference_groups r on r.group_ordinal = c.group_ordinal
  where kind = 'Supporting' and role = 'TARGET' and u.target_group_ordinal = c.group_ordinal and ratio = best_target) where start < "end")"""
_COVER = """once_i as (select distinct run_id, group_ordinal, start, "end" from intervals),
marked as (select *, case when start <= max("end") over (partition by run_id, group_ordinal order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from once_i),
islands as (select *, sum(fresh) over (partition by run_id, group_ordinal order by start, "end") as island from marked),
cover as (select run_id, group_ordinal, min(start) as start, max("end") as "end" from islands group by run_id, group_ordinal, island)"""
_OCCUPIED = """occupied as (select run_id, group_ordinal, count(distinct w) as occupied_windows from (select c.*, unnest(generate_series(start * 10 // representative_length, least(("end" - 1) * 10 // representative_length, 9))) as w
  from cover c join reference_groups r using (group_ordinal) where representative_length > 0) group by 1, 2)"""
_EVIDENCE = """counted as (select run_id, group_ordinal, count(*) filter (kind = 'Supporting') as supporting_selected_fragments, count(*) filter (kind = 'Unresolved') as cross_group_ambiguous_fragments,
  count(*) filter (kind = 'Confounded') as host_confounded_fragments, count(*) filter (kind = 'Supporting' and split) as split_events, count(*) filter (lone) as discordant_fragments
  from chosen join runs using (ordinal) group by 1, 2),
ev as (select counted.*, coalesce(covered_bases, 0)::bigint as covered_bases, coalesce(occupied_windows, 0)::bigint as occupied_windows from counted
  left join (select run_id, group_ordinal, sum("end" - start)::bigint as covered_bases from cover group by 1, 2) using (run_id, group_ordinal) left join occupied using (run_id, group_ordinal))"""
_ALL = f"{_ADJ}, {_RUN}, {_INTERVALS}, {_COVER}, {_OCCUPIED}, {_EVIDENCE}"
_RANKED = """ranked as (select run_id, group_ordinal, representative_id, row_number() over (partition by run_id order by supporting_selected_fragments desc, representative_id nulls first, group_ordinal)::int as support_rank,
  supporting_selected_fragments, (sum(supporting_selected_fragments) over (partition by run_id))::bigint as total_target_support_fragments, count(*) over (partition by run_id) as supported_reference_groups,
  supporting_selected_fragments * 100.0::double / (sum(supporting_selected_fragments) over (partition by run_id))::bigint as target_support_share_pct
  from ev join reference_groups using (group_ordinal) where supporting_selected_fragments > 0)"""

_SAMPLED = f"""{_MASKED_GATE}, {_KEYED}, {_SCALARS}, {_DESIGN}, {_SCREEN}, {_FULL},
drawn as (select ordinal from screen join sampling_design using (run_id) join verdicts using (ordinal) where lower(mode) = 'screen' and verdict = 'Pass' union select ordinal from full_ join sampling_design using (run_id) where lower(mode) = 'full'),
sampled_hits as (select * from hits where ordinal in (select ordinal from drawn)), {_ALL.replace("from hits where", "from sampled_hits where")}, {_RANKED}"""

_FRACTION = "supporting_selected_fragments / selected * population / input_fragments"

SQL = {
    "kmer_canonical": f"with {_REC} select * from {_kmers('rec_ordinal', 'rec')}",
    "target_kmer_set": f"with {_REC}, {_TK} select * from tk",
    "kmer_semi_join": f"with {_REC}, {_ONCE}, {_ENDS}, {_TK}, {_EK}, {_HITS} select * from h",
    "panel_hit_rank": f"""with {_REC}, {_ONCE}, {_ENDS}, reads as (select distinct ordinal, kmer from {_kmers('ordinal', 'ends')}),
panel as (select distinct rec_ordinal, id, kmer from {_kmers('rec_ordinal, id', '(select * from rec where not is_host)')}),
hit as (select rec_ordinal, id, count(distinct ordinal) as fragments, count(*) as kmer_hits from panel join reads using (kmer) group by 1, 2)
select *, row_number() over (order by fragments desc, kmer_hits desc, id, rec_ordinal)::int as place from hit""",
    "gate_state_unmasked": f"{_GATE} select * from states",
    "gate_verdict_unmasked": f"{_GATE} select * from verdicts",
    "dust_intervals": f"with {_ONCE}, {_ENDS}, {_DUST} select ordinal, mate, s as start, e as \"end\" from mask",
    "gate_verdict": f"{_MASKED_GATE} select * from verdicts",
    "sampled_abundance_score": f"""{_SAMPLED},
p as (select r.run_id, group_ordinal, case when selected > 0 and input_fragments > 0 then {_FRACTION} end as fraction, input_fragments, delta from ranked r join scalars using (run_id))
select run_id, group_ordinal, fraction, fraction * input_fragments as estimated_fragments, (fraction - delta) / (fraction + delta) as sampling_target_score from p""",
    "report_counts": f"""{_SAMPLED},
census as (select run_id, case when count(r2) = 0 then 'SE' when count(r2) = count(*) then 'PE' else 'MIXED' end as input_mode from once group by run_id)
select r.run_id, r.representative_id as reference_id, support_rank, r.supporting_selected_fragments as support_fragments, covered_bases as covered_bp, representative_length as reference_length_bp,
  occupied_windows, split_events as split_support_fragments, discordant_fragments, input_mode, input_fragments, selected as selected_fragments, total_target_support_fragments, supported_reference_groups
from ranked r join ev e on e.run_id = r.run_id and e.group_ordinal = r.group_ordinal join reference_groups g on g.group_ordinal = r.group_ordinal join scalars s on s.run_id = r.run_id left join census c on c.run_id = r.run_id""",
    "bloom_size": f"with {_REC}, {_TK} select count(*) as inserted, greatest(64, pow(2, ceil(log2(16 * greatest(count(*), 1)))))::bigint as bits from tk",
    "seed_table": f"with {_REC}, {_GROUPS}, {_CONTIGS} select name, pos as at, kmer from {_kmers('name', 'contigs_', False)}",
    "fastq_pairs": f"with {_ONCE} select row_number() over (order by ordinal) - 1 as ordinal, 'fragment-' || ordinal as id, r1, r2 from once where r1 is not null and r2 is not null",
    "ledger_roundtrip": f"with {_REC}, {_GROUPS} select group_ordinal, target_group_id, representative_id, (unnest(generate_series(1, len(ids))) - 1)::int as member_ordinal, unnest(ids) as member_id, representative_length from numbered",
    "gate_counts": f"{_MASKED_GATE} select run_id, verdict, count(*) as fragments from verdicts join once using (ordinal) group by 1, 2",
    "bloom_held": f"with {_REC}, {_ONCE}, {_ENDS}, {_TK}, {_EK}, {_HITS} select ordinal, count(*) as held from h group by ordinal",
    "aligned_exact": f"""with {_REC}, {_GROUPS}, {_ONCE}, {_ENDS}, {_CONTIGS},
both_ as (select ordinal, mate, upper(sequence) as s from ends union all select ordinal, mate, {_RC.format('upper(sequence)')} from ends),
firsts as (select ordinal, mate, s, substr(s, 1, {KMER}) as w from both_ where length(s) >= {MIN_COVERED} and not regexp_matches(s, '[^ACGT]')),
places as (select role, target_group_ordinal, sequence, i - 1 as place, substr(sequence, i::bigint, {KMER}) as w from contigs_, lateral unnest(generate_series(1, length(sequence) - {KMER - 1})) as t(i))
select distinct ordinal, mate, role, target_group_ordinal::int as target_group_ordinal, place::bigint as target_start, (place + length(s))::bigint as target_end
from firsts join places using (w) where substr(sequence, (place + 1)::bigint, length(s)) = s""",
    "stream_window_counts": """with once_ as (select ordinal, arrived_at, min(run_id) as run_id, bool_or(r2 is not null) as paired from fragments where arrived_at is not null group by 1, 2)
select run_id, strftime(time_bucket(interval '6 hours', arrived_at::timestamp), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as fragments, sum(case when paired then 2 else 1 end)::bigint as reads from once_ group by 1, 2""",
    "revcomp": f"with {_REC} select rec_ordinal, {_RC.format('sequence')} as reverse_complement, sha256({_CANON}) as digest from rec",
    "reference_groups": f"with {_REC}, {_GROUPS} select group_ordinal, target_group_id, representative_id, representative_description, array_to_string(ids, ';') as member_ids, representative_length, 'target_' || group_ordinal as contig_name from numbered",
    "group_ledger": f"with {_REC}, {_GROUPS} select group_ordinal, target_group_id, representative_id, (unnest(generate_series(1, len(ids))) - 1)::int as member_ordinal, unnest(ids) as member_id, representative_length from numbered",
    "contig_union": f"""with {_REC}, {_GROUPS} select 'host_' || (row_number() over (order by rec_ordinal) - 1) as name, 'HOST' as role, null::bigint as target_group_ordinal, sequence from rec where is_host
union all select 'target_' || group_ordinal, 'TARGET', group_ordinal, arg_min(sequence, rec_ordinal) from numbered n join rec r on not is_host and r.id = n.representative_id and 'sha256:' || sha256({_CANON}) = n.target_group_id group by group_ordinal""",
    "read_id_normalize": f"select ordinal, piece_no, nullif({_READ_ID}, '') as read_id from fragments",
    "sample_id": "select distinct run_id, case when r2 is null then '_1' else '_R1' end as \"end\", run_id as sample_id from fragments",
    "duplicate_ids": f"with {_REC} select source, id, count(*) as records from rec group by 1, 2 having count(*) > 1",
    "input_census": f"with {_ONCE} select run_id, count(*) as fragments, count(r2) as paired, case when count(r2) = 0 then 'SE' when count(r2) = count(*) then 'PE' else 'MIXED' end as input_mode from once group by run_id",
    "bottom_k_sample": f"with {_KEYED} select * from keyed order by key, ordinal limit 2048",
    "screen_sample": f"{_MASKED_GATE}, {_KEYED}, {_DESIGN}, {_SCREEN} select ordinal, run_id, id, key, verdict from screen join verdicts using (ordinal)",
    "full_sample": f"{_MASKED_GATE}, {_KEYED}, {_DESIGN}, {_FULL} select ordinal, run_id, id, key, 'Pass' as verdict from full_",
    "mode_containment": f"{_MASKED_GATE}, {_KEYED}, {_DESIGN}, {_SCREEN}, {_FULL} select s.run_id, count(*) as screen_passed, count(full_.ordinal) as in_full from screen s join verdicts using (ordinal) left join full_ using (ordinal) where verdict = 'Pass' group by s.run_id",
    "sampling_design": f"""{_MASKED_GATE}, {_KEYED}, {_SCALARS} select run_id, mode, precision, input_fragments, population, selected, case when population > 0 then selected / population else 0.0::double end as selection_probability,
case when selected > 0 then selected * delta * input_fragments / population end as expected_support from scalars""",
    "usable_hits": f"with {_USABLE} select ordinal, mate, role, target_group_ordinal, alignment_score, query_length, supplementary, ratio from u",
    "best_hits": f"with {_USABLE}, {_BEST} select * from b",
    "host_confounding": f"with {_USABLE}, {_BEST} select ordinal, mate from b where best_host >= best_target",
    "split_groups": f"with {_USABLE}, {_BEST}, {_TIED} select * from t",
    "adjudicated": f"""with {_ADJ}, l as (select ordinal, string_agg(group_ordinal, ';' order by group_ordinal) as groups, string_agg(group_ordinal, ';' order by group_ordinal) filter (lone) as lone from chosen group by ordinal),
s as (select ordinal, string_agg(group_ordinal, ';' order by group_ordinal) as split from g where split group by ordinal)
select k.ordinal, kind, coalesce(groups, '') as groups, coalesce(split, '') as split_groups, coalesce(lone, '') as discordant_groups from kinds k left join l using (ordinal) left join s using (ordinal)""",
    "discordant": f"with {_ADJ} select ordinal, group_ordinal from chosen where lone",
    "run_counters": f"with {_ADJ}, {_RUN} select run_id, count(*) as aligned_fragments, count(*) filter (kind <> 'Supporting') as unassigned_fragments from kinds join runs using (ordinal) group by run_id",
    "supporting_intervals": f"with {_ADJ}, {_RUN}, {_INTERVALS} select * from intervals",
    "coverage_union": f"with {_ADJ}, {_RUN}, {_INTERVALS}, {_COVER} select * from cover",
    "occupied_windows": f"with {_ADJ}, {_RUN}, {_INTERVALS}, {_COVER}, {_OCCUPIED} select * from occupied",
    "group_evidence": f"with {_ALL} select * from ev",
    "group_labels": f"""with {_ALL} select run_id, group_ordinal, case when supporting_selected_fragments > 0 then 'REFERENCE_SIGNAL_OBSERVED' else 'INDETERMINATE_EVIDENCE' end as evidence_status,
case when supporting_selected_fragments > 0 and len(member_ids) = 1 then 'RESOLVED_TO_REFERENCE_GROUP' when supporting_selected_fragments > 0 then 'AMBIGUOUS_WITHIN_GROUP'
  when cross_group_ambiguous_fragments > 0 then 'UNRESOLVED_ACROSS_GROUPS' else 'CONFOUNDED_WITH_HOST' end as attribution_status,
case when supporting_selected_fragments > 0 and (split_events > 0 or discordant_fragments > 0) then 'DIAGNOSTIC_EVIDENCE_OBSERVED' else 'NOT_OBSERVED' end as integration_status
from ev left join reference_groups using (group_ordinal)""",
    "given_evidence": """select group_ordinal, count(distinct run_id) as runs, coalesce(sum(supporting_selected_fragments), 0)::bigint as supporting_selected_fragments, coalesce(sum(host_confounded_fragments), 0)::bigint as host_confounded_fragments,
coalesce(sum(cross_group_ambiguous_fragments), 0)::bigint as cross_group_ambiguous_fragments, coalesce(sum(split_events), 0)::bigint as split_events, coalesce(sum(discordant_fragments), 0)::bigint as discordant_fragments
from (select distinct * from group_evidence) group by group_ordinal""",
    "abundance_score": f"""{_MASKED_GATE}, {_KEYED}, {_SCALARS}, {_ALL}, {_RANKED}, p as (select r.run_id, group_ordinal, case when selected > 0 and input_fragments > 0 then {_FRACTION} end as fraction, input_fragments, delta from ranked r join scalars using (run_id))
select run_id, group_ordinal, fraction, fraction * input_fragments as estimated_fragments, (fraction - delta) / (fraction + delta) as sampling_target_score from p""",
    "ranked_report_numeric": f"with {_ALL}, {_RANKED} select * from ranked",
    "top_rows": f"with {_ALL}, {_RANKED} select run_id, support_rank, group_ordinal from ranked where support_rank <= {TOP_ROWS}",
    "diagonal_chain": f"""with {_REC}, {_ONCE}, {_ENDS}, both_ as (select ordinal, mate, '+' as strand, upper(sequence) as sequence from ends union all select ordinal, mate, '-', {_RC.format('upper(sequence)')} from ends),
rk as (select * from {_kmers('ordinal, mate, strand', 'both_', False)}), ck as (select rec_ordinal, pos as tpos, kmer from {_kmers('rec_ordinal', 'rec', False)}),
s as (select ordinal, mate, strand, 'rec_' || rec_ordinal as name, tpos - pos as diagonal, pos from rk join ck using (kmer)),
n as (select *, least({KMER}, coalesce(pos - lag(pos) over (partition by ordinal, mate, strand, name, diagonal order by pos), {KMER})) as new from s)
select ordinal, mate, strand, name, diagonal::int as diagonal, count(*) as seeds, sum(new)::bigint as covered from n group by 1, 2, 3, 4, 5 having count(*) >= {MIN_HITS} and sum(new) >= {MIN_COVERED}""",
    "fasta_roundtrip": f"with {_REC} select id, first(description order by description, sequence) as description, first(sequence order by description, sequence) as sequence from rec group by id",
    "fastq_roundtrip": f"with {_ONCE} select 'fragment-' || ordinal as id, r1 as sequence from once where r1 is not null",
    "index_roundtrip": f"with {_REC}, {_GROUPS} select group_ordinal, target_group_id, representative_id, representative_length from numbered",
    "stream_bottom_k": f"with {_KEYED}, {_DESIGN}, {_SCREEN} select ordinal, run_id, id, key from screen",
}
