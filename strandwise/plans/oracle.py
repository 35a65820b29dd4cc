"""DuckDB SQL that gives the same rows as the queries."""

from __future__ import annotations

LETTERS = "translate(md5(cast({} as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"

CALLS = f"""calls as (
  select 'chr' || (l_suppkey % 5 + 1) as chrom, l_partkey as pos, case when l_linenumber % 2 = 0 then '-' else '+' end as strand,
    case when l_linenumber % 2 = 0 then 99999 - l_partkey else l_partkey end as pos_in_strand, 'read' || l_orderkey as readname,
    cast(1 as decimal(7,6)) - cast(round(l_discount * 10, 6) as decimal(7,6)) as prob_0, cast(round(l_discount * 10, 6) as decimal(7,6)) as prob_1,
    case when l_discount * 10 > 0.5 then 1 else 0 end as called_label,
    substr({LETTERS.format('l_partkey')}, 1, 2) || 'C' || substr({LETTERS.format('l_partkey')}, 4, 2) as k_mer,
    l_orderkey as ord1, l_linenumber as ord2, l_extendedprice as ord3, l_partkey as ord4, l_suppkey as ord5, l_returnflag = 'R' as truth
  from lineitem)"""

SAMPLES = CALLS + """, samples as (
  select *, called_label as methy_label,
    ord1 || '/' || ord2 || '/' || cast(cast(ord3 as decimal(18,2)) as varchar) || '/' || ord4 || '/' || ord5 as idx from calls)"""


def freq(name: str = "freq", where: str = "true", cf: str = "0.5") -> str:
    return f"""{name} as (
  select chrom, pos, f.strand as strand, f.pos_in_strand as pos_in_strand, prob_0_sum, prob_1_sum, met, unmet, coverage, met::double / coverage as rmet, f.k_mer as k_mer from (
    select chrom, pos, cast(sum(prob_0) as double) as prob_0_sum, cast(sum(prob_1) as double) as prob_1_sum,
      count(*) filter (called_label = 1) as met, count(*) filter (called_label <> 1) as unmet, count(*) as coverage,
      arg_min({{'strand': strand, 'pos_in_strand': pos_in_strand, 'k_mer': k_mer}}, {{'a': ord1, 'b': ord2, 'c': ord3, 'd': ord4, 'e': ord5}}) as f
    from calls where abs(prob_0 - prob_1) >= {cf} and {where} group by chrom, pos))"""


FREQ_COLUMNS = "chrom, pos, strand, pos_in_strand, prob_0_sum, prob_1_sum, met, unmet, coverage, rmet, k_mer"
CONTIGS = """contigs as (
  select doc_id, 'doc' || doc_id as name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents)"""
HITS = """hits as (select doc_id, name, i as pos, substr(seq, cast(i + 1 as int), 3) as three from (select doc_id, name, seq, unnest(range(0, greatest(len(seq) - 1, 0))) as i from contigs))"""
SITES = CONTIGS + ", " + HITS + """, sites as (
  select distinct 'chr' || (doc_id % 5 + 1) as chrom, doc_id // 5 * 2000 + pos as pos from hits where three[1:2] = 'CG')"""


def bed(source: str, percent: str) -> str:
    return f"""select chrom, pos as start, pos + 1 as "end", '.' as name, coverage as score, strand, pos as thick_start, pos + 1 as thick_end, '0,0,0' as rgb, coverage, cast({percent} as int) as percent from {source}"""


MAIN = "round_even(rmet * 100 + 0.001::double, 0)"
COMBINED = (
    "with " + CALLS + ", " + freq("fa", "ord1 % 2 = 0") + ", " + freq("fb", "ord1 % 2 = 1") + """, u as (select *, 0 as part from fa union all select *, 1 from fb), comb as (
  select chrom, pos, strand, arg_max(pos_in_strand, part) as pos_in_strand, sum(prob_0_sum) as prob_0_sum, sum(prob_1_sum) as prob_1_sum, cast(sum(met) as bigint) as met,
    cast(sum(unmet) as bigint) as unmet, cast(sum(coverage) as bigint) as coverage, cast(sum(met) as double) / cast(sum(coverage) as double) as rmet, arg_max(k_mer, part) as k_mer from u group by all_placeholder)"""
).replace("group by all_placeholder", "group by chrom, pos, strand")
FOLDED = "with " + CALLS + ", " + freq() + ", " + SITES + ", folded as (select *, case when strand = '-' then pos - 1 else pos end as site from freq)"
CLASS = "case when regexp_full_match({0}, 'CG[ACGTN]') then 'CG' when regexp_full_match({0}, 'C[ACTH]G') then 'CHG' when regexp_full_match({0}, 'C[ACT][ACT]|CHH') then 'CHH' else 'failed' end"
RC = "translate(reverse({}), 'ACGTNWSMKRYBVDHZ', 'TGCANWSKMYRVBHDZ')"
READS = f"""reads as (
  select vec_id, 'read' || vec_id as read_id, list_transform(embedding, lambda v: cast(v as double)) as raw, substr({LETTERS.format('vec_id')}, 1, 16) as seq,
    case when vec_id % 2 = 0 then '+' else '-' end as strand, 'chr' || (vec_id % 5 + 1) as chrom, vec_id * 10 as chrom_start from embeddings)"""
SAMPLE = "with " + READS + ", s as (select read_id, unnest(range(0, len(raw))) as i, unnest(raw) as v from reads)"
SCORES = SAMPLES + ", scores as (select idx, cast(prob_1 as double) as p from samples union all select idx, (ord1 % 100) / 100.0::double from samples), stats as (select idx, avg(p) as m, stddev_pop(p) as sd from scores group by idx)"
KEEP = "((methy_label = 1 and m >= 0.62) or (methy_label <> 1 and m < 1 - 0.62::double))"


def located(k: int, motifs: str, width: int) -> str:
    half = k // 2
    return READS + f""", located as (
  select *, case when strand = '-' then chrom_start + 15 - i else chrom_start + i end as pos, substr(seq, cast(i - {half} + 1 as int), {k}) as k_mer
  from (select *, unnest(range({half}, 16 - {half})) as i from reads) where substr(seq, cast(i + 1 as int), {width}) in ({motifs}))"""


def chance(seed: int, key: str = "idx") -> str:
    return f"md5('{seed}|' || {key})"


CONFUSION = """select tp, fp, tn, fn, case when n = 0 then 0 else (tp + tn)::double / n end as accuracy, case when tp + fn = 0 then 0 else tp::double / (tp + fn) end as recall,
  case when tn + fp = 0 then 0 else tn::double / (tn + fp) end as specificity, case when tp + fp = 0 then 0 else tp::double / (tp + fp) end as precision,
  case when tn + fp = 0 then 0 else fp::double / (tn + fp) end as fallout, case when tp + fn = 0 then 0 else fn::double / (tp + fn) end as miss_rate,
  case when tp + fp = 0 then 0 else fp::double / (tp + fp) end as fdr, case when tn + fn = 0 then 0 else tn::double / (tn + fn) end as npv, n as total_num
from (select count(*) filter (called_label = 1 and truth) as tp, count(*) filter (called_label = 1 and not truth) as fp, count(*) filter (called_label <> 1 and not truth) as tn, count(*) filter (called_label <> 1 and truth) as fn, count(*) as n from {})"""
GFF = """exons as (
  select 'chr' || (l_orderkey % 5 + 1) as chrom, case when l_orderkey % 2 = 0 then '-' else '+' end as strand, 'transcript:' || l_orderkey as tx, 't' || l_orderkey as t, l_orderkey::varchar as parent,
    l_partkey * 100 as start, l_partkey * 100 + cast(l_quantity as bigint) as "end", l_linenumber as rank, l_returnflag as flag, 'last' || l_linestatus as name from lineitem)"""

ORACLE = {
    "q_call_freq": f"with {CALLS}, {freq()} select {FREQ_COLUMNS} from freq",
    "q_call_freq_contigs": f"with {CALLS}, {freq('freq', "chrom in ('chr1', 'chr4')", '0.3')} select {FREQ_COLUMNS} from freq",
    "q_used_ratio": f"with {CALLS} select count(*) as total, count(*) filter (abs(prob_0 - prob_1) >= 0.5) as used, (count(*) filter (abs(prob_0 - prob_1) >= 0.5))::double / count(*) as ratio from calls",
    "q_bed": f"with {CALLS}, {freq()} {bed('freq', MAIN)}",
    "q_freq2bed": f"with {CALLS}, {freq()} {bed("(select * replace ('C' || chrom[2:] as chrom) from freq where coverage >= 3)", MAIN)}",
    "q_combine_freq_files": f"{COMBINED} select {FREQ_COLUMNS} from comb",
    "q_bed_combine": f"{COMBINED} {bed('comb', 'round_even(rmet * 100, 0)')}",
    "q_combine_strands": f"""{FOLDED} select chrom, site as pos, '+' as strand, site as pos_in_strand, sum(prob_0_sum) as prob_0_sum, sum(prob_1_sum) as prob_1_sum, cast(sum(met) as bigint) as met, cast(sum(unmet) as bigint) as unmet,
  cast(sum(coverage) as bigint) as coverage, cast(sum(met) as double) / cast(sum(coverage) as double) as rmet, coalesce(max(k_mer) filter (strand = '+'), '-') as k_mer from folded f semi join sites s on f.chrom = s.chrom and f.site = s.pos group by chrom, site""",
    "q_off_sites": f"{FOLDED} select chrom, site as pos, coverage from folded f anti join sites s on f.chrom = s.chrom and f.site = s.pos",
    "q_combine_strands_bed": f"{FOLDED}, b as (select f.chrom, f.site as pos, '+' as strand, coverage, cast({MAIN} as int) / 100.0::double * coverage as met from folded f semi join sites s on f.chrom = s.chrom and f.site = s.pos), "
    f"g as (select chrom, pos, strand, cast(sum(coverage) as bigint) as coverage, sum(met) / sum(coverage) as rmet from b group by chrom, pos, strand) {bed('g', 'trunc(round(rmet + 0.000001::double, 2) * 100.0::double)')}",
    "q_motif_scan": f"with {CONTIGS}, {HITS} select name, pos from hits where three[1:2] = 'CG'",
    "q_multi_motif": f"with {CONTIGS}, {HITS} select name, pos + 1 as pos from hits where regexp_full_match(three, 'C[ACT]G|CC[ACGT]')",
    "q_revcomp": f"with {CONTIGS} select name, md5({RC.format("(seq || 'RN')")}) as lenient, '' as strict, md5({RC.format('seq')}) as seq_rc from contigs",
    "q_kmer_codes": f"with {CALLS} select distinct k_mer, array_to_string(list_transform(string_split(k_mer, ''), lambda b: instr('ACGTNWSMKRYBVDHZ', b) - 1), ',') as codes, k_mer as back, substr(k_mer, 2, 3) as mid from calls",
    "q_motif_class": f"with {CALLS} select {CLASS.format('k_mer[3:5]')} as motif, count(*) as n from calls group by 1",
    "q_motif_class_ref": f"""with {CONTIGS}, both_ as (
  select name, i, substr(seq, cast(i + 1 as int), 3) as three from (select name, seq, unnest(range(0, len(seq))) as i from contigs)
  union all select name, i, {RC.format('substr(seq, cast(i - 1 as int), 3)')} from (select name, seq, unnest(range(2, len(seq))) as i from contigs))
select {CLASS.format('three')} as motif, count(*) as n from both_ where three like 'C%' group by 1""",
    "q_contig_len": f"with {CONTIGS} select name, len(seq) as len from contigs",
    "q_signal_stats": f"{SAMPLE} select read_id, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(median(x), 6) as median from (select read_id, 0.18::double * (v + 12) as x from s) group by read_id",
    "q_zscore": f"{SAMPLE} select s.read_id, i, round((v - m) / sd, 4) + 0.0 as v from s join (select read_id, avg(v) as m, stddev_pop(v) as sd from s group by 1) g using (read_id)",
    "q_mad": f"{SAMPLE}, m as (select read_id, median(v) as m from s group by 1), d as (select read_id, median(abs(v - m)) as d from s join m using (read_id) group by 1) select read_id, i, round((v - m) / (d / 0.6744897501960817::double), 4) + 0.0 as v from s join m using (read_id) join d using (read_id)",
    "q_base_stats": f"{SAMPLE} select read_id, i // 4 as base, count(*) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from s group by 1, 2",
    "q_rect_pad": f"{SAMPLE} select read_id, i // 4 as base, i % 4 + 1 as i, v from s union all select read_id, b, j, 0.0 from reads, (select unnest(range(0, 16)) as b), (select unnest([0, 5, 6]) as j)",
    "q_rect_sample": f"{SAMPLE}, p as (select *, row_number() over (partition by read_id order by md5('3|' || read_id || '|' || i), i) as r from s) select read_id, row_number() over (partition by read_id order by i) - 1 as i, v from p where r <= 6",
    "q_features": f"with {located(5, "'C'", 1)} select chrom, pos, strand as alignstrand, case chrom when 'chr1' then case when strand = '-' then 99999 - pos else pos end when 'chr2' then case when strand = '-' then 199999 - pos else pos end when 'chr3' then case when strand = '-' then 299999 - pos else pos end else -1 end as pos_in_strand, read_id as readname, k_mer from located",
    "q_feature_signals": f"""with {located(5, "'C'", 1)}, s as (select read_id, unnest(range(0, len(raw))) as i, unnest(raw) as v from reads),
  m as (select read_id, median(v) as m from s group by 1), d as (select read_id, median(abs(v - m)) as d from s join m using (read_id) group by 1),
  z as (select read_id, i // 4 as base, i % 4 as r, round_even((v - m) / (d / 0.6744897501960817::double), 6) as v from s join m using (read_id) join d using (read_id)),
  g as (select read_id, base, round_even(avg(v), 6) as mean, round_even(stddev_pop(v), 6) as std, count(*) as n from z group by 1, 2),
  b as (select chrom, pos, strand, read_id, i + j as base, j + 2 as place from located, (select unnest(range(-2, 3)) as j))
select chrom, pos, strand as alignstrand, read_id as readname, place, cast(floor(mean * 1000 + 0.30303::double) as bigint) as mean, cast(floor(std * 1000 + 0.30303::double) as bigint) as std, n, k as r, cast(floor(coalesce(v, 0.0) * 1000 + 0.30303::double) as bigint) as v
from b join g using (read_id, base) cross join (select unnest(range(0, 6)) as k) left join z on z.read_id = b.read_id and z.base = b.base and z.r = k - 1""",
    "q_features_region": f"with {located(3, "'CA', 'CG'", 2)} select chrom, pos, strand as alignstrand, read_id as readname, k_mer from located where chrom = 'chr2' and pos >= 1000 and pos < 2500 and chrom_start < 2500 and chrom_start + 16 > 1000",
    "q_features_positions": f"with {CALLS}, {located(3, "'C'", 1)} select l.chrom, l.pos, l.strand as alignstrand, read_id as readname, l.k_mer from located l semi join (select * from calls where truth) c on l.chrom = c.chrom and l.pos = c.pos and l.strand = c.strand",
    "q_interval_join": f"with {READS} select read_id as read_read_id, p_partkey as region_p_partkey from reads join part on chrom = 'chr' || (p_partkey % 5 + 1) and chrom_start < p_partkey + p_size and chrom_start + 16 > p_partkey",
    "q_failed_reads": "select count(*) as reads, count(*) filter (vec_id % 5 = 2) as failed from embeddings",
    "q_read_runs": f"""with {CALLS}, r as (select chrom, ord1, ord2, ord3, ord4, ord5, case when lag(readname) over w is not distinct from readname then 0 else 1 end as new_ from calls window w as (partition by chrom order by ord3, ord1, ord2, ord3, ord4, ord5))
select chrom, cast(sum(new_) - 1 as bigint) as runs, cast((sum(new_) - 1) // 2 as bigint) as batches from r group by chrom""",
    "q_kmer_ratio": f"with {CALLS} select k_mer, count(*) as n, cast(sum(count(*)) over () as bigint) as total, count(*)::double / sum(count(*)) over () as ratio from calls group by k_mer",
    "q_kmer_overlap": f"with {CALLS}, a as (select distinct k_mer from calls where called_label = 1), b as (select distinct k_mer from calls where called_label = 0) select count(*) filter (a.k_mer is not null and b.k_mer is not null) as common, count(*) filter (b.k_mer is null) as only_a, count(*) filter (a.k_mer is null) as only_b from a full join b on a.k_mer = b.k_mer",
    "q_stratified_neg": f"""with {SAMPLES}, pos as (select * from samples where methy_label = 1), neg as (select * from samples where methy_label = 0), t as (select count(*) as total from pos),
h as (select n.k_mer, n.n, case when p.n is null then null else ceil(total * (p.n::double / total)) end as quota from (select k_mer, count(*) as n from neg group by 1) n left join (select k_mer, count(*) as n from pos group by 1) p using (k_mer), t),
u as (select greatest(ceil((total - coalesce((select sum(least(quota, n)) from h where quota is not null), 0)) / nullif((select count(*) from h where quota is null), 0)), 0) as share from t),
q as (select k_mer, n, coalesce(quota, (select share from u), 0) as quota, quota is null as other from h),
r as (select neg.*, q.quota, q.other, row_number() over (partition by k_mer order by {chance(1)}, idx) as r from neg join q using (k_mer)),
one as (select k_mer from r where r <= quota), lack as (select greatest((select total from t) - (select count(*) from one), 0) as n),
two as (select k_mer, row_number() over (order by {chance(2)}, idx) as r2 from r where r > quota and (not other or (select share from u) > 0))
select k_mer, count(*) as n from (select k_mer from one union all select k_mer from two where r2 <= (select n from lack)) group by k_mer""",
    "q_sample": f"with {SAMPLES} select idx, k_mer from samples order by {chance(1)}, idx limit 500",
    "q_complement": f"with {SAMPLES} select idx from (select idx, row_number() over (order by {chance(1)}, idx) as r from samples) where r > 500",
    "q_shuffle_concat": f"with {SAMPLES} select case methy_label when 1 then 0 else 1 end as part, count(*) as n, min(idx) as first from samples group by 1",
    "q_first_n": f"with {SAMPLES} select chrom, idx from (select chrom, idx, row_number() over (partition by chrom order by {chance(3)}, idx) as r from samples) where r <= 40",
    "q_filter_label": f"with {CALLS} select chrom, count(*) as n from calls where called_label = 1 group by chrom",
    "q_filter_positions": f"with {CALLS} select a.chrom, a.pos, 1 as methy_label, count(*) as n from calls a semi join (select * from calls where truth) b on a.chrom = b.chrom and a.pos = b.pos group by 1, 2",
    "q_probs_stats": f"with {SCORES} select idx, round(m, 6) as mean_prob, round(sd, 6) as std_prob from stats",
    "q_clean_samples": f"with {SCORES} select chrom, methy_label, count(*) as n from samples join stats using (idx) where {KEEP} group by 1, 2",
    "q_kept_ratio": f"with {SCORES}, k as (select methy_label, {KEEP} as keep from samples join stats using (idx)), c as (select count(*) filter (methy_label = 1) as all_pos, count(*) filter (methy_label <> 1) as all_neg, count(*) filter (methy_label = 1 and keep) as kept_pos, count(*) filter (methy_label <> 1 and keep) as kept_neg from k) select *, (kept_pos::double / all_pos + kept_neg::double / all_neg) / 2 as ratio from c",
    "q_denoise_round": f"with {CALLS} select cast(floor(cast(prob_1 as double) * 10) as bigint) as decile, count(*) as n from calls group by 1",
    "q_batch_accuracy": f"with {CALLS} select count(*) as batches, round(avg(a), 9) as mean_accuracy from (select avg(case when (called_label = 1) = truth then 1.0::double else 0.0 end) as a from calls group by ord1 // 512)",
    "q_confusion": f"with {CALLS} {CONFUSION.format('calls')}",
    "q_auroc": f"with {CALLS}, s as (select prob_1, count(*) filter (truth) as p, count(*) filter (not truth) as q from calls group by 1), a as (select p * (coalesce(sum(q) over (order by prob_1 rows between unbounded preceding and 1 preceding), 0) + q / 2.0) as a, p, q from s) select round(cast(sum(a) as double) / cast(sum(p) * sum(q) as double), 10) as auc from a",
    "q_threshold_sweep": f"""with {CALLS}, t as (select unnest(range(0, 28)) * 25 / 1000.0::double as cf), g as (select cast(prob_1 - prob_0 as double) as gap, truth, count(*) as n from calls group by 1, 2),
x as (select cf, cast(sum(n) as bigint) as total_num, cast(coalesce(sum(n) filter (abs(gap) >= cf), 0) as bigint) as called_num, cast(coalesce(sum(n) filter (abs(gap) >= cf and (gap >= cf) = truth), 0) as bigint) as correct from t, g group by cf)
select cf as prob_cf, total_num, called_num, correct, called_num::double / total_num as called_ratio, case when called_num = 0 then 0 else correct::double / called_num end as called_accuracy from x""",
    "q_evaluate_sampled": f"with {SAMPLES}, p as (select *, row_number() over (partition by truth order by {chance(4)}, idx) as r from samples), q as (select * from p where r <= 2000) {CONFUSION.format('q')}",
    "q_train_quality": f"with {CALLS} select count(*) as n, (count(*) filter ((prob_1 > 0.5) = truth))::double / count(*) as accuracy, (count(*) filter (prob_1 > 0.5 and truth))::double / count(*) filter (prob_1 > 0.5) as precision, (count(*) filter (prob_1 > 0.5 and truth))::double / count(*) filter (truth) as recall from calls",
    "q_gff_attrs": f"""with {GFF} select 'exon' as feature, name, flag, rank, count(*) as n, min(start) as start, max("end") as "end" from exons group by name, flag, rank union all select 'mRNA', null, null, null, count(distinct parent), 0, 10 from exons""",
    "q_gff_filter": f"with {GFF} select chrom, strand, count(*) as n from exons where flag = 'R' group by 1, 2",
    "q_gff_kinds": "select distinct l_returnflag as value from lineitem",
    "q_gff_features": "select 'exon' as feature union all select 'mRNA'",
    "q_transcript_len": f"""with {GFF} select parent, cast(sum("end" - start) as bigint) as length, count(*) as exons from exons group by 1""",
    "q_positions_distinct": f"with {CALLS} select distinct chrom, pos, strand from calls",
    "q_sites_sorted": f"with {CALLS}, {freq()} select {FREQ_COLUMNS}, row_number() over (order by chrom, pos, strand) as n from freq",
    "q_site_top": f"with {CALLS}, {freq()} select {FREQ_COLUMNS}, row_number() over (order by chrom, pos) as n from (select * from freq order by coverage desc, chrom, pos limit 10)",
}
ORACLE["q_transcript_coords"] = f"""with {GFF}, o as (select *, coalesce(sum("end" - start) over (partition by parent order by rank, start, "end" rows between unbounded preceding and 1 preceding), 0) as begin_ from exons),
b as (select parent, chrom, strand, begin_ + i as site, case when strand = '-' then "end" - 1 - i else start + i end as pos from (select *, unnest(range(0, "end" - start)) as i from o))
select parent, chrom, strand, count(*) as n, cast(sum(site * (pos % 1000)) as bigint) as mixed, cast(max(site) as bigint) as last from b group by 1, 2, 3"""

PLACED = f"""{GFF}, o as (select *, coalesce(sum("end" - start) over (partition by parent order by rank, start, "end" rows between unbounded preceding and 1 preceding), 0) as begin_ from exons)"""
ORACLE["q_to_genome"] = f"""with {PLACED}, p as (select l_orderkey::varchar as parent, l_suppkey % 97 as site, l_linenumber as line from lineitem)
select parent, chrom, strand, count(*) as n, cast(sum(line * (case when strand = '-' then "end" - 1 - (site - begin_) else start + (site - begin_) end)) as bigint) as places
from p join o using (parent) where site >= begin_ and site < begin_ + "end" - start group by 1, 2, 3"""
ORACLE["q_to_transcripts"] = f"""with {PLACED}, p as (select 'chr' || (o_custkey % 5 + 1) as chrom, o_custkey * 100 + o_orderkey % 50 as pos, o_orderkey from orders)
select o_orderkey, count(*) as n, cast(sum(begin_ + case when strand = '-' then "end" - 1 - pos else pos - start end) as bigint) as places
from p join o using (chrom) where pos >= start and pos < "end" group by 1"""
ORACLE["q_interval_join_uneven"] = """with a as (select l_orderkey, 'chr' || (l_orderkey % 5 + 1) as chrom, min(l_partkey) as start, max(l_partkey) + 1 as "end" from lineitem where l_orderkey % 50 = 0 group by 1, 2),
b as (select 'chr' || (l_orderkey % 5 + 1) as chrom, l_partkey as start, l_partkey + cast(l_quantity as bigint) as "end", l_suppkey from lineitem)
select l_orderkey as long_l_orderkey, count(*) as n, cast(sum(l_suppkey) as bigint) as s from a join b on a.chrom = b.chrom and a.start < b."end" and b.start < a."end" group by 1"""
ORACLE["q_motif_class_sites"] = f"""with {CONTIGS}, n as (select count(*) as n from documents),
r as (select 'doc' || (l_orderkey % n) as name, l_partkey % 700 as pos, case when l_linenumber % 2 = 0 then '-' else '+' end as strand from lineitem, n),
t as (select r.*, case when strand = '+' then substr(seq, cast(pos + 1 as int), 3) when pos >= 2 then {RC.format('substr(seq, cast(pos - 1 as int), 3)')} else '' end as three from r left join contigs using (name))
select strand, {CLASS.format("coalesce(three, '')")} as motif, count(*) as n, cast(sum(pos) as bigint) as places from t group by 1, 2"""
ORACLE["q_shuffle_order"] = f"""with {SAMPLES}, p as (select idx, case methy_label when 1 then 0 else 1 end as part from samples), n as (select part, count(*) as n from p group by part),
k as (select greatest(1, ceil(sum(n) / 500.0)::bigint) as buckets from n),
r as (select idx, part, n, buckets, (row_number() over (partition by part order by md5('2|' || part || '|' || idx), idx) - 1) * buckets // n as bucket from p join n using (part), k)
select idx, part, cast((select sum((r.bucket * n.n + r.buckets - 1) // r.buckets) from n) + row_number() over (partition by bucket order by md5('3|' || part || '|' || idx), part, idx) - 1 as bigint) as position from r"""
ORACLE["q_denoise"] = f"""with {SAMPLES}, pos as (select * from samples where methy_label = 1 and prob_1 >= 0.75), t as (select count(*) as total from pos),
h as (select n.n, ceil(total * (p.n::double / total)) as quota from (select k_mer, count(*) as n from samples where methy_label <> 1 group by 1) n left join (select k_mer, count(*) as n from pos group by 1) p using (k_mer), t),
u as (select greatest(coalesce(ceil((total - coalesce((select sum(least(quota, n)) from h where quota is not null), 0)) / nullif((select count(*) from h where quota is null), 0)), 0), 0) as share from t),
g as (select sum(least(coalesce(quota, share), n)) as got, sum(n - least(coalesce(quota, share), n)) filter (quota is not null or share > 0) as left_ from h, u)
select 1 as methy_label, total as n from t union all select 0, cast(got + greatest(least(total - got, left_), 0) as bigint) from g, t"""
#: Six digits, half to even, by the shortest decimals that stand for the double.
EVEN = '''(select (f + case when t - f > 0.5 or (t - f = 0.5 and abs(f) % 2 = 1) then 1 else 0 end)::double / 1000000.0::double from (select t, floor(t) as f from (select cast(cast({0} as varchar) as decimal(30,20)) * 1000000 as t)))'''
#: A number of six digits as Java writes it: below a thousandth, with an exponent.
JAVA = """case when {0} <> 0 and abs({0}) < 0.001 then case when {0} < 0 then '-' else '' end
  || cast(round(abs({0}) * 1000000) / pow(10, len(cast(cast(round(abs({0}) * 1000000) as int) as varchar)) - 1) as varchar) || 'E-' || (7 - len(cast(cast(round(abs({0}) * 1000000) as int) as varchar))) else cast({0} as varchar) end"""
ORACLE["q_feature_text"] = f"""with {located(5, "'CG'", 2)}, s as (select read_id, unnest(range(0, len(raw))) as i, unnest(raw) as v from reads),
  m as (select read_id, median(v) as m from s group by 1), d as (select read_id, median(abs(v - m)) as d from s join m using (read_id) group by 1),
  z as (select read_id, i // 4 as base, list(round_even((v - m) / (d / 0.6744897501960817::double), 6) order by i) as v from s join m using (read_id) join d using (read_id) group by 1, 2),
  a as (select *, list_reduce(list_prepend(0.0::double, v), lambda x, y: x + y) / 4 as mean from z),
  g as (select *, sqrt(list_reduce(list_prepend(0.0::double, v), lambda x, y: x + (y - mean) * (y - mean)) / 4) as std from a),
  h as (select read_id, base, v, {EVEN.format('mean')} as mean, {EVEN.format('std')} as std from g),
  b as (select chrom, pos, strand, read_id, k_mer, i + j as base from located, (select unnest(range(-2, 3)) as j)),
  e as (select chrom, pos, strand, read_id, k_mer, base, {JAVA.format('mean')} as mean, {JAVA.format('std')} as std, array_to_string(list_transform(v, lambda x: {JAVA.format('x')}), ',') as raw from b join h using (read_id, base))
select chrom, pos, strand as alignstrand, -1::bigint as pos_in_strand, read_id as readname, 't' as read_strand, k_mer, string_agg(mean, ',' order by base) as signal_means, string_agg(std, ',' order by base) as signal_stds,
  string_agg('4', ',' order by base) as signal_lens, string_agg(raw, ';' order by base) as raw_signals, 1 as methy_label from e group by chrom, pos, strand, read_id, k_mer"""
