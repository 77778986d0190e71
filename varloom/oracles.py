"""DuckDB SQL that computes the registered queries another way."""

from __future__ import annotations

from varloom.bridge import BANDS_DUCK, CUSTOMER_SPANS, EXONS, GENOME_DUCK, ORDER_SPANS, lines_sql, variants_sql
from varloom.functions.codons import STANDARD, mitochondrial

#: r: genome, v: variants, t: trimmed, c: classified.
_TRIM = f"""
with recursive r as ({GENOME_DUCK}), v as (select row_number() over () as rid, * from ({variants_sql("varchar")})),
p as (
  select *, case when ref = alt or (length(ref) = 1 and length(alt) = 1) then 0
    else len(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda k: ref[:k] = alt[:k])) end as lead from v),
q as (select *, ref[lead + 1:] as r1, alt[lead + 1:] as a1 from p),
s as (
  select *, case when ref = alt or (length(ref) = 1 and length(alt) = 1) then 0
    else len(list_filter(range(1, least(length(r1), length(a1)) + 1), lambda k: right(r1, k) = right(a1, k))) end as back from q),
t as (
  select rid, l_orderkey, l_linenumber, chrom, pos, end_pos, svtype, alt as given, pos + lead as position,
    r1[:length(r1) - back] as ref, a1[:length(a1) - back] as alt from s),
c as (
  select *,
    case when given like '%[%' or given like '%]%' then 'sv' when given like '<STR%>' then 'repeat_expansion'
      when given like '<%>' and svtype in ('CNV', 'LOH') then 'cnv' when given like '<%>' then 'sv' else 'small' end as category
  from t),
k as (
  select *,
    case when given like '%[%' or given like '%]%' then 'translocation'
      when category = 'repeat_expansion' then 'short_tandem_repeat_variation'
      when category = 'cnv' then case given when '<DEL>' then 'copy_number_loss' when '<DUP>' then 'copy_number_gain'
        else 'copy_number_variation' end
      when category = 'sv' then case when svtype = 'DUP' and given = '<DUP:TANDEM>' then 'tandem_duplication'
        else coalesce(map {{'DEL': 'deletion', 'INS': 'insertion', 'DUP': 'duplication', 'INV': 'inversion', 'CNV': 'copy_number_variation',
          'STR': 'short_tandem_repeat_variation'}}[svtype], 'unknown') end
      when length(ref) = 1 and length(alt) = 1 then 'SNV' when length(ref) = length(alt) and length(ref) > 1 then 'MNV'
      when alt = '' and ref <> '' then 'deletion' when ref = '' and alt <> '' then 'insertion' else 'delins' end as variant_type,
    try_cast(nullif(regexp_extract(given, '^<STR([+-]?[0-9]+)>$', 1), '') as int) as repeat_count
  from c)
"""

_ANNOTATE = (
    _TRIM
    + """
, step as (
  select k.*, r.seq, ref || alt as allele, category = 'small' and (ref = '') <> (alt = '') as indel, 0 as moved, 0 as done
  from k join r using (chrom)),
walk as (
  select rid, allele, seq, position, 0 as moved, false as stop from step where indel
  union all
  select rid,
    case when position > 1 and seq[position - 1] = right(allele, 1) then right(allele, 1) || allele[:length(allele) - 1] else allele end, seq,
    case when position > 1 and seq[position - 1] = right(allele, 1) then position - 1 else position end, moved + 1,
    not (position > 1 and seq[position - 1] = right(allele, 1))
  from walk where not stop),
moved as (select rid, position, allele from walk where stop),
n as (
  select s.* replace (coalesce(m.position, s.position) as position,
      case when m.allele is not null and s.ref <> '' then m.allele else s.ref end as ref,
      case when m.allele is not null and s.alt <> '' then m.allele else s.alt end as alt)
  from step s left join moved m using (rid)),
b as (
  select *, case when category = 'small' then position when variant_type = 'translocation' then pos else pos + 1 end as b0,
    case when category = 'small' then position + greatest(length(ref) - 1, 0) else end_pos end as e0,
    nullif(case when {place} >= 1 then seq[{place}] else '' end, '') as base, 'NC_' || lpad(chrom, 6, '0') || '.1' as acc
  from n),
w as (
  select *, case when ref = 'N' and base is not null then base else ref end as ref2, (category = 'small' or variant_type = 'translocation') as plain
  from b),
x as (select *, (ref2 = '' or alt = '') and base is not null as padded from w),
d as (
  select *, seq[position + length(ref):position + length(ref) + greatest(500, length(ref || alt)) - 1] as down, ref || alt as al from x),
f as (
  select *, case when indel and down <> '' then len(list_filter(range(1, length(down) + 1),
    lambda z: down[:z] = repeat(al, (500 // length(al) + 2)::int)[:z])) else 0 end as shift from d),
g as (
  select *, al[shift % greatest(length(al), 1) + 1:] || al[:shift % greatest(length(al), 1)] as rot, position + shift as px from f),
h as (
  select *, case when ref = '' and px - 1 - length(al) >= 0 then seq[px - length(al):px - 1] end as up from g),
o as (
  select l_orderkey, l_linenumber, chrom, b0 as begin, e0 as "end", variant_type,
    case when ref = '' then '-' else ref end as ref_allele, case when alt = '' then '-' else alt end as alt_allele,
    chrom || '-' || (case when padded and plain then b0 - 1 else b0 end) || case when plain then '' else '-' || e0 end
      || '-' || (case when padded then base else '' end) || ref2 || '-' || (case when padded then base else '' end) || alt
      || case when plain then '' when category = 'repeat_expansion' then '-STR' else '-' || coalesce(map {'deletion': 'DEL', 'insertion': 'INS',
        'duplication': 'DUP', 'tandem_duplication': 'DUP', 'inversion': 'INV', 'copy_number_variation': 'CNV', 'copy_number_loss': 'CNV',
        'copy_number_gain': 'CNV'}[variant_type], 'SV') end as vid,
    case when category = 'small' and ref || alt <> '' then acc || ':g.' || case
      when ref = alt then position || '='
      when length(ref) = 1 and length(alt) = 1 then position || ref || '>' || alt
      when alt = '' then case when length(ref) = 1 then px || 'del' else px || '_' || (px + length(ref) - 1) || 'del' end
      when ref = '' and up = rot then case when length(alt) = 1 then (px - 1) || 'dup' else (px - length(alt)) || '_' || (px - 1) || 'dup' end
      when ref = '' then (px - 1) || '_' || px || 'ins' || rot
      when length(ref) = length(alt) and reverse(translate(ref, 'ACGTacgt', 'TGCAtgca')) = alt and regexp_full_match(ref, '[ACGTacgt]*')
        then position || '_' || (position + length(ref) - 1) || 'inv'
      when length(ref) = 1 then position || 'delins' || alt
      else position || '_' || (position + length(ref) - 1) || 'delins' || alt end end as hgvsg
  from h)
"""
)

_COLUMNS = 'select l_orderkey, l_linenumber, chrom, begin, "end", vid, hgvsg, variant_type, ref_allele, alt_allele from o'

#: p: parsed lines.
_LINES = f"""
with l as ({lines_sql("varchar")}), s as (select *, string_split(value, chr(9)) as c from l),
p as (
  select l_orderkey, l_linenumber, c[1] as chrom, c[2]::bigint as pos, nullif(c[3], '.') as id, c[4] as ref, c[5] as alt,
    list_filter(string_split(c[5], ','), lambda a: a not in ('*', '<*>', '<M>', '<NON_REF>')) as alts, c[6] as q, c[7] as f, c[8] as info,
    c[5] in ('.', '<NON_REF>') as is_reference, c[9] as fmt, c[10:11] as smp from s)
"""

_INT = "case when regexp_full_match({0}, '[+-]?[0-9]+') then {0}::int end"


def _table(code: str, codon: str) -> str:
    place = " + ".join(f"(position({codon}[{i + 1}] in 'ACGT') - 1) * {m}" for i, m in enumerate((16, 4, 1)))
    return f"'{code}'[({place}) + 1]"


_EXON_REGIONS = f"""
with e as ({EXONS}),
r as (
  select *, cast(row_number() over w as int) as id, cast(sum("end" - start + 1) over w as int) as cdna_end
  from e window w as (partition by ref_index, tx order by case when reverse then -start else start end, "end" rows between unbounded preceding and current row)),
x as (select *, cast(cdna_end - ("end" - start) as int) as cdna_start from r)
"""

ORACLES = {
    "trim_alleles": _TRIM + "select l_orderkey, l_linenumber, position, ref, alt from t",
    "variant_categories": _TRIM + "select l_orderkey, l_linenumber, category, variant_type, repeat_count from k",
    "variant_type_counts": _TRIM + "select category, variant_type, count(*) as n from k group by all",
    "annotate_variants": _ANNOTATE.replace("{place}", "position") + _COLUMNS,
    "file_variants": _ANNOTATE.replace("{place}", "position") + _COLUMNS,
    "file_places": _LINES + "select pos, count(*) as n, count(id) as named from p where chrom = 'chr7' and pos >= 200 group by pos",
    "annotate_over_chunks": _ANNOTATE.replace("{place}", "position") + 'select l_orderkey, l_linenumber, "begin", "end", vid, hgvsg from o',
    "annotate_variants_anchored": _ANNOTATE.replace("{place}", "(position - 1)") + "select l_orderkey, l_linenumber, vid from o",
    "band_locus": f"""with r as ({GENOME_DUCK}), v as ({variants_sql("varchar")}), b as ({BANDS_DUCK})
select l_orderkey, l_linenumber, v.chrom, pos, b.name as locus from v left join b on v.chrom = b.chrom and pos between b.begin and b."end" """,
    "vcf_records": _LINES
    + """select l_orderkey, l_linenumber, chrom, pos, id, ref, array_to_string(alts, ',') as alts,
  case when regexp_full_match(q, '[0-9]+') then q::double end as quality, case when f = '.' then '' else replace(f, ';', ',') end as filters, is_reference,
  coalesce(nullif(regexp_extract(info, '(?:^|;)END=([0-9]+)', 1), '')::bigint, pos + length(ref) - 1) as end_pos, regexp_extract(info, 'SVTYPE=([A-Z]+)', 1) as svtype,
  abs(regexp_extract(info, '.*SVLEN=(-?[0-9]+)', 1)::bigint) as svlen, regexp_extract(info, 'CIPOS=(-?[0-9]+),', 1)::bigint as ci_lo,
  regexp_extract(info, 'CIPOS=-?[0-9]+,([0-9]+)', 1)::bigint as ci_hi, true as no_ciend, regexp_extract(info, 'MQ=([0-9.]+)', 1)::double as mq,
  try_cast(regexp_extract(info, 'REF=([^;]*)', 1) as int) as ref_count, contains(info, ';IMPRECISE') as imprecise,
  case when is_reference then 0 else 2 end as n_samples from p""",
    "vcf_samples": _LINES
    + f""", k as (select l_orderkey, l_linenumber, alts, k, string_split(smp[k + 1], ':') as t from p, range(0, 2) g(k) where not is_reference and len(alts) > 0),
v as (select *, case when t[3] is not null and t[3] not like '%x%' then string_split(t[3], ',') end as ad from k),
d as (select *, {_INT.format("t[2]")} as dp from v)
select l_orderkey, l_linenumber, cast(k as int) as k, nullif(t[1], '.') as genotype, dp as depth,
  array_to_string(case when nullif(t[4], '.') is not null and len(alts) = 1 then [format('{{}}', t[4]::double)]
    when ad is not null and coalesce(dp, ad[1]::int + ad[2]::int) > 0 then [format('{{}}', round(ad[2]::double / coalesce(dp, ad[1]::int + ad[2]::int), 6))] end, ',') as frequencies,
  array_to_string(ad, ',') as depths, coalesce(t[7] <> 'PASS', false) as failed, coalesce(t[5]::int >= 2 and t[6]::int = 0 and t[1] = '1/2', false) as loh,
  t[1] = '.' as is_empty from d""",
    "vcf_counters": _LINES
    + """select count(*) filter (k) as positions, cast(sum(case when k then len(alts) else 0 end) as bigint) as variants, count(*) filter (not k) as skipped
from (select *, chrom not in ('GL', 'chr25') as k from p where not is_reference and len(alts) > 0)""",
    "scattered_chromosomes": """with e as (select event_id, cast(case when event_id % 997 = 0 then 3 else event_id // 400 end as varchar) as chrom from events),
g as (select *, lag(chrom) over (order by event_id) as before from e), runs as (select chrom, event_id from g where chrom is distinct from before)
, spans as (select chrom, min(event_id) as a, max(event_id) as b from e group by 1)
select s.chrom from spans s where exists (select 1 from spans t where t.a > s.a and t.a < s.b)""",
    "transcript_regions": _EXON_REGIONS
    + """, n as (select *, lead(start) over w as ns, lead(cdna_start) over w as nc, lead(cdna_end) over w as ne, lead(id) over w as ni
  from x window w as (partition by ref_index, tx order by start, "end"))
select ref_index, tx, 'exon' as kind, id, start, "end", cdna_start, cdna_end from x
union all select ref_index, tx, 'intron', case when reverse then ni else id end, "end" + 1, ns - 1, case when reverse then ne else cdna_end end,
  case when reverse then cdna_start else nc end from n where ns - "end" > 1""",
    "coding_spans": _EXON_REGIONS
    + """, c as (select ref_index, tx, reverse, min(start) + 7 as start, max("end") - 5 as "end" from e group by all),
p as (select *, case when reverse then "end" else start end as a, case when reverse then start else "end" end as b from c),
m as (
  select p.*, (select min_by(case when x.reverse then x.cdna_start + x."end" - a else x.cdna_start + a - x.start end, x.start) from x
      where x.tx = p.tx and x.ref_index = p.ref_index and a between x.start and x."end") as cdna_start,
    (select min_by(case when x.reverse then x.cdna_start + x."end" - b else x.cdna_start + b - x.start end, x.start) from x
      where x.tx = p.tx and x.ref_index = p.ref_index and b between x.start and x."end") as cdna_end from p)
select ref_index, tx, start, "end", cdna_start, cdna_end, cast(greatest(cdna_start - (length(tx) % 7 + 1), 0) as int) as cds_offset from m""",
    "cigar_places": """with l as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_suppkey % 30 + 5)::int as m1, (l_partkey % 6 + 1)::int as d,
    case when l_partkey % 2 = 1 then 131 - l_partkey % 120 else l_partkey % 120 + 1 end::int as goal from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(case when goal <= m1 then 50 + goal when goal <= m1 + 20 then 53 + goal
  when goal <= m1 + 20 + d then 73 + m1 when goal <= m1 + 120 + d then 53 + goal - d else 173 + m1 end as int) as cdna from l""",
    "translated": f"""with r as ({GENOME_DUCK}), v as ({variants_sql("varchar")}),
b as (select l_orderkey, l_linenumber, pos, chrom, substr(seq, pos::int, (20 + l_orderkey % 14)::int) as s from v join r using (chrom))
select l_orderkey, l_linenumber, pos, chrom, reverse(translate(s, 'ACGT', 'TGCA')) as reversed,
  array_to_string(list_transform(range(0, length(s) // 3), lambda k: case when chrom = '24' then {_table(mitochondrial(), "s[k * 3 + 1:k * 3 + 3]")}
    else {_table(STANDARD, "s[k * 3 + 1:k * 3 + 3]")} end), '') || case when length(s) % 3 > 0 then 'X' else '' end as protein from b""",
    "designations": """with c as (select c_custkey, concat('tx', c_custkey % 997) as tx, c_custkey % 5 = 0 as a, c_custkey % 7 = 0 as b, c_custkey % 11 = 0 as c,
  c_custkey % 13 = 0 as d from customer),
u as (select *, bool_or(a) over w as ua, bool_or(b) over w as ub, bool_or(c) over w as uc, bool_or(d) over w as ud from c window w as (partition by tx)),
n as (select *, (ua and not a)::int + (ub and not b)::int + (uc and not c)::int + (ud and not d)::int as newly_set from u)
select c_custkey, tx, newly_set, 1 + 2 * (newly_set > 0)::int + 4 * ub::int + 8 * ua::int + 16 * uc::int + 32 * ud::int as flags from n""",
    "numbered_sequences": """select brand, seq, row_number() over (partition by brand order by seq) - 1 as number
from (select distinct p_brand as brand, upper(p_name) as seq from part)""",
    "numbered_regions": """with r as (select cast(l_orderkey % 25 as int) as chrom, cast(l_partkey % 400 as int) as start, cast(l_partkey % 400 + l_suppkey % 9 as int) as stop,
  l_linenumber as id, min(l_orderkey * 10 + l_linenumber) as seen from lineitem group by all),
n as (select *, row_number() over (partition by chrom order by start, stop, seen) - 1 as i from r)
select chrom, count(*) as n, max(i) as last, cast(sum(i * start) as bigint) as mark from n group by 1""",
    "span_overlaps": f"""with a as ({ORDER_SPANS}), b as ({CUSTOMER_SPANS})
select a.id, count(*) as n, cast(sum(b.id) as bigint) as ids from a join b on a.chrom = b.chrom and a.start <= b."end" and b.start <= a."end" group by 1""",
    "span_bins": f"""with b as ({CUSTOMER_SPANS})
select chrom, cast(g.i as int) as bin, count(*) as n from b, range(0, 60) g(i) where g.i between (start - 1) >> 20 and ("end" - 1) >> 20 group by 1, 2""",
    "genome_chunks": f"""with r as ({GENOME_DUCK}), c as (select chrom, seq, cast(i as int) as chunk, greatest(i * 256 - 640, 0) as lo, least((i + 1) * 256 + 640, 2048) as hi from r, range(0, 8) t(i))
select chrom, chunk, cast(lo as bigint) as lo, md5(seq[lo + 1:hi]) as sum, cast(2048 as bigint) as length from c""",
    "pruned_reference": f"""with r as ({GENOME_DUCK}), c as (select chrom, seq, cast(i as int) as chunk, greatest(i * 256 - 640, 0) as lo, least((i + 1) * 256 + 640, 2048) as hi from r, range(0, 8) t(i)),
  n as (select cast(n_nationkey as varchar) as name, n_regionkey, cast(row_number() over (order by n_nationkey) - 1 as int) as ref_index from nation)
select chrom, chunk, cast(lo as bigint) as lo, md5(seq[lo + 1:hi]) as sum, ref_index from c join n on chrom = name where n_regionkey in (1, 3)""",
    "scalar_ids": """with c as (select c_custkey as k, c_name, sha256(c_name) as h, 'ENSG' || lpad(c_custkey::varchar, 11, '0') as st from customer)
select k as c_custkey, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::bigint as sha_id, k as number,
  case when k % 25 = 24 then case when k % 3 = 0 then 'MT' else 'M' end else (k % 25)::varchar end as contig, 'a,' || k || ';b%' as note,
  case when k % 9 <> 0 then (k % 14)::int end as month, cast((k * 1000003) >> 20 as int) as bin,
  (k % 2 = 1)::int + 2 * (k % 3 = 0)::int + 4 * (k % 5 = 0)::int + 8 * (k % 7 = 0)::int as flags, st as stable_id,
  st || '.' || case when k % 2 = 0 then (k % 9)::varchar else '1' end as versioned from c""",
    "gff3_models": """with t as (select o_orderkey, cast(o_custkey % 25 as int) as ref_index, o_orderkey % 3 <> 0 as kept from orders)
select ref_index, count(*) as genes, count(*) filter (kept) as transcripts,
  cast(sum(case when kept then (select count(*) from lineitem where l_orderkey = o_orderkey) else 0 end) as bigint) as exons from t group by 1""",
    "gene_name_joins": """with n as (select (p_partkey % 700)::varchar as key, max_by(p_partkey, p_partkey) as hgnc, max_by('S' || p_size || '-' || p_partkey, p_partkey) as symbol,
  max_by(case when p_partkey % 4 = 0 then '-' else 'ENSG' || (p_partkey % 900) end, p_partkey) as ens from part group by 1)
select c_custkey, (c_custkey % 1000)::varchar as ncbi, coalesce(n.symbol, c_name) as symbol, n.hgnc as hgnc_id, nullif(n.ens, '-') as ensembl
from customer left join n on n.key = (c_custkey % 1000)::varchar""",
    "fasta_sequences": """select case p_partkey % 3 when 0 then 'NC_' when 1 then 'NM_' else 'NR_' end || p_partkey as accession,
  upper(substr('acgtnacgta', 1, (1 + p_partkey % 9)::int) || replace(p_name, ' ', '')) as seq from part""",
    "genbank_regions": """select 'NM_' || s_suppkey || '.1' as id, cast(s_suppkey + case when s_suppkey % 2 = 0 then 1 else 2 end as int) as start,
  cast(s_suppkey + case when s_suppkey % 2 = 0 then 300 else 200 end as int) as "end", cast(s_suppkey % 3 + 1 as int) as codon_start
from supplier where s_suppkey % 5 <> 0""",
    "fasta_pieces": """with r as (select 'D' || doc_id as accession, upper(regexp_replace(text, '[^A-Za-z]+', '', 'g')) as seq from documents where text is not null),
c as (select accession, seq, unnest(range(0, (greatest(length(seq), 1) - 1) // 1024 + 1)) as i from r)
select accession, cast(i as int) as chunk, cast(greatest(i * 1024 - 100, 0) as bigint) as lo, md5(seq[greatest(i * 1024 - 100, 0) + 1:least((i + 1) * 1024 + 100, length(seq))]) as sum,
  cast(length(seq) as bigint) as length from c""",
    "streamed_counts": _LINES
    + """select chrom, count(*) filter (k) as positions, cast(sum(case when k then len(alts) else 0 end) as bigint) as variants, count(*) filter (not k) as skipped
from (select *, chrom in (select 'chr' || i from range(0, 20) t(i)) as k from p where not is_reference and len(alts) > 0) group by 1""",
}
