"""Genomic inputs derived from the star-schema tables, by the same SQL text in both engines.

Chromosomes come from ``nation`` (2,048 bases each from digests, with long runs of A),
variants and transcripts from ``lineitem`` and ``orders``; every row of those tables is
used, so work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.operators.shared import settled

ALPHABET = "AAAAAAACCCGGGTTT"

GENOME_SPARK = f"""
select cast(n_nationkey as string) as chrom, array_join(transform(sequence(0, 63), i -> translate(md5(concat(
  cast(n_nationkey as string), ':', cast(i as string))), '0123456789abcdef', '{ALPHABET}')), '') as seq from nation"""

GENOME_DUCK = f"""
select cast(n_nationkey as varchar) as chrom, string_agg(translate(md5(concat(cast(n_nationkey as varchar), ':',
  cast(i as varchar))), '0123456789abcdef', '{ALPHABET}'), '' order by i) as seq from nation, range(0, 64) t(i) group by 1"""


def variants_sql(string: str) -> str:
    """Small variants with reference alleles from the genome, and structural ones, one a line item; r is the genome."""
    return f"""
select l_orderkey, l_linenumber, chrom, pos, ref, svtype, pos + length(ref) - 1 + coalesce(svlen, 0) as end_pos,
  case when svtype = 'DEL' then '<DEL>' when svtype = 'DUP' then case when l_linenumber % 2 = 0 then '<DUP:TANDEM>' else '<DUP>' end
    when svtype = 'INV' then '<INV>' when svtype = 'BND' then concat(substr(ref, 1, 1), '[7:', cast(pos as {string}), '[')
    when svtype = 'STR' then concat('<STR', cast(ilen as {string}), '>') when svtype = 'CNV' then
      case when ilen = 0 then '<DEL>' when ilen = 1 then '<DUP>' else '<CNV>' end
    when svtype = 'XX' then '<NOVEL>'
    when dlen > 0 and l_linenumber = 7 then reverse(translate(ref, 'ACGT', 'TGCA'))
    when dlen = 0 and ilen = 0 then translate(ref, 'ACGT', 'CGTA')
    when ilen = 5 then substr(seq, cast(pos as int), 1 + dlen + ilen - 3)
    else concat(substr(ref, 1, 1), substr('GATTACA', 1, ilen)) end as alt
from (
  select v.*, r.seq, case when l_linenumber = 6 and dlen = 4 then 'N' else substr(r.seq, cast(v.pos as int), 1 + dlen) end as ref
  from (
    select l_orderkey, l_linenumber, cast(l_suppkey % 25 as {string}) as chrom,
      cast(100 + (l_orderkey * 7 + l_partkey * 13) % 1800 as bigint) as pos, cast(l_partkey % 5 as int) as dlen,
      cast(l_quantity as int) % 6 as ilen, case when (l_partkey + l_linenumber) % 7 = 0 then cast(l_partkey % 40 as bigint) end as svlen,
      case when (l_partkey + l_linenumber) % 7 = 0 then
        case l_orderkey % 8 when 0 then 'DEL' when 1 then 'DUP' when 2 then 'INV' when 3 then 'BND' when 4 then 'STR'
          when 5 then 'CNV' when 6 then 'XX' end end as svtype
    from lineitem) v
  join r on v.chrom = r.chrom) x"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "nation")
    return spark.sql(GENOME_SPARK)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, chrom, pos, ref, svtype, end_pos, alt."""
    views(spark, sf_dir, "lineitem", "nation")
    v = spark.sql(f"with r as ({GENOME_SPARK}) {variants_sql('string')}")
    # made once, whatever reads them, as rows of a file would be
    return settled(v, "chrom", "pos", "ref", "svtype", "end_pos", "alt")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, chrom, pos of the variants; what their alleles need is left out of the plan."""
    views(spark, sf_dir, "lineitem", "nation")
    return spark.sql(f"with r as ({GENOME_SPARK}) {variants_sql('string')}").select("l_orderkey", "l_linenumber", "chrom", "pos")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, value."""
    return settled(table_sql(spark, sf_dir, lines_sql("string"), "lineitem"), "value")


def lines_sql(string: str) -> str:
    """VCF data lines from line items, as text: one informative or reference record each, with two samples."""
    return f"""
select l_orderkey, l_linenumber, concat_ws(chr(9), case when l_suppkey % 26 = 25 then 'GL' else concat('chr', cast(l_suppkey % 26 as {string})) end,
  cast(100 + l_partkey % 1800 as {string}), case when l_partkey % 3 = 0 then concat('rs', cast(l_partkey as {string})) else '.' end,
  substr('ACGTACGT', cast(1 + l_partkey % 4 as int), cast(1 + l_partkey % 3 as int)),
  case l_partkey % 6 when 0 then '.' when 1 then '<NON_REF>' when 2 then 'T,<NON_REF>' when 3 then 'GA,C' when 4 then '*' else 'TTA' end,
  case when l_partkey % 5 = 0 then '.' when l_partkey % 5 = 1 then '12x' else cast(l_partkey % 90 as {string}) end,
  case when l_suppkey % 3 = 0 then 'PASS' when l_suppkey % 3 = 1 then '.' else 'q10;s50' end,
  concat(case when l_partkey % 4 = 0 then concat('END=', cast(200 + l_partkey % 900 as {string}), ';') else '' end,
    'SVTYPE=', case when l_suppkey % 2 = 0 then 'DEL' else 'DUP' end, ';SVLEN=-', cast(l_suppkey % 50 as {string}), ';SVLEN=',
    cast(-(l_suppkey % 70) as {string}), case when l_partkey % 7 = 0 then ';IMPRECISE' else '' end, ';CIPOS=-', cast(l_suppkey % 9 as {string}), ',',
    cast(l_suppkey % 8 as {string}), ';CIEND=5;MQ=', cast(l_suppkey % 60 as {string}), '.5;REF=', case when l_suppkey % 4 = 0 then 'x' else '12' end),
  'GT:DP:AD:VF:CN:MCN:FT:GQ',
  concat(case l_partkey % 3 when 0 then '0/1' when 1 then '1|2' else '1/2' end, ':', cast(l_suppkey % 40 as {string}), ':', cast(l_partkey % 20 as {string}), ',',
    cast(l_suppkey % 21 as {string}), ':', case when l_partkey % 2 = 0 then '0.25' else '.' end, ':', cast(l_suppkey % 4 as {string}), ':',
    cast(l_partkey % 2 as {string}), ':', case when l_suppkey % 5 = 0 then 'LowQ' else 'PASS' end),
  case when l_suppkey % 6 = 0 then '.' else concat('0/0:', cast(l_partkey % 30 as {string}), ':', case when l_partkey % 10 = 0 then '3,x' else '7,2' end) end) as value
from lineitem"""


#: Exons of transcripts, one for each line number of an order; strand by the order.
EXONS = """
select cast(l_orderkey % 25 as int) as ref_index, concat('tx', l_orderkey) as tx, l_orderkey % 2 = 1 as reverse,
  cast(l_linenumber * 1000 + min(l_partkey) % 300 as int) as start,
  cast(l_linenumber * 1000 + min(l_partkey) % 300 + 50 + min(l_suppkey) % 200 as int) as "end"
from lineitem group by l_orderkey, l_linenumber"""

#: Intervals of orders on 25 chromosomes of 40 million bases, and of customers.
ORDER_SPANS = """
select o_orderkey as id, cast(o_custkey % 25 as int) as chrom, cast(1 + (o_orderkey * 7919) % 40000000 as bigint) as start,
  cast(1 + (o_orderkey * 7919) % 40000000 + (o_orderkey * 31) % 60000 as bigint) as "end" from orders"""
CUSTOMER_SPANS = """
select c_custkey as id, cast(c_nationkey as int) as chrom, cast(1 + (c_custkey * 104729) % 40000000 as bigint) as start,
  cast(1 + (c_custkey * 104729) % 40000000 + 200000 + (c_custkey % 7) * 300000 as bigint) as "end" from customer"""
#: Bands of 130 bases with a gap of 20 after each.
BANDS_SPARK = """
select cast(n_nationkey as string) as chrom, cast(1 + i * 150 as bigint) as begin, cast(130 + i * 150 as bigint) as end, concat('p', n_nationkey, '.', i) as name
from nation lateral view explode(sequence(0, 13)) t as i"""
BANDS_DUCK = """
select cast(n_nationkey as varchar) as chrom, cast(1 + i * 150 as bigint) as begin, cast(130 + i * 150 as bigint) as "end", concat('p', n_nationkey, '.', i) as name
from nation, range(0, 14) t(i)"""


def table_sql(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    views(spark, sf_dir, *names)
    return spark.sql(sql.replace('"end"', "end"))
