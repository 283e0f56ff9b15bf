"""Germlines and reads derived from the business tables, by expressions that any SQL engine evaluates alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq
from spanloom.operators import germline
from spanloom.plans.annotate import Reference, build_reference
from spanloom.session import table


def nt(key: str, salt: str) -> str:
    """SQL: 32 bases from a key."""
    return f"translate(md5(concat({key}, '|{salt}')), '0123456789abcdef', 'ACGTACGTACGTACGT')"


_LOCUS = "CASE {0} % 3 WHEN 0 THEN 'IGH' WHEN 1 THEN 'IGK' ELSE 'TRB' END"
_V = " || ".join(nt("concat({locus}, ':', {key})", f"v{i}") for i in (1, 2, 3))
_J = nt("concat({locus}, ':', {key})", "j")


def _v(locus: str, key: str) -> str:
    return _V.format(locus=locus, key=key)


V_SQL = f"SELECT p_partkey AS k, locus, concat(locus, 'V', p_partkey, '*01') AS allele, {_v('locus', 'p_partkey % 97')} AS sequence FROM (SELECT *, {_LOCUS.format('p_partkey')} AS locus FROM part) t"
J_SQL = f"SELECT s_suppkey AS k, locus, concat(locus, 'J', s_suppkey, '*01') AS allele, {_J.format(locus='locus', key='s_suppkey % 41')} AS sequence, cast(s_suppkey % 3 AS INT) AS frame FROM (SELECT *, {_LOCUS.format('s_suppkey')} AS locus FROM supplier) t"
D_SQL = f"SELECT n_nationkey AS k, CASE n_nationkey % 2 WHEN 0 THEN 'IGH' ELSE 'TRB' END AS locus, concat('D', n_nationkey, '*01') AS allele, substring({nt('n_nationkey', 'd')}, 1, cast(8 + n_nationkey % 24 AS INT)) AS sequence FROM nation"
#: A read: a V and a J of its locus with a D and random bases between, one substitution; every fifth one reversed.
_INS = f"concat(substring({nt('o_orderkey', 'n')}, 1, cast(o_orderkey % 7 AS INT)), substring({nt('o_custkey % 25', 'd')}, 1, cast(8 + o_custkey % 25 % 24 AS INT)), substring({nt('o_orderkey', 'm')}, 1, cast(o_orderkey % 5 AS INT)))"
#: With what it was made of: its V and J, how many bases lie between, and the read as it was before it was reversed.
MADE_SQL = f"""SELECT o_orderkey AS rid, concat('read', o_orderkey) AS read_id, locus, made_v, made_j, length(between_them) AS n_between, mutated,
  CASE WHEN o_orderkey % 5 = 0 THEN reverse(translate(mutated, 'ACGT', 'TGCA')) ELSE mutated END AS sequence
FROM (SELECT *, concat(substring(whole, 1, spot - 1), translate(substring(whole, spot, 1), 'ACGT', 'CATG'), substring(whole, spot + 1)) AS mutated
FROM (SELECT *, concat(made_v, between_them, made_j) AS whole, cast(20 + o_orderkey % 50 AS INT) AS spot
FROM (SELECT *, {_v('locus', 'o_orderkey % 97')} AS made_v, {_INS} AS between_them, {_J.format(locus='locus', key='o_custkey % 41')} AS made_j
FROM (SELECT *, {_LOCUS.format('o_orderkey')} AS locus FROM orders) t) u) v) w"""
READS_SQL = f"SELECT rid, read_id, locus, sequence FROM ({MADE_SQL}) made"
EVENT_NT = nt("event_id", "e")


def view(spark: SparkSession, folder: str, sql: str, *tables: str) -> DataFrame:
    """One of the statements above over the tables of a folder."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: table(spark, folder, t) for t in tables})


def v_alleles(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, V_SQL, "part")


def j_alleles(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, J_SQL, "supplier")


def d_alleles(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, D_SQL, "nation")


def reads(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, READS_SQL, "orders")


#: Regions of a derived V allele from its coding frame on: start and end.
V_REGIONS = {"fwr1": (1, 24), "cdr1": (25, 36), "fwr2": (37, 57), "cdr2": (58, 69), "fwr3": (70, 87)}
FWR4_OFFSET = 13


def scaffolds(spark: SparkSession, folder: str) -> DataFrame:
    j = j_alleles(spark, folder)
    return germline.scaffolds(v_alleles(spark, folder), j, j.select("allele", "frame"))


def reference(spark: SparkSession, folder: str) -> Reference:
    v, j = v_alleles(spark, folder), j_alleles(spark, folder)
    v_regions = v.select("allele", *(F.lit(x).alias(f"{r}_{n}") for r, b in V_REGIONS.items() for n, x in zip(("start", "end"), b)))
    return build_reference(v, j, v_regions, j.select("allele", F.lit(FWR4_OFFSET).alias("fwr4_offset")), j.select("allele", "frame"), d_alleles(spark, folder).select("locus", "allele", "sequence"))


def in_frame_sql(sequence: str) -> str:
    """DuckDB: a sequence from its coding frame on, as sq.in_frame has it."""
    return f"substr({sequence}, 1 + {frame_sql(sequence)})"


#: For DuckDB, written out apart from the tables of the package: codons by residue, and the commonest of each.
CODONS_SQL = """CASE WHEN c IN ('GCA', 'GCC', 'GCG', 'GCT') THEN 'A' WHEN c IN ('TGC', 'TGT') THEN 'C' WHEN c IN ('GAC', 'GAT') THEN 'D'
WHEN c IN ('GAA', 'GAG') THEN 'E' WHEN c IN ('TTC', 'TTT') THEN 'F' WHEN c IN ('GGA', 'GGC', 'GGG', 'GGT') THEN 'G'
WHEN c IN ('CAC', 'CAT') THEN 'H' WHEN c IN ('ATA', 'ATC', 'ATT') THEN 'I' WHEN c IN ('AAA', 'AAG') THEN 'K'
WHEN c IN ('CTA', 'CTC', 'CTG', 'CTT', 'TTA', 'TTG') THEN 'L' WHEN c = 'ATG' THEN 'M' WHEN c IN ('AAC', 'AAT') THEN 'N'
WHEN c IN ('CCA', 'CCC', 'CCG', 'CCT') THEN 'P' WHEN c IN ('CAA', 'CAG') THEN 'Q'
WHEN c IN ('AGA', 'AGG', 'CGA', 'CGC', 'CGG', 'CGT') THEN 'R' WHEN c IN ('AGC', 'AGT', 'TCA', 'TCC', 'TCG', 'TCT') THEN 'S'
WHEN c IN ('ACA', 'ACC', 'ACG', 'ACT') THEN 'T' WHEN c IN ('GTA', 'GTC', 'GTG', 'GTT') THEN 'V' WHEN c = 'TGG' THEN 'W'
WHEN c IN ('TAC', 'TAT') THEN 'Y' WHEN c IN ('TAA', 'TAG', 'TGA') THEN '*' ELSE 'X' END"""
COMMON_SQL = """CASE c WHEN 'A' THEN 'GCC' WHEN 'C' THEN 'TGC' WHEN 'D' THEN 'GAC' WHEN 'E' THEN 'GAG' WHEN 'F' THEN 'TTC' WHEN 'G' THEN 'GGC'
WHEN 'H' THEN 'CAC' WHEN 'I' THEN 'ATC' WHEN 'K' THEN 'AAG' WHEN 'L' THEN 'CTG' WHEN 'M' THEN 'ATG' WHEN 'N' THEN 'AAC' WHEN 'P' THEN 'CCC'
WHEN 'Q' THEN 'CAG' WHEN 'R' THEN 'AGG' WHEN 'S' THEN 'AGC' WHEN 'T' THEN 'ACC' WHEN 'V' THEN 'GTG' WHEN 'W' THEN 'TGG' WHEN 'Y' THEN 'TAC' ELSE 'NNN' END"""


def translate_sql(sequence: str, frame: str) -> str:
    """DuckDB: codons of a sequence from an offset."""
    return f"array_to_string([{CODONS_SQL} FOR c IN regexp_extract_all(upper(substr({sequence}, 1 + ({frame}))), '...')], '')"


def frame_sql(sequence: str) -> str:
    stops = [f"(length({translate_sql(sequence, str(k))}) - length(replace({translate_sql(sequence, str(k))}, '*', '')))" for k in range(3)]
    return f"(CASE WHEN {stops[0]} <= {stops[1]} AND {stops[0]} <= {stops[2]} THEN 0 WHEN {stops[1]} <= {stops[2]} THEN 1 ELSE 2 END)"
