"""A query for each operator, over tables of a folder, and its SQL for a second engine where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq
from spanloom.operators import concordance, d_mapping, germline, mutation, projection, seed_join
from spanloom.operators.aligner import Scoring
from spanloom.plans import annotate, derived, records_sql
from spanloom.plans.records import COLUMNS
from spanloom.session import materialised, shared_dir, spread, table
from spanloom.sources import seqfiles, sinks
from spanloom.streaming.annotate import annotate_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Scalar functions

_PART_NT = derived.nt("p_partkey", "t")


def _part(spark: SparkSession, folder: str) -> DataFrame:
    return derived.view(spark, folder, f"SELECT p_partkey, cast(p_partkey % 3 AS INT) AS frame, {_PART_NT} AS nt FROM part", "part")


_PART = f"(SELECT p_partkey, p_partkey % 3 AS frame, {_PART_NT} AS nt FROM part)"


@query(f"SELECT p_partkey, {derived.translate_sql('nt', 'frame')} AS aa FROM {_PART}")
def f1_translate(spark, folder):
    return _part(spark, folder).select("p_partkey", sq.translate(F.col("nt"), F.col("frame")).alias("aa"))


@query(f"SELECT p_partkey, {derived.frame_sql('nt')}::INTEGER AS coding_frame FROM {_PART}")
def f2_coding_frame(spark, folder):
    return _part(spark, folder).select("p_partkey", sq.coding_frame(F.col("nt")).cast("int").alias("coding_frame"))


@query(f"SELECT p_partkey, reverse(translate(regexp_replace(upper(replace(nt, 'CC', 'nr')), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc FROM {_PART}")
def f3_reverse_complement(spark, folder):
    return _part(spark, folder).select("p_partkey", sq.reverse_complement(F.replace("nt", F.lit("CC"), F.lit("nr"))).alias("rc"))


@query(f"SELECT p_partkey, array_to_string([{derived.COMMON_SQL} FOR c IN string_split({derived.translate_sql('nt', 'frame')}, '')], '') AS nt FROM {_PART}")
def f4_back_translate(spark, folder):
    return _part(spark, folder).select("p_partkey", sq.back_translate(sq.translate(F.col("nt"), F.col("frame"))).alias("nt"))


@query("SELECT l_orderkey, l_linenumber, (floor((l_partkey % 40 - l_suppkey % 9) / 3.0) + 1)::INTEGER AS aa_start FROM lineitem")
def f5_aa_coordinate(spark, folder):
    at = sq.aa_coordinate(F.col("l_partkey") % 40, F.col("l_suppkey") % 9)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", at.alias("aa_start"))


@query(f"SELECT c AS codon, {derived.CODONS_SQL} AS aa, count(*) AS n FROM (SELECT unnest(regexp_extract_all(nt, '...')) AS c FROM {_PART}) x GROUP BY c")
def f7_codon_table(spark, folder):
    """The codons that sequences have, with their residues and how often they occur."""
    codons = _part(spark, folder).select(F.explode(F.regexp_extract_all("nt", F.lit("(...)"))).alias("codon"))
    return codons.groupBy("codon").agg(F.count(F.lit(1)).alias("n")).select("codon", sq.translate(F.col("codon")).alias("aa"), "n")


@query(f"SELECT p_partkey, substr(nt, p_partkey % 11 + 1, p_partkey % 9 + 1) AS part FROM {_PART}")
def f14_region_slice(spark, folder):
    start = F.col("p_partkey") % 11 + 1
    return _part(spark, folder).select("p_partkey", sq.sliced(F.col("nt"), start, start + F.col("p_partkey") % 9).alias("part"))


@query("SELECT l_orderkey, l_linenumber, ((3 - (l_partkey + l_suppkey % 3) % 3) % 3 + CASE WHEN l_linenumber % 2 = 0 THEN 9 ELSE 0 END)::INTEGER AS n_pad FROM lineitem")
def f17_n_padding(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", sq.n_padding(F.col("l_partkey"), F.col("l_suppkey") % 3, F.col("l_linenumber") % 2 == 0).alias("n_pad"))


@query(f"SELECT k, {derived.in_frame_sql('sequence')} AS v FROM ({derived.V_SQL}) x")
def f18_v_in_frame(spark, folder):
    return derived.v_alleles(spark, folder).select("k", sq.in_frame(F.col("sequence")).alias("v"))


@query("SELECT p_partkey, split_part(split_part(concat(p_brand, '*', p_size, ',', p_name), ',', 1), '*', 1) AS gene FROM part")
def f19_gene_of_call(spark, folder):
    return table(spark, folder, "part").select("p_partkey", sq.gene_of_call(F.concat("p_brand", F.lit("*"), F.col("p_size").cast("string"), F.lit(","), "p_name")).alias("gene"))


@query("SELECT p_partkey, split_part(concat('L', p_size, '_', p_partkey), '_', 1) AS locus FROM part")
def f20_locus_of_id(spark, folder):
    return table(spark, folder, "part").select("p_partkey", sq.locus_of_id(F.concat(F.lit("L"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string"))).alias("locus"))


@query("SELECT l_orderkey, l_linenumber, s > e AS rev, CASE WHEN s > e THEN 300 - s + 1 ELSE s END AS qs, CASE WHEN s > e THEN 300 - e + 1 ELSE e END AS qe FROM (SELECT *, l_partkey % 200 + 1 AS s, l_suppkey % 200 + 1 AS e FROM lineitem)")
def f21_reverse_remap(spark, folder):
    rev, start, end = seed_join.remapped(F.col("l_partkey") % 200 + 1, F.col("l_suppkey") % 200 + 1, F.lit(300))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", rev.alias("rev"), start.alias("qs"), end.alias("qe"))


@query("SELECT p_partkey, upper(replace(concat(p_name, '.', p_type), '.', '')) AS s FROM part")
def f23_ungapped(spark, folder):
    return table(spark, folder, "part").select("p_partkey", sq.ungapped(F.concat("p_name", F.lit("."), "p_type")).alias("s"))


@query(f"SELECT p_partkey, regexp_matches(aa, '^C.*[FW]$') AND NOT contains(aa, '_') AS canonical FROM (SELECT p_partkey, concat(CASE p_partkey % 2 WHEN 0 THEN 'C' ELSE '' END, {derived.translate_sql('nt', 'frame')}, CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN '_W' ELSE '' END) AS aa FROM {_PART})")
def p13_canonical_junction(spark, folder):
    k = F.col("p_partkey")
    aa = F.concat(F.when(k % 2 == 0, "C").otherwise(""), sq.translate(F.col("nt"), F.col("frame")), F.when(k % 3 == 0, "F").when(k % 3 == 1, "_W").otherwise(""))
    return _part(spark, folder).select("p_partkey", sq.canonical_junction(aa).alias("canonical"))


@query("SELECT p_partkey, TRY_CAST(split_part(p_name, ' ', 1) AS INTEGER) AS number, coalesce(TRY_CAST(p_size::VARCHAR AS INTEGER), 0) AS size FROM part")
def p4_lenient_numbers(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.substring_index("p_name", " ", 1).try_cast("int").alias("number"), seqfiles.lenient(F.col("p_size").cast("string")).alias("size"))


# Sources and sinks: written to the shared folder, and read back


@query("SELECT k, allele AS read_id, sequence FROM (" + derived.V_SQL + ") x")
def s3_fasta(spark, folder):
    path = _place(spark, "fasta")
    sinks.write_fasta(derived.v_alleles(spark, folder).select(F.concat("allele", F.lit(" k="), F.col("k").cast("string")).alias("read_id"), "sequence"), path)
    rows = seqfiles.read_fasta(spark, path, full_header=True)
    return rows.select(F.regexp_extract("read_id", r"k=(\d+)$", 1).cast("long").alias("k"), F.substring_index("read_id", " ", 1).alias("read_id"), "sequence")


@query("SELECT read_id, sequence FROM (" + derived.READS_SQL + ") x")
def s4_fastq(spark, folder):
    path = _place(spark, "fastq")
    rows = derived.reads(spark, folder)
    rows.select(F.concat(F.lit("@"), "read_id", F.lit(" x\n"), "sequence", F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("sequence")))).write.text(path)
    return seqfiles.read_sequences(spark, path).select("read_id", "sequence")


@query("SELECT read_id, sequence FROM (" + derived.READS_SQL + ") x UNION ALL SELECT allele, sequence FROM (" + derived.V_SQL + ") y")
def s5_mixed_folder(spark, folder):
    """A folder of FASTQ and FASTA files, each read by its own kind."""
    path = _place(spark, "mixed")
    quality = F.repeat(F.lit("@>"), F.length("sequence"))
    derived.reads(spark, folder).select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "sequence", F.lit("\n+\n"), F.substring(quality, F.lit(1), F.length("sequence")))).write.text(f"{path}/a")
    sinks.write_fasta(derived.v_alleles(spark, folder).select(F.col("allele").alias("read_id"), "sequence"), f"{path}/b")
    return seqfiles.read_sequences(spark, f"{path}/*").select("read_id", "sequence")


@query("SELECT concat('seq', row_number() OVER (ORDER BY r_regionkey) - 1) AS read_id, r_name AS sequence FROM region")
def s6_in_memory(spark, folder):
    names = [r.r_name for r in table(spark, folder, "region").orderBy("r_regionkey").collect()]  # five regions
    return seqfiles.from_sequences(spark, names).select("read_id", "sequence")


@query("SELECT locus, allele, upper(sequence) AS sequence FROM (" + derived.D_SQL + ") x")
def s10_d_germlines(spark, folder):
    path = _place(spark, "d")
    sinks.write_fasta(derived.d_alleles(spark, folder).select(F.concat_ws("|", "locus", "allele").alias("read_id"), F.lower("sequence").alias("sequence")), path)
    return seqfiles.read_d_germlines(spark, path)


@query("SELECT allele, frame FROM (" + derived.J_SQL + ") x")
def s11_j_frames(spark, folder):
    path = _place(spark, "frames")
    j = derived.j_alleles(spark, folder)
    lines = j.select(F.concat("allele", F.lit("  "), F.col("frame").cast("string"), F.lit(" JH 9")).alias("value"))
    junk = spark.createDataFrame([("# a comment",), ("",), ("broken",), ("bad x",)], "value string")
    lines.unionByName(junk).write.text(path)
    return seqfiles.read_j_frames(spark, path)


@query("SELECT allele, CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'ORF' ELSE 'P' END AS functionality FROM (" + derived.V_SQL + ") x")
def s12_functionality(spark, folder):
    path = _place(spark, "imgt")
    code = F.when(F.col("k") % 3 == 0, "F").when(F.col("k") % 3 == 1, "(ORF)").otherwise("[P]/x")
    v = derived.v_alleles(spark, folder)
    sinks.write_fasta(v.select(F.concat(F.lit("X|"), "allele", F.lit("|Homo|"), code, F.lit("|V")).alias("read_id"), "sequence"), path)
    return seqfiles.read_functionality(spark, path).select("allele", "functionality")


@query("SELECT concat_ws(chr(9), o_orderkey, o_orderstatus, coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END::VARCHAR, ''), CASE WHEN o_custkey % 2 = 0 THEN 'T' ELSE 'F' END) AS line FROM orders")
def k3_airr_lines(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("c"), (F.col("o_custkey") % 2 == 0).alias("flag"))
    return sinks.airr_lines(rows)


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def k1_airr_table(spark, folder):
    path = _place(spark, "airr")
    sinks.write_airr(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path, 1)
    return seqfiles.read_airr(spark, path, ["o_orderkey", "o_orderstatus", "absent", "o_orderpriority"])


@query("SELECT shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 7)::INTEGER AS shard FROM orders) GROUP BY shard")
def k7_shards(spark, folder):
    rows = sinks.sharded(table(spark, folder, "orders").select("o_orderkey"), 7, "o_orderkey")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def k8_merge(spark, folder):
    source, target = _place(spark, "parts"), _place(spark, "merged")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    for i in range(3):
        sinks.write_airr(s.filter(F.col("s_suppkey") % 3 == i), f"{source}/out_{i}", 1)
    sinks.merge(spark, f"{source}/out_*", target)
    return seqfiles.read_airr(spark, target)


@query("SELECT shard, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY rid) - 1) % 4 AS shard FROM (" + derived.READS_SQL + ") x) GROUP BY shard")
def k5_fasta_shards(spark, folder):
    path = _place(spark, "shards")
    sinks.split(derived.reads(spark, folder), 4, path)
    rows = [seqfiles.read_fasta(spark, f"{path}/shard={i}").select(F.lit(i).cast("long").alias("shard")) for i in range(4)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


# Germline operators

_SCAFFOLDS = f"""WITH v AS (SELECT locus, allele, {derived.in_frame_sql('sequence')} AS seq FROM ({derived.V_SQL}) x), j AS ({derived.J_SQL}),
p AS (SELECT v.locus, v.allele AS va, j.allele AS ja, (3 - (length(v.seq) + j.frame) % 3) % 3 + CASE WHEN v.locus IN ('TRB', 'TRD', 'IGH') THEN 9 ELSE 0 END AS n_pad, length(v.seq) AS v_length, v.seq, j.sequence AS jseq FROM v JOIN j USING (locus)),
a AS (SELECT *, concat(seq, repeat('N', n_pad::INTEGER), jseq) AS sequence FROM p),
g AS (SELECT locus, sequence, array_to_string(list_sort(list_distinct(list(va))), ',') AS v_calls, array_to_string(list_sort(list_distinct(list(ja))), ',') AS j_calls,
  arg_min(n_pad, va || '|' || ja)::INTEGER AS n_pad, arg_min(v_length, va || '|' || ja)::INTEGER AS v_length FROM a GROUP BY locus, sequence)
"""


@query(_SCAFFOLDS + "SELECT concat(locus, '_', row_number() OVER (PARTITION BY locus ORDER BY sequence) - 1) AS scaffold_id, locus, sequence, v_calls, j_calls, n_pad, v_length FROM g")
def a3_scaffolds(spark, folder):
    rows = derived.scaffolds(spark, folder)
    return rows.select("scaffold_id", "locus", "sequence", F.array_join("v_calls", ",").alias("v_calls"), F.array_join("j_calls", ",").alias("j_calls"), "n_pad", "v_length")


@query(f"SELECT v.locus, count(*) AS n_pairs, count(DISTINCT v.allele) AS n_v, count(DISTINCT j.allele) AS n_j FROM ({derived.V_SQL}) v JOIN ({derived.J_SQL}) j USING (locus) GROUP BY v.locus")
def j8_v_by_j(spark, folder):
    v, j = derived.v_alleles(spark, folder), derived.j_alleles(spark, folder)
    return germline.build_counts(v, j, v, v).select("locus", F.col("n_combinations").alias("n_pairs"), "n_v", "n_j")


@query(f"SELECT j.allele, coalesce(f.frame, 0) AS frame FROM ({derived.J_SQL}) j LEFT JOIN (SELECT * FROM ({derived.J_SQL}) z WHERE k % 2 = 0) f USING (allele)")
def j9_j_frames(spark, folder):
    j = derived.j_alleles(spark, folder)
    frames = j.filter("k % 2 = 0").select("allele", "frame")
    return germline.framed(j.select("locus", "allele", "sequence"), frames).select("allele", "frame")


@query(f"SELECT allele, upper(sequence) AS sequence FROM ({derived.V_SQL}) x WHERE k % 3 < 2")
def p5_functional(spark, folder):
    v = derived.v_alleles(spark, folder)
    codes = v.select("allele", F.when(F.col("k") % 3 == 0, "F").when(F.col("k") % 3 == 1, "ORF").otherwise("P").alias("functionality"))
    dotted = v.select("allele", F.lower(F.concat(F.substring("sequence", 1, 10), F.lit("..."), F.substring("sequence", 11, 200))).alias("sequence"))
    return germline.functional(dotted, codes)


_COORDINATES = [f"{r}_{x}" for r in sq.REGIONS for x in ("start", "end")]


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity::INTEGER % 5 <> 0 AND l_linenumber % 4 <> 0")
def p6_complete(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    value = {c: F.lit("7") for c in _COORDINATES}
    value["fwr1_start"] = F.when(F.col("l_quantity").cast("int") % 5 == 0, F.when(F.col("l_linenumber") % 2 == 0, "NA")).otherwise("1")
    value["fwr4_end"] = F.when(F.col("l_linenumber") % 4 == 0, "").otherwise("9")
    return germline.complete(rows.select("*", *(v.alias(c) for c, v in value.items()))).select("l_orderkey", "l_linenumber")


_LOCUS_GATE = "SELECT x.k, x.locus, CASE k % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'rat' ELSE 'rabbit' END AS organism FROM (" + derived.V_SQL + ") x"


@query(f"SELECT k, organism, locus FROM ({_LOCUS_GATE}) WHERE organism = 'human' OR starts_with(locus, 'IG')")
def p11_locus_gate(spark, folder):
    """Alleles of loci that can be annotated for their organism."""
    organism = F.element_at(F.array(*map(F.lit, ("human", "rat", "rabbit"))), (F.col("k") % 3 + 1).cast("int"))
    return germline.gated(derived.v_alleles(spark, folder).select("k", "locus", organism.alias("organism"))).select("k", "organism", "locus")


@query(f"{_SCAFFOLDS} SELECT locus, nv AS n_v, nj AS n_j, nv * nj AS n_combinations, n_scaffolds, n_scaffolds AS n_annotated, 0::BIGINT AS n_dropped FROM (SELECT locus, count(*) AS nv FROM v GROUP BY locus) JOIN (SELECT locus, count(*) AS nj FROM j GROUP BY locus) USING (locus) JOIN (SELECT locus, count(*) AS n_scaffolds FROM g GROUP BY locus) USING (locus)")
def a8_build_counts(spark, folder):
    built = derived.scaffolds(spark, folder)
    return germline.build_counts(derived.v_alleles(spark, folder), derived.j_alleles(spark, folder), built, derived.reference(spark, folder).scaffolds)


@query(f"SELECT locus, array_to_string(list_sort(list(allele)), ',') AS alleles, count(*) AS n FROM ({derived.D_SQL}) x GROUP BY locus")
def a7_d_by_locus(spark, folder):
    return derived.d_alleles(spark, folder).groupBy("locus").agg(F.array_join(F.array_sort(F.collect_list("allele")), ",").alias("alleles"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT locus, sequence FROM ({derived.V_SQL}) x")
def u4_distinct(spark, folder):
    return derived.v_alleles(spark, folder).select("locus", "sequence").distinct()


@query(f"SELECT locus, allele, sequence FROM ({derived.V_SQL}) x UNION ALL SELECT locus, allele, sequence FROM ({derived.J_SQL}) y")
def u1_union(spark, folder):
    """Tables of two runs, read as one."""
    path, columns = _place(spark, "union"), ["locus", "allele", "sequence"]
    for name, rows in (("v", derived.v_alleles(spark, folder)), ("j", derived.j_alleles(spark, folder))):
        sinks.write_airr(rows.select(*columns), f"{path}/out_{name}")
    return sinks.merged(spark, f"{path}/out_*").select(*columns)


@query("SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1)::INTEGER AS ordinal FROM customer")
def w1_ordinal(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", germline.ordinal("c_nationkey", "c_name").cast("int").alias("ordinal"))


# Hits

_HITS = "SELECT l_orderkey AS rid, l_partkey::VARCHAR AS target, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS bits FROM lineitem"


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.select(F.col("l_orderkey").alias("rid"), F.col("l_partkey").cast("string").alias("target"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("bits"))


@query(f"SELECT rid, target, bits FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY bits DESC NULLS LAST, target) AS r FROM ({_HITS})) WHERE r = 1")
def a1_best_hit(spark, folder):
    return seed_join.best_hits(_hits(spark, folder))


@query(f"SELECT o_orderkey AS rid, target, bits FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY bits DESC NULLS LAST, target) AS r FROM ({_HITS}) WHERE bits > 40) WHERE r = 1) h ON o_orderkey = rid")
def j4_every_read(spark, folder):
    best = seed_join.best_hits(_hits(spark, folder).filter("bits > 40"))
    return seed_join.every_read(table(spark, folder, "orders").select(F.col("o_orderkey").alias("rid")), best)


@query("SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l_partkey = p_partkey")
def j5_markup(spark, folder):
    p = table(spark, folder, "part").filter("p_size > 10").select(F.col("p_partkey").alias("scaffold_id"), "p_brand", "p_type")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("scaffold_id"))
    return germline.marked(rows, p).drop("scaffold_id")


@query(f"SELECT r.rid, d.allele FROM ({derived.READS_SQL}) r JOIN ({derived.D_SQL}) d USING (locus)")
def j6_d_of_locus(spark, folder):
    return d_mapping.of_locus(derived.reads(spark, folder).select("rid", "locus"), derived.d_alleles(spark, folder).withColumnRenamed("sequence", "d")).select("rid", "allele")


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey")
def j4_reads_that_miss(spark, folder):
    hits = table(spark, folder, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return seed_join.missed(table(spark, folder, "orders").select("o_orderkey"), hits, "o_orderkey")


_K = 13
_VSEQ = f"(SELECT locus || min(allele) AS target, sequence FROM ({derived.V_SQL}) x GROUP BY locus, sequence)"
_SEEDS = f"""WITH q AS (SELECT rid AS query, sequence FROM ({derived.READS_SQL}) x), t AS {_VSEQ},
qk AS (SELECT query, i AS pos, substr(sequence, i, {_K}) AS kmer FROM q, unnest(range(1, length(sequence) - {_K - 2})) AS u(i)),
tk AS (SELECT target, i AS pos, substr(sequence, i, {_K}) AS kmer FROM t, unnest(range(1, length(sequence) - {_K - 2})) AS u(i)),
s AS (SELECT query, target, (tk.pos - qk.pos)::INTEGER AS diagonal, count(*) AS n FROM qk JOIN tk USING (kmer) GROUP BY ALL),
b AS (SELECT query, target, max(n) AS n, arg_max(diagonal, n * 100000 + diagonal) AS diagonal FROM s GROUP BY query, target),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, target)::INTEGER AS rank FROM b) """


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    targets = derived.v_alleles(spark, folder).groupBy("locus", "sequence").agg(F.min("allele").alias("a")).select(F.concat("locus", "a").alias("target"), "sequence")
    return seed_join.seeds(derived.reads(spark, folder).select(F.col("rid").alias("query"), "sequence"), targets, _K)


@query(_SEEDS + "SELECT query, target, diagonal, n FROM s")
def j1_seeds(spark, folder):
    return _seeds(spark, folder)


@query(_SEEDS + "SELECT query, target, n, diagonal, rank FROM r WHERE rank <= 3")
def o6_top_targets(spark, folder):
    return seed_join.top(_seeds(spark, folder), 3)


@query(f"SELECT rid AS query, sequence, false AS rev FROM ({derived.READS_SQL}) x UNION ALL SELECT rid, reverse(translate(sequence, 'ACGT', 'TGCA')), true FROM ({derived.READS_SQL}) y")
def p9_both_strands(spark, folder):
    rows = derived.reads(spark, folder).withColumnRenamed("rid", "query")
    return seed_join.both_strands(rows, sq.reverse_complement(F.col("sequence")))


# Projection and D segments

_ALN = f"""SELECT o_orderkey AS rid, cast(o_orderkey % 4 + 1 AS INT) AS qstart, cast(o_orderkey % 6 + 1 AS INT) AS tstart,
  replace(replace({derived.nt('o_orderkey', 'q')}, 'AC', '--'), 'GT', 'TT') AS qaln, replace({derived.nt('o_orderkey', 'q')}, 'TG', '-G') AS taln FROM orders"""
_INTERVALS = (("fwr1", 1, 8), ("cdr1", 9, 12), ("fwr2", 13, 13), ("cdr2", 14, 30), ("fwr3", 31, 60))


@query(f"""WITH a AS ({_ALN}), c AS (SELECT rid, qstart, tstart, i, substr(qaln, i::INTEGER, 1) AS q, substr(taln, i::INTEGER, 1) AS t FROM a, unnest(range(1, length(qaln) + 1)) AS u(i)),
p AS (SELECT rid, q, t, qstart - 1 + sum((q <> '-')::INT) OVER (PARTITION BY rid ORDER BY i) AS qp, tstart - 1 + sum((t <> '-')::INT) OVER (PARTITION BY rid ORDER BY i) AS tp FROM c),
v(name, rs, re) AS (VALUES {', '.join(f"('{n}', {s}, {e})" for n, s, e in _INTERVALS)})
SELECT a.rid, name, min(qp)::INTEGER AS qs, max(qp)::INTEGER AS qe FROM a CROSS JOIN v LEFT JOIN p ON a.rid = p.rid AND q <> '-' AND t <> '-' AND tp BETWEEN rs AND re GROUP BY a.rid, name""")
def j7_projection(spark, folder):
    hits = derived.view(spark, folder, _ALN, "orders")
    intervals = hits.select("rid", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s).alias("rs"), F.lit(e).alias("re")) for n, s, e in _INTERVALS))).alias("v")).select("rid", "v.*")
    return projection.project_rows(hits, intervals, ["rid"])


_INTERIOR = f"SELECT s_suppkey AS rid, CASE s_suppkey % 3 WHEN 0 THEN 'TRB' ELSE 'IGH' END AS locus, concat(substring({derived.nt('s_suppkey', 'i')}, 1, cast(s_suppkey % 9 AS INT)), substring({derived.nt('s_suppkey % 25', 'd')}, 3, 14), substring({derived.nt('(s_suppkey + 7) % 25', 'd')}, 1, cast(s_suppkey % 17 AS INT))) AS interior FROM supplier"
_LOCAL = f"""WITH pr AS (SELECT i.rid, i.locus, d.allele, i.interior, d.sequence AS d FROM ({_INTERIOR}) i JOIN ({derived.D_SQL}) d USING (locus)),
x AS (SELECT rid, allele, i - j AS off, i, CASE WHEN substr(interior, (i + 1)::INTEGER, 1) = substr(d, (j + 1)::INTEGER, 1) THEN 1 ELSE -1 END AS sc FROM pr, unnest(range(0, length(interior))) AS a(i), unnest(range(0, length(d))) AS b(j)),
p AS (SELECT *, sum(sc) OVER (PARTITION BY rid, allele, off ORDER BY i) AS ps FROM x), m AS (SELECT *, ps - sc AS pre, min(ps - sc) OVER (PARTITION BY rid, allele, off ORDER BY i) AS mn FROM p),
k AS (SELECT *, max(CASE WHEN pre = mn THEN i END) OVER (PARTITION BY rid, allele, off ORDER BY i) AS st, ps - mn AS cur FROM m),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid, allele ORDER BY cur DESC, off, i) AS r FROM k) WHERE r = 1),
l AS (SELECT rid, locus, allele, CASE WHEN cur > 0 THEN cur ELSE 0 END::INTEGER AS score, CASE WHEN cur > 0 THEN st ELSE -1 END::INTEGER AS s, CASE WHEN cur > 0 THEN i ELSE -1 END::INTEGER AS e FROM pr LEFT JOIN b USING (rid, allele)) """


def _local(spark: SparkSession, folder: str) -> DataFrame:
    inside = spread(derived.view(spark, folder, _INTERIOR, "supplier"))
    pairs = d_mapping.of_locus(inside, derived.d_alleles(spark, folder).withColumnRenamed("sequence", "d"))
    return d_mapping.local_rows(pairs.select("rid", "locus", "allele", "interior", "d"), ["rid", "locus", "allele"])


@query(_LOCAL + "SELECT * FROM l")
def f12_d_alignment(spark, folder):
    return _local(spark, folder)


@query(_LOCAL + """, u AS (SELECT * FROM l WHERE score >= 6 AND s >= 0), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, e - s DESC, allele) AS r FROM u) WHERE r = 1),
g AS (SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY u.rid ORDER BY u.score DESC, u.e - u.s DESC, u.allele) AS r FROM u JOIN f USING (rid) WHERE u.locus IN ('IGH', 'TRD') AND u.score >= 7 AND (u.e < f.s OR u.s > f.e)) WHERE r = 1)
SELECT f.rid, f.allele AS d_call, f.s AS d_start, f.e AS d_end, g.allele AS d2_call, g.s AS d2_start, g.e AS d2_end FROM f LEFT JOIN g USING (rid)""")
def a2_best_d(spark, folder):
    best = d_mapping.best_rows(_local(spark, folder), ["rid"])
    field = lambda d, f, name: F.col(f"{d}.{f}").alias(name)
    return best.select("rid", field("d1", "allele", "d_call"), field("d1", "s", "d_start"), field("d1", "e", "d_end"), field("d2", "allele", "d2_call"), field("d2", "s", "d2_start"), field("d2", "e", "d2_end"))


# Records


@query()
def flagship(spark, folder):
    """All reads of the folder annotated: 52 columns."""
    return annotate.annotate(derived.reads(spark, folder).select("rid", "read_id", "sequence"), derived.reference(spark, folder)).select(*COLUMNS)


#: What annotation must find of a read, by how it was made: the alleles of its V, and the regions that lie in it; where its J
#: is in the reference and not more than 20 bases lie between, also FR4, CDR3 and the alleles of J. Reads whose V no
#: allele has are left out.
_TRUTH = f"""WITH v AS (SELECT locus, in_frame, array_to_string(list_sort(list_distinct(list(allele))), ',') AS v_call FROM (SELECT *, {derived.in_frame_sql('sequence')} AS in_frame FROM ({derived.V_SQL}) x) y GROUP BY locus, in_frame),
j AS (SELECT locus, sequence AS made_j, array_to_string(list_sort(list_distinct(list(allele))), ',') AS j_call FROM ({derived.J_SQL}) x GROUP BY locus, sequence),
t AS (SELECT r.*, v_call, CASE WHEN n_between <= 20 THEN j_call END AS j_call, length(made_v) - length(in_frame) AS o FROM (SELECT *, {derived.in_frame_sql('made_v')} AS in_frame FROM ({derived.MADE_SQL}) m) r JOIN v USING (locus, in_frame) LEFT JOIN j USING (locus, made_j))
SELECT read_id AS sequence_id, locus, rid % 5 = 0 AS rev_comp, v_call, {", ".join(f"substr(mutated, o + {a}, {b - a + 1}) AS {r}" for r, (a, b) in derived.V_REGIONS.items())},
j_call, CASE WHEN j_call IS NOT NULL THEN substr(mutated, o + {derived.V_REGIONS["fwr3"][1] + 1}, length(made_v) + n_between + {derived.FWR4_OFFSET - 1} - o - {derived.V_REGIONS["fwr3"][1]}) END AS cdr3,
CASE WHEN j_call IS NOT NULL THEN substr(made_j, {derived.FWR4_OFFSET}) END AS fwr4 FROM t"""


@query(_TRUTH)
def searched_records(spark, folder):
    """Calls and regions that the search gives to reads of known origin."""
    made = derived.view(spark, folder, derived.MADE_SQL, "orders")
    v, j = (f(spark, folder).select("locus", F.col("sequence").alias(n)).distinct() for f, n in ((derived.v_alleles, "made_v"), (derived.j_alleles, "made_j")))
    made = made.join(v, ["locus", "made_v"], "left_semi").join(j.withColumn("has_j", F.lit(True)), ["locus", "made_j"], "left")
    made = materialised(made.select("rid", "read_id", "sequence", (F.col("has_j") & (F.col("n_between") <= 20)).alias("sure")), "made")
    rows = annotate.annotate(made.select("rid", "read_id", "sequence"), derived.reference(spark, folder))
    rows = rows.join(made.select("rid", "sure"), "rid")
    return rows.select("sequence_id", "locus", "rev_comp", "v_call", *derived.V_REGIONS, *(F.when(F.col("sure"), F.col(c)).alias(c) for c in ("j_call", "cdr3", "fwr4")))


_SEEDS = " UNION ALL ".join(f"SELECT {{key}}, s, concat('{i}', {', '.join(f'substr(sequence, s + {m.start()}, {len(m[0])})' for m in re.finditer('1+', p))}) AS seed FROM (SELECT *, unnest(range(1, length(sequence) - {len(p) - 2})) AS s FROM ({{rows}}) x)" for i, p in enumerate(Scoring().seeds))


@query(f"WITH d AS ({_SEEDS.format(key='allele', rows=derived.D_SQL)}), r AS ({_SEEDS.format(key='rid', rows=derived.READS_SQL)}) SELECT allele, count(*) AS n, count(DISTINCT rid) AS reads FROM r JOIN d USING (seed) GROUP BY allele")
def k9_postings(spark, folder):
    """How many seeds reads share with D germlines, whose postings are in buckets on disk."""
    path, scoring = _place(spark, "postings"), Scoring()
    targets = derived.d_alleles(spark, folder).select(F.col("allele").alias("target"), "sequence")
    seed_join.write_postings(targets, scoring.seeds, "ACGT", path, 4)
    kept = seed_join.read_postings(spark, path, "STRING", 4)
    found = seed_join.shared_seeds(derived.reads(spark, folder).select(F.col("rid").alias("query"), "sequence"), None, scoring, kept)
    return found.groupBy(F.col("target").alias("allele")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query").alias("reads"))


@query("SELECT read_id AS sequence_id, locus, (rid % 5 = 0) AS rev_comp FROM (" + derived.READS_SQL + ") x")
def annotated_locus(spark, folder):
    """The locus and strand that annotation finds are those a read was made from."""
    return flagship(spark, folder).select("sequence_id", "locus", "rev_comp")


def _junk(spark: SparkSession, folder: str) -> DataFrame:
    return derived.view(spark, folder, f"SELECT event_id AS rid, concat('junk', event_id) AS read_id, {derived.EVENT_NT} AS sequence FROM events", "events")


@query(f"SELECT concat('junk', event_id) AS sequence_id, {derived.EVENT_NT} AS sequence, NULL::VARCHAR AS v_call, NULL::INTEGER AS fwr1_start FROM events")
def f22_misses(spark, folder):
    """Reads like nothing in the reference: a record each, with id and sequence only."""
    return annotate.annotate(_junk(spark, folder), derived.reference(spark, folder)).select("sequence_id", "sequence", "v_call", "fwr1_start")


# Records from given hits: every field against SQL that follows its definition


def _given(spark: SparkSession, folder: str, reads: str = records_sql.READS, hits: str = records_sql.HITS) -> tuple[DataFrame, DataFrame, annotate.Reference]:
    reads, hits, markup = (derived.view(spark, folder, x, "customer") for x in (reads, hits, records_sql.MARKUP))
    starts, ends = (F.array(*(F.col(f"{r}_{x}") for r in sq.REGIONS)).alias(f"{x}s") for x in ("start", "end"))
    scaffolds = markup.select("scaffold_id", "locus", "v_call", "j_call", F.lit("").alias("sequence"), starts, ends, "v_sequence_end", "j_sequence_start")
    return reads, hits, annotate.Reference(scaffolds, derived.d_alleles(spark, folder).select("locus", "allele", "sequence"))


def _record_query(name: str, *columns: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return annotate.from_hits(*_given(spark, folder)).select(*columns)

    QUERIES[name], SQL[name] = run, records_sql.record_sql(*columns)


_record_query("record", *COLUMNS)
_record_query("f10_points", "sequence_id", "v_sequence_start", "v_sequence_end", "j_sequence_start")
_record_query("f11_coding_start", "sequence_id", *(f"{r}_aa" for r in sq.REGIONS[:6]))
_record_query("f13_junction", "sequence_id", "junction", "junction_aa", "cdr3_aa", "cdr3_start", "cdr3_end")
_record_query("f15_np", "sequence_id", "np1", "np2", "np3")
_record_query("f16_productive", "sequence_id", "productive", "rev_comp")
_record_query("o4_d_order", "sequence_id", "d_call", "d2_call", "d_sequence_start", "d_sequence_end", "d2_sequence_start", "d2_sequence_end")


@query(records_sql.RECORD_AA)
def record_aa(spark, folder):
    """Amino-acid records, from alignments taken as such."""
    rows = annotate.from_hits(*_given(spark, folder, records_sql.READS_AA, records_sql.HITS_AA), annotate.Options("aa"))
    return rows.select(*records_sql.FIELDS_AA)


@query(_SCAFFOLDS + "SELECT concat(locus, '_', row_number() OVER (PARTITION BY locus ORDER BY sequence) - 1) AS sequence_id, locus, v_calls AS v_call, NULL::BOOLEAN AS rev_comp_t FROM g")
def annotated_protein(spark, folder):
    """Proteins of all scaffolds with a residue of every 17 replaced, annotated as amino acids: each finds its own V."""
    reference = annotate.protein_reference(derived.reference(spark, folder))
    reads = reference.scaffolds.select(F.col("scaffold_id").alias("read_id"), F.regexp_replace("sequence", "(.{16})[^W]", "$1W").alias("sequence"))
    reads = materialised(reads.withColumn("rid", F.monotonically_increasing_id()), "proteins")
    rows = annotate.annotate(reads, reference)
    return rows.select("sequence_id", "locus", "v_call", F.when(F.col("rev_comp"), True).alias("rev_comp_t"))


@query(records_sql.record_sql("sequence_id", "aln_score", "aln_identity", "rev_comp", "fwr3_start", "fwr3_end", "junction"))
def s8_hits(spark, folder):
    """Hits of another aligner, written as its table and read back."""
    reads, hits, reference = _given(spark, folder)
    path = _place(spark, "hits")
    fill = lambda c: F.col(c) if c in hits.columns else F.lit(0).alias(c)
    lines = hits.select(*(F.coalesce(fill(c).cast("string"), F.lit("n/a")) for c in seqfiles.HIT))
    lines.select(F.concat_ws("\t", *lines.columns)).write.text(path)
    table_ = annotate.from_hits(reads, seqfiles.read_hits(spark, path), reference)
    return table_.select("sequence_id", "aln_score", "aln_identity", "rev_comp", "fwr3_start", "fwr3_end", "junction")


# Concordance of two tables

_CALLS = "SELECT concat('q', o_orderkey) AS sequence_id, CASE o_orderkey % 3 WHEN 0 THEN 'IGH' WHEN 1 THEN 'TRB' ELSE 'IGK' END AS locus, o_orderkey % 7 <> 0 AS productive, concat('IGHD', o_custkey % 3, '*0', {s}) AS d_call, concat('C', substring(md5(concat('', o_orderkey % {m})), 1, 4), CASE o_orderkey % 4 WHEN 0 THEN '_' ELSE '' END, 'W') AS junction_aa, " + ", ".join("substring(md5(concat('" + r + "', o_orderkey % {m})), 1, cast({n} AS INT)) AS " + r + "_aa" for r in sq.REGIONS[:6]) + " FROM orders"
_OURS, _THEIRS = _CALLS.format(s="o_orderkey % 2", m=50, n="8 + o_orderkey % 2"), _CALLS.format(s="o_orderkey % 5", m=70, n="8")
_PAIR = f"SELECT a.*, b.productive AS tp, b.d_call AS td, b.junction_aa AS tj, " + ", ".join(f"b.{r}_aa AS t_{r}" for r in sq.REGIONS[:6]) + f" FROM ({_OURS}) a JOIN ({_THEIRS}) b USING (sequence_id)"


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return tuple(derived.view(spark, folder, s, "orders") for s in (_OURS, _THEIRS))


@query(" UNION ALL ".join(f"SELECT '{r}' AS region, count(*) AS compared, count(*) FILTER ({f'contains({r}_aa, t_{r}) OR contains(t_{r}, {r}_aa)' if r in concordance.OPEN_REGIONS else f'{r}_aa = t_{r}'}) AS agree FROM ({_PAIR})" for r in sq.REGIONS[:6]))
def a9_region_concordance(spark, folder):
    return concordance.regions(*_tables(spark, folder))


@query(f"SELECT count(*) AS compared, count(*) FILTER (junction_aa = tj) AS junction_agree, count(*) FILTER (substr(junction_aa, 2, length(junction_aa) - 2) = substr(tj, 2, length(tj) - 2)) AS cdr3_agree FROM ({_PAIR}) WHERE tp AND regexp_matches(tj, '^C.*[FW]$') AND NOT contains(tj, '_')")
def a10_junction_concordance(spark, folder):
    return concordance.junctions(*_tables(spark, folder))


@query(f"SELECT CASE locus WHEN 'IGH' THEN 'igh' ELSE 'clean' END AS grp, count(*) AS compared, count(*) FILTER (split_part(d_call, '*', 1) = split_part(td, '*', 1)) AS agree FROM ({_PAIR}) WHERE locus IN ('IGH', 'TRB') GROUP BY 1")
def a11_d_concordance(spark, folder):
    return concordance.d_calls(*_tables(spark, folder))


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS n_reads, (SELECT count(*) FROM orders) AS n_annotated")
def a12_annotated(spark, folder):
    """Reads of the reference's loci and reads like nothing in it, annotated together: just the former get a call."""
    columns = ("rid", "read_id", "sequence")
    every = derived.reads(spark, folder).select(*columns).unionByName(_junk(spark, folder).select(*columns))
    return concordance.annotated(annotate.annotate(every, derived.reference(spark, folder)))


# In SQL


@query(SQL["j7_projection"])
def sql_projection(spark, folder):
    sq.register(spark)
    values = ", ".join(f"('{n}', {s}, {e})" for n, s, e in _INTERVALS)
    return spark.sql(f"SELECT rid, name, p.qs, p.qe FROM (SELECT rid, name, aln_project(qaln, taln, qstart, tstart, rs, re) AS p FROM {{hits}} CROSS JOIN (VALUES {values}) AS v(name, rs, re))", hits=derived.view(spark, folder, _ALN, "orders"))


@query(SQL["f12_d_alignment"])
def sql_d_alignment(spark, folder):
    sq.register(spark)
    i, d = spread(derived.view(spark, folder, _INTERIOR, "supplier")), derived.d_alleles(spark, folder)
    return spark.sql("SELECT rid, locus, allele, b.score, b.s, b.e FROM (SELECT rid, i.locus, allele, d_align(interior, sequence) AS b FROM {i} i JOIN {d} d ON i.locus = d.locus)", i=i, d=d)


@query(f"SELECT substr(sequence, i, 6) AS kmer, count(*) AS n, min(i)::INTEGER AS first FROM (SELECT sequence, unnest(range(1, length(sequence) - 4)) AS i FROM ({derived.V_SQL}) x) y GROUP BY kmer")
def sql_kmers(spark, folder):
    sq.register(spark)
    return spark.sql("SELECT kmer, count(*) AS n, min(pos) AS first FROM {v} v, LATERAL seq_kmers(v.sequence, 6) GROUP BY kmer", v=derived.v_alleles(spark, folder))


# Builds and mutators

_GAPPED = f"SELECT k, locus, allele, concat(substring(sequence, 1, 30), '...', substring(sequence, 31, cast(20 + k % 5 AS INT)), repeat('.', cast(3 + k % 7 AS INT)), substring(sequence, cast(51 + k % 5 AS INT), 200), repeat('A', 220)) AS sequence FROM ({derived.V_SQL}) g"
_COLUMN = "length(replace(substr(sequence, 1, {0}), '.', ''))"
_V_BOUNDS = [(r, f"({_COLUMN.format(3 * (a - 1))} + 1)", f"({_COLUMN.format(3 * b)})") for r, (a, b) in germline.V_COLUMNS.items()]


@query("SELECT k, " + ", ".join(f"(CASE WHEN {a} <= {b} THEN {x} ELSE 0 END)::INTEGER AS {r}_{n}" for r, a, b in _V_BOUNDS for n, x in (("start", a), ("end", b))) + f" FROM ({_GAPPED}) x")
def r1_v_regions(spark, folder):
    v = derived.view(spark, folder, _GAPPED, "part")
    return v.select("k", F.col("k").cast("string").alias("allele"), "sequence").join(germline.v_regions(v.select(F.col("k").cast("string").alias("allele"), "sequence")), "allele").select("k", *(f"{r}_{n}" for r, *_ in _V_BOUNDS for n in ("start", "end")))


_J_MOTIF = f"SELECT k, concat(substring(sequence, 1, cast(k % 11 AS INT)), CASE k % 4 WHEN 0 THEN 'TGGGGCCAAGGC' WHEN 1 THEN 'TTTGGAACTGGG' WHEN 2 THEN '' ELSE 'TTCGGC' END, substring(sequence, 1, 20)) AS sequence FROM ({derived.J_SQL}) g"
_J_AT = [f"(CASE WHEN regexp_matches({derived.translate_sql('sequence', str(f))}, '[FW]G.G') THEN {{'o': 3 * length(regexp_extract({derived.translate_sql('sequence', str(f))}, '^(.*?)[FW]G.G', 1)) + {f + 1}, 'f': {f}}} END)" for f in range(3)]


@query(f"SELECT k, a.f::INTEGER AS frame, a.o::INTEGER AS fwr4_offset FROM (SELECT k, list_min([{', '.join(_J_AT)}]) AS a FROM ({_J_MOTIF}) x) y WHERE a IS NOT NULL")
def r2_j_anchors(spark, folder):
    j = derived.view(spark, folder, _J_MOTIF, "supplier").select(F.col("k").cast("string").alias("allele"), "sequence")
    return germline.j_anchors(j).select(F.col("allele").cast("long").alias("k"), "frame", "fwr4_offset")


@query(_SCAFFOLDS + ", n AS (SELECT locus, row_number() OVER (PARTITION BY locus ORDER BY sequence) - 1 AS i FROM g) SELECT locus, count(*) AS n_scaffolds, count(*) FILTER (i % 7 <> 0) AS n_annotated, count(*) FILTER (i % 7 = 0) AS n_dropped FROM n GROUP BY locus")
def j10_annotated_reference(spark, folder):
    """Scaffolds joined with the rows of an annotator, read from its table; every seventh lacks a region or its row."""
    path, built = _place(spark, "annotator"), materialised(derived.scaffolds(spark, folder), "built")
    i = F.substring_index("scaffold_id", "_", -1).cast("int")
    bounds = [F.lit(str(x)).alias(f"{r}_{n}") for r, b in {**derived.V_REGIONS, "cdr3": (88, 120)}.items() for n, x in zip(("start", "end"), b)]
    rows = built.filter(i % 14 != 7).select(F.col("scaffold_id").alias("sequence_id"), *bounds, F.when(i % 7 == 0, "").otherwise("121").alias("fwr4_start"), F.length("sequence").cast("string").alias("fwr4_end"))
    sinks.write_airr(rows, path)
    return annotate.annotated_reference(built, seqfiles.read_airr(spark, path))[1]


_RANDOM = "md5(concat_ws('|', {key}, '{name}'{place}))"
_AT = "(('0x' || substr({0}, 1, 7))::BIGINT % greatest({1}, 1))"
_CHANCE = _RANDOM.format(key="k", name="replace", place=", i - 1")
_REPLACED = f"array_to_string([CASE WHEN substr({_CHANCE}, 1, 4) < '1eb8' AND contains('ACGT', s[i]) THEN substr(replace('ACGT', s[i], ''), strpos('{mutation.HEX}', substr({_CHANCE}, 5, 1)) % 3 + 1, 1) ELSE s[i] END FOR i IN range(1, length(s) + 1)], '')"
_SHIFT, _WINDOW = (_RANDOM.format(key="k", name=n, place="") for n in ("shift", "window"))
_READ = "concat(" + ", ".join(f"translate({_RANDOM.format(key='k', name='read', place=f', {i}')}, '{mutation.HEX}', '{'ACGT' * 4}')" for i in range(3)) + ")"


@query(f"""SELECT k, {_REPLACED} AS replaced, concat(substr(s, 1, spot), CASE WHEN fewer THEN '' ELSE translate(substr(h, 8, 3), '{mutation.HEX}', '{'ACGT' * 4}') END, substr(s, spot + 1 + CASE WHEN fewer THEN 3 ELSE 0 END)) AS shifted,
substr(s, {_AT.format(_WINDOW, 'length(s) - 59')} + 1, 60) AS part, substr({_READ}, 1, 75) AS random
FROM (SELECT *, {_AT.format('h', 'length(s) - 2')} AS spot, substr(h, 11, 1) < '8' AND length(s) > 3 AS fewer FROM (SELECT k, sequence AS s, {_SHIFT} AS h FROM ({derived.V_SQL}) x) y) z""")
def f24_mutators(spark, folder):
    k, s = F.col("k"), F.col("sequence")
    rows = derived.v_alleles(spark, folder)
    return rows.select("k", mutation.replaced(s, k, 0.12).alias("replaced"), mutation.codon_shift(s, k).alias("shifted"), mutation.window(s, k, 60).alias("part"), mutation.random_read(k, 75).alias("random"))


# Streaming


@query(f"SELECT concat('junk', event_id) AS sequence_id, {derived.EVENT_NT} AS sequence, NULL::VARCHAR AS locus FROM events UNION ALL SELECT allele, sequence, locus FROM ({derived.V_SQL}) x")
def t1_stream(spark, folder):
    """Events as FASTA files and V alleles as FASTQ files that arrive, annotated in micro-batches until none is left:
    events are like nothing in the reference, alleles are of their locus."""
    source, target, state = (_place(spark, n) for n in ("in", "out", "state"))
    sinks.write_fasta(_junk(spark, folder).repartition(2), f"{source}/fasta")
    v = derived.v_alleles(spark, folder)
    v.select(F.concat(F.lit("@"), "allele", F.lit("\n"), "sequence", F.lit("\n+\n"), "sequence")).repartition(2).write.text(f"{source}/fastq")
    annotate_stream(spark, f"{source}/*", target, state, derived.reference(spark, folder), files=2).awaitTermination()
    return seqfiles.read_airr(spark, f"{target}/*", ["sequence_id", "sequence", "locus"])
