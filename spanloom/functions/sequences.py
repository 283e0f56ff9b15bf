"""Column functions over nucleotide (nt) and amino-acid (aa) strings. All stay in the JVM, but for d_align in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The standard genetic code, in the order TCAG of each base, and the commonest codon of each residue.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
COMMON_CODONS = {
    "A": "GCC", "C": "TGC", "D": "GAC", "E": "GAG", "F": "TTC", "G": "GGC", "H": "CAC", "I": "ATC", "K": "AAG", "L": "CTG",
    "M": "ATG", "N": "AAC", "P": "CCC", "Q": "CAG", "R": "AGG", "S": "AGC", "T": "ACC", "V": "GTG", "W": "TGG", "Y": "TAC",
}

REGIONS = ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4")


def codon_table() -> dict[str, str]:
    return {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def _residue(codon: Column) -> Column:
    at = [F.instr(F.lit(BASES), F.substring(codon, i, 1)) for i in (1, 2, 3)]
    known = (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
    return F.when(known, F.substring(F.lit(CODE), (16 * (at[0] - 1) + 4 * (at[1] - 1) + at[2]).cast("int"), F.lit(1))).otherwise("X")


def translate(nt: Column, frame: Column | int = 0) -> Column:
    """Codons from an offset; one with another letter than ACGT reads X, a stop *; a partial codon is dropped."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    rest = F.upper(F.substring(nt, (F.greatest(frame, F.lit(0)) + 1).cast("int"), F.greatest(F.length(nt), F.lit(1))))
    return F.array_join(F.transform(F.regexp_extract_all(rest, F.lit("(?s).{3}"), F.lit(0)), _residue), "")


def stops(nt: Column, frame: int) -> Column:
    """Stop codons of a sequence from an offset."""
    rest = F.upper(F.substring(nt, F.lit(frame + 1), F.greatest(F.length(nt), F.lit(1))))
    codons = F.regexp_extract_all(rest, F.lit("(?s).{3}"), F.lit(0))
    return F.size(F.filter(codons, lambda c: c.isin(*(c for c, a in codon_table().items() if a == "*"))))


def coding_frame(nt: Column) -> Column:
    """The offset with the fewest stops, the first of equals; each frame is looked at once."""
    return F.array_min(F.array(*(F.struct(stops(nt, k).alias("stops"), F.lit(k).alias("frame")) for k in range(3))))["frame"]


def reverse_complement(nt: Column) -> Column:
    """Other letters than ACGT become N; the result is in upper case."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(nt), "[^ACGT]", "N"), "ACGT", "TGCA"))


def back_translate(aa: Column, unknown: str = "NNN") -> Column:
    codon = lambda x: F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in COMMON_CODONS.items() for v in kv)), x), F.lit(unknown))
    return F.array_join(F.transform(F.regexp_extract_all(aa, F.lit("(?s)."), F.lit(0)), codon), "")


def aa_coordinate(position: Column, origin: Column) -> Column:
    """1-based residue of a 1-based nt position, counted from origin; floored."""
    return (F.floor((position - origin) / 3) + 1).cast("int")


def sliced(text: Column, start: Column, end: Column) -> Column:
    """1-based closed slice; null if it has no start; empty if the end lies before it."""
    return F.substring(text, start.cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int"))


def aa_slice(protein: Column, start: Column, end: Column, origin: Column) -> Column:
    """Residues of the nt slice start..end of a protein read from origin."""
    first = F.greatest(F.lit(1), aa_coordinate(start, origin))
    return F.substring(protein, first, F.greatest(aa_coordinate(end, origin) - first + 1, F.lit(0)))


def gene_of_call(call: Column) -> Column:
    """Of a list of calls, the gene of the first one."""
    return F.substring_index(F.substring_index(call, ",", 1), "*", 1)


def locus_of_id(scaffold_id: Column) -> Column:
    return F.substring_index(scaffold_id, "_", 1)


def n_padding(v_length: Column, j_frame: Column, has_d: Column, spacer: int = 9) -> Column:
    """How many N between V and J keep J in frame, and leave room for a D."""
    return (F.pmod(3 - F.pmod(v_length + j_frame, F.lit(3)), F.lit(3)) + F.when(has_d, spacer).otherwise(0)).cast("int")


def in_frame(v: Column) -> Column:
    """A V allele without the bases before its coding frame."""
    return F.substring(v, coding_frame(v) + 1, F.greatest(F.length(v), F.lit(1)))


def ungapped(sequence: Column) -> Column:
    return F.upper(F.translate(sequence, ".", ""))


def canonical_junction(aa: Column) -> Column:
    return F.coalesce(aa.rlike("^C.*[FW]$") & ~F.contains(aa, F.lit("_")), F.lit(False))


_RESIDUE_SQL = f"if(instr('{BASES}', substring(c, 1, 1)) * instr('{BASES}', substring(c, 2, 1)) * instr('{BASES}', substring(c, 3, 1)) > 0, substring('{CODE}', 16 * (instr('{BASES}', substring(c, 1, 1)) - 1) + 4 * (instr('{BASES}', substring(c, 2, 1)) - 1) + instr('{BASES}', substring(c, 3, 1)), 1), 'X')"
SQL_FUNCTIONS = {
    "seq_translate": ("nt STRING, frame INT", "STRING", f"array_join(transform(regexp_extract_all(upper(substring(nt, greatest(frame, 0) + 1)), '(?s).{{3}}', 0), c -> {_RESIDUE_SQL}), '')"),
    "seq_revcomp": ("nt STRING", "STRING", "reverse(translate(regexp_replace(upper(nt), '[^ACGT]', 'N'), 'ACGT', 'TGCA'))"),
    "seq_back_translate": ("aa STRING", "STRING", "array_join(transform(regexp_extract_all(aa, '(?s).', 0), c -> coalesce(element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in COMMON_CODONS.items()) + "), c), 'NNN')), '')"),
    "seq_aa_coordinate": ("position INT, origin INT", "INT", "cast(floor((position - origin) / 3) + 1 AS INT)"),
    "seq_gene": ("call STRING", "STRING", "substring_index(substring_index(call, ',', 1), '*', 1)"),
}


#: As structs: where an interval of the reference (rs to re) falls on the query, through an alignment of two gapped strings.
_PROJECT = """aggregate(sequence(1, greatest(length(qaln), 1)), named_struct('q', qstart - 1, 't', tstart - 1, 'qs', cast(NULL AS INT), 'qe', cast(NULL AS INT)), (a, i) -> named_struct(
'q', a.q + if(substring(qaln, i, 1) IN ('-', ''), 0, 1), 't', a.t + if(substring(taln, i, 1) IN ('-', ''), 0, 1),
'qs', if(substring(qaln, i, 1) NOT IN ('-', '') AND substring(taln, i, 1) NOT IN ('-', '') AND a.t + 1 BETWEEN rs AND re, coalesce(a.qs, a.q + 1), a.qs),
'qe', if(substring(qaln, i, 1) NOT IN ('-', '') AND substring(taln, i, 1) NOT IN ('-', '') AND a.t + 1 BETWEEN rs AND re, a.q + 1, a.qe)), a -> named_struct('qs', a.qs, 'qe', a.qe))"""
SQL_FUNCTIONS["aln_project"] = ("qaln STRING, taln STRING, qstart INT, tstart INT, rs INT, re INT", "STRUCT<qs: INT, qe: INT>", _PROJECT)


def _d_align(interior: pa.Array, d: pa.Array) -> pa.Array:
    """The best run without gaps of two sequences, 1 for each equal base and -1 for each other: its score, and its start and
    end in the first one, from 0; of equals the earliest diagonal, then the earliest end, then the latest start; 0, -1, -1
    if none."""
    from spanloom.operators.d_mapping import best_runs

    return pa.StructArray.from_arrays([pa.array(x) for x in best_runs(interior.to_pylist(), d.to_pylist())], ["score", "s", "e"])


def register(spark: SparkSession) -> None:
    """The functions under SQL names, as SQL expressions that Catalyst inlines; d_align, which has to look at every pair of
    places, goes over Arrow batches."""
    for name, (arguments, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    stops = [f"(length(seq_translate(nt, {k})) - length(replace(seq_translate(nt, {k}), '*', '')))" for k in range(3)]
    case = f"CASE WHEN {stops[0]} <= {stops[1]} AND {stops[0]} <= {stops[2]} THEN 0 WHEN {stops[1]} <= {stops[2]} THEN 1 ELSE 2 END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION seq_frame(nt STRING) RETURNS INT RETURN {case}")
    spark.udf.register("d_align", F.arrow_udf(_d_align, "struct<score: int, s: int, e: int>"))
    kmers = "SELECT pos, substring(sequence, pos, k) FROM (SELECT explode(if(length(sequence) < k, array(), sequence(1, length(sequence) - k + 1))) AS pos)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION seq_kmers(sequence STRING, k INT) RETURNS TABLE(pos INT, kmer STRING) RETURN {kmers}")
