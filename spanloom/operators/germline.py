"""Scaffolds from germlines: V x J within a locus, padded, deduplicated and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq
from spanloom.session import small

#: Locus, receptor group and whether it has D segments; fixed values.
LOCI = (("TRA", "TR", False), ("TRB", "TR", True), ("TRG", "TR", False), ("TRD", "TR", True), ("IGH", "IG", True), ("IGK", "IG", False), ("IGL", "IG", False))
D_LOCI = tuple(name for name, _, d in LOCI if d)
#: Organisms with T-cell annotation; the others have the B-cell loci only.
TR_ORGANISMS = ("human", "mouse")


def loci(spark, organism: str | None = None) -> DataFrame:
    """The loci, or those that can be annotated for an organism."""
    rows = [r for r in LOCI if organism is None or r[1] == "IG" or organism in TR_ORGANISMS]
    return spark.createDataFrame(rows, "locus string, receptor string, has_d boolean")


def gated(rows: DataFrame) -> DataFrame:
    """rows: organism, locus and others. Those whose locus can be annotated for their organism; unknown loci cannot."""
    receptor = F.element_at(F.create_map(*(F.lit(x) for name, group, _ in LOCI for x in (name, group))), F.col("locus"))
    return rows.filter((receptor == "IG") | ((receptor == "TR") & F.col("organism").isin(*TR_ORGANISMS)))


def functional(alleles: DataFrame, functionality: DataFrame) -> DataFrame:
    """alleles: allele, sequence; functionality: allele, functionality. Those that are F or ORF and not empty,
    without dots and in upper case."""
    ok = functionality.filter(F.col("functionality").isin("F", "ORF")).select("allele").distinct()
    return alleles.join(ok, "allele", "left_semi").select("allele", sq.ungapped(F.col("sequence")).alias("sequence")).filter("sequence <> ''")


def framed(j: DataFrame, frames: DataFrame) -> DataFrame:
    """J alleles with their reading frame; frames: allele, frame. One that has none reads from its first base."""
    frames = frames.select(F.col("allele").alias("f_allele"), F.col("frame").alias("f_frame"))
    return j.join(frames, F.col("allele") == F.col("f_allele"), "left").drop("f_allele").withColumn("frame", F.coalesce("f_frame", F.lit(0))).drop("f_frame")


def scaffolds(v: DataFrame, j: DataFrame, frames: DataFrame | None = None, spacer: int = 9) -> DataFrame:
    """v, j: locus, allele, sequence; frames: allele, frame (0 if absent). Returns scaffold_id, locus, sequence,
    v_calls, j_calls (sorted arrays), n_pad, v_length.

    Equal V sequences, and equal J sequences of one frame, are collapsed before they are crossed, so the cross product
    is over distinct sequences. Equal results of different pairs are merged; their n_pad is that of the pair with the
    smallest names."""
    v = v.select("locus", "allele", sq.in_frame(F.col("sequence")).alias("v_seq")).groupBy("locus", "v_seq").agg(F.array_sort(F.collect_set("allele")).alias("vs"))
    j = j.select("locus", "allele", "sequence")
    j = j.withColumn("frame", F.lit(0)) if frames is None else framed(j, frames)
    j = j.select(F.col("locus").alias("j_locus"), F.col("sequence").alias("j_seq"), "frame", "allele")
    j = j.groupBy("j_locus", "j_seq", "frame").agg(F.array_sort(F.collect_set("allele")).alias("js"))
    pairs = v.join(j, F.col("locus") == F.col("j_locus"))
    pad = sq.n_padding(F.length("v_seq"), F.col("frame"), F.col("locus").isin(*D_LOCI), spacer)
    pairs = pairs.withColumn("n_pad", pad).withColumn("sequence", F.concat("v_seq", F.repeat(F.lit("N"), F.col("n_pad")), "j_seq"))
    first = F.struct(F.col("vs")[0], F.col("js")[0])
    merged = pairs.groupBy("locus", "sequence").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("vs")))).alias("v_calls"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("js")))).alias("j_calls"),
        F.min_by(F.struct("n_pad", F.length("v_seq").alias("v_length")), first).alias("of"),
    )
    return merged.select(F.concat_ws("_", "locus", ordinal("locus", "sequence").cast("string")).alias("scaffold_id"), "locus", "sequence", "v_calls", "j_calls", F.col("of.n_pad").alias("n_pad"), F.col("of.v_length").alias("v_length"))


#: The residues of each region of a V in the unique numbering, in which gapped alleles are written; fixed values.
V_COLUMNS = {"fwr1": (1, 26), "cdr1": (27, 38), "fwr2": (39, 55), "cdr2": (56, 65), "fwr3": (66, 104)}


def v_regions(alleles: DataFrame) -> DataFrame:
    """alleles: allele, sequence with dots for the residues that it lacks. Where each region starts and ends without them;
    both are 0 where the allele has none of a region."""
    s = F.col("sequence")
    upto = lambda column: F.length(F.replace(F.substring(s, 1, column), F.lit("."), F.lit("")))
    columns = []
    for r, (a, b) in V_COLUMNS.items():
        start, end = upto(3 * (a - 1)) + 1 if a > 1 else F.lit(1), upto(3 * b)
        columns += [F.when(start <= end, x).otherwise(0).alias(f"{r}_{n}") for n, x in (("start", start), ("end", end))]
    return alleles.select("allele", *columns)


def j_anchors(alleles: DataFrame) -> DataFrame:
    """alleles: allele, sequence of J. Of the first tryptophan or phenylalanine that glycine, any residue and glycine
    follow: its reading frame and the base where FR4 starts; an allele without one is left out."""
    s = sq.ungapped(F.col("sequence"))
    at = lambda k: F.regexp_instr(sq.translate(s, k), F.lit("[FW]G.G"))
    found = F.array_min(F.array(*(F.when(at(k) > 0, F.struct((3 * (at(k) - 1) + k + 1).alias("fwr4_offset"), F.lit(k).alias("frame"))) for k in range(3))))
    return alleles.select("allele", found.alias("f")).filter("f is not null").select("allele", "f.frame", "f.fwr4_offset")


def annotated(scaffolds: DataFrame, records: DataFrame) -> DataFrame:
    """scaffolds: scaffold_id, locus, sequence, v_calls, j_calls, n_pad, v_length; records: an annotator's AIRR rows of them,
    by sequence_id, as text. Scaffolds with the starts and ends of their regions; incomplete ones are left out. Of several
    rows of one scaffold the first that is complete counts, in the order of its coordinates."""
    names = [f"{r}_{x}" for r in sq.REGIONS for x in ("start", "end")]
    has = set(records.columns)
    known = complete(records.select(F.col("sequence_id").alias("scaffold_id"), *((F.col(n) if n in has else F.lit(None)).alias(n) for n in names)))
    numbers = [F.col(n).try_cast("int").alias(n) for n in names]
    known = known.select("scaffold_id", *numbers).dropna().groupBy("scaffold_id").agg(F.min(F.struct(*names)).alias("r")).select("scaffold_id", "r.*")
    return scaffolds.join(known, "scaffold_id")


def ordinal(group: str, order: str) -> Column:
    """The place of a row in its group, from 0."""
    return F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1


def marked(hits: DataFrame, markup: DataFrame, key: str = "scaffold_id") -> DataFrame:
    """Hits with the markup of their scaffold; one of a scaffold that is not known stays, with nulls. A small markup is
    broadcast."""
    return hits.join(small(markup), key, "left")


def complete(markup: DataFrame) -> DataFrame:
    """Rows with all region coordinates; '' and 'NA' count as missing."""
    names = [f"{r}_{x}" for r in sq.REGIONS for x in ("start", "end")]
    known = F.lit(True)
    for n in names:
        known &= F.col(n).isNotNull() & ~F.col(n).cast("string").isin("", "NA")
    return markup.filter(known)


def build_counts(v: DataFrame, j: DataFrame, built: DataFrame, annotated: DataFrame) -> DataFrame:
    """By locus: V and J alleles, combinations, scaffolds, annotated and dropped ones."""
    one = lambda df, name: df.groupBy("locus").agg(F.count(F.lit(1)).alias(name))
    out = one(v, "n_v").join(one(j, "n_j"), "locus").join(one(built, "n_scaffolds"), "locus", "left").join(one(annotated, "n_annotated"), "locus", "left")
    n = F.coalesce("n_annotated", F.lit(0))
    return out.select("locus", "n_v", "n_j", (F.col("n_v") * F.col("n_j")).alias("n_combinations"), "n_scaffolds", n.alias("n_annotated"), (F.col("n_scaffolds") - n).alias("n_dropped"))


def aa_markup(markup: DataFrame) -> DataFrame:
    """Region coordinates of nt markup (coding from fwr1_start) as residues, with the residues."""
    origin = F.col("fwr1_start")
    protein = sq.translate(F.substring(F.col("sequence"), F.col("fwr1_start"), F.length("sequence")))
    out = markup.withColumn("protein", protein)
    columns = [c for r in sq.REGIONS for c in (
        sq.aa_coordinate(F.col(f"{r}_start"), origin).alias(f"{r}_start"),
        sq.aa_coordinate(F.col(f"{r}_end"), origin).alias(f"{r}_end"),
        sq.aa_slice(F.col("protein"), F.col(f"{r}_start"), F.col(f"{r}_end"), origin).alias(r),
    )]
    return out.select("scaffold_id", "locus", "v_call", "j_call", F.lit(1).alias("coding_start"), F.col("protein").alias("sequence"), *columns)
