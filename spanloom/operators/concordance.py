"""How far two annotated tables agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq

#: Regions whose ends depend on the tool, compared by containment.
OPEN_REGIONS = ("fwr1", "cdr3")


def _paired(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    names = [c for c in theirs.columns if c != "sequence_id"]
    return ours.alias("o").join(theirs.select("sequence_id", *(F.col(c).alias(f"their_{c}") for c in names)), "sequence_id")


def _usable(x: Column) -> Column:
    return F.coalesce((x != "") & ~F.contains(x, F.lit("*")), F.lit(False))


def regions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """region, compared, agree over the residues of the first six regions; one read as '' or with * is not compared."""
    rows = _paired(ours, theirs)
    out = []
    for r in sq.REGIONS[:6]:
        a, b = F.col(f"{r}_aa"), F.col(f"their_{r}_aa")
        same = (F.contains(a, b) | F.contains(b, a)) if r in OPEN_REGIONS else a == b
        both = _usable(a) & _usable(b)
        out.append(F.struct(F.lit(r).alias("region"), both.alias("both"), (both & same).alias("same")))
    rows = rows.select(F.explode(F.array(*out)).alias("x")).select("x.*")
    return rows.groupBy("region").agg(F.count(F.when(F.col("both"), 1)).alias("compared"), F.count(F.when(F.col("same"), 1)).alias("agree"))


def junctions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """compared, junction_agree, cdr3_agree over reads that the other table calls productive with a canonical junction."""
    rows = _paired(ours, theirs).filter(F.col("their_productive") & sq.canonical_junction(F.col("their_junction_aa")) & (F.coalesce("junction_aa", F.lit("")) != ""))
    cdr3 = lambda x: F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0)))
    return rows.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count(F.when(F.col("junction_aa") == F.col("their_junction_aa"), 1)).alias("junction_agree"),
        F.count(F.when(cdr3(F.col("junction_aa")) == cdr3(F.col("their_junction_aa")), 1)).alias("cdr3_agree"),
    )


def d_calls(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """grp (clean for TRB and TRD, igh), compared, agree on the D gene where both call one."""
    rows = _paired(ours, theirs)
    grp = F.when(F.col("locus").isin("TRB", "TRD"), "clean").when(F.col("locus") == "IGH", "igh")
    rows = rows.withColumn("grp", grp).filter("grp is not null and coalesce(d_call, '') <> '' and coalesce(their_d_call, '') <> ''")
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(sq.gene_of_call(F.col("d_call")) == sq.gene_of_call(F.col("their_d_call")), 1)).alias("agree"))


def annotated(table: DataFrame) -> DataFrame:
    """How many reads an annotated table has, and how many of them got a V call."""
    return table.agg(F.count(F.lit(1)).alias("n_reads"), F.count("v_call").alias("n_annotated"))
