"""References from germlines, of annotators, and as tables; reads of known origin."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq
from spanloom.operators import germline, mutation
from spanloom.plans import annotate

r = random.Random(31)
CODONS = [c for c, a in sq.codon_table().items() if a not in "*CFGW"]
coding = lambda n: "".join(r.choice(CODONS) for _ in range(n))
V = coding(25) + "TGT" + coding(70) + "TGT" + "GCG"  # columns 23 and 104 of 26, 12, 17, 10 and 39 hold cysteines
V = V[:66] + "TGT" + V[69:]
J = "AC" + coding(3) + "TTCGGAGCAGGG" + coding(7)


def germlines(spark):
    gapped = coding(26) + coding(8) + "." * 12 + coding(17) + coding(7) + "." * 9 + coding(38) + "TGT" + "GCGAGA"
    v = spark.createDataFrame([("IGH", "IGHV1*01", gapped), ("IGK", "IGKV1*01", coding(104))], "locus string, allele string, sequence string")
    j = spark.createDataFrame([("IGH", "IGHJ1*01", J), ("IGK", "IGKJ1*01", coding(12)), ("IGK", "IGKJ2*01", J[:5] + J)], "locus string, allele string, sequence string")
    return gapped, v, j


def test_reference_of_germlines_alone(spark, tmp_path):
    gapped, v, j = germlines(spark)
    bounds = germline.v_regions(v).filter("allele = 'IGHV1*01'").first()
    assert [(bounds[f"{x}_start"], bounds[f"{x}_end"]) for x in sq.REGIONS[:5]] == [(1, 78), (79, 102), (103, 153), (154, 174), (175, 291)]
    short = germline.v_regions(spark.createDataFrame([("x", "ACG" * 20), ("y", "")], "allele string, sequence string")).orderBy("allele").collect()
    assert (short[0].fwr1_start, short[0].fwr1_end, short[0].cdr1_start, short[0].fwr3_end) == (1, 60, 0, 0) and short[1].fwr1_start == 0
    anchors = {x.allele: (x.frame, x.fwr4_offset) for x in germline.j_anchors(j).collect()}
    assert anchors["IGHJ1*01"] == (2, 12) and set(anchors) == {"IGHJ1*01", "IGKJ2*01"}
    reference, built = annotate.germline_reference(v, j)
    whole = gapped.replace(".", "")
    read = whole + "GATTAC" + J
    (row,) = annotate.annotate_sequences(spark, [("r", read)], reference)
    assert row["v_call"] == "IGHV1*01" and row["fwr1"] == whole[:78] and row["cdr2"] == whole[153:174] and row["fwr3"] == whole[174:291] and row["fwr4"] == J[11:]
    # The same through files and the command line.
    from spanloom import cli
    from spanloom.sources import seqfiles

    fasta = lambda name, df: (tmp_path / name).write_text("".join(f">{x.locus}|{x.allele}\n{x.sequence}\n" for x in df.collect())) and str(tmp_path / name)
    cli.main(["build-germline", fasta("v.fa", v), fasta("j.fa", j), str(tmp_path / "ref")])
    assert annotate.annotate_sequences(spark, [("r", read)], annotate.Reference.load(spark, str(tmp_path / "ref"))) == [row]
    log = {x.locus: (x.n_scaffolds, x.n_dropped) for x in seqfiles.read_airr(spark, str(tmp_path / "ref/build_log.tsv")).collect()}
    assert log["IGH"] == ("1", "0") and built.count() == sum(int(n) for n, _ in log.values())


def test_reference_of_an_annotator(spark):
    _, v, j = germlines(spark)
    built = germline.scaffolds(v.withColumn("sequence", F.replace("sequence", F.lit("."), F.lit(""))), j)
    ids = sorted(x.scaffold_id for x in built.collect())
    names = [f"{x}_{n}" for x in sq.REGIONS for n in ("start", "end")]
    line = lambda i, value="7": (i, *(value if n == "fwr4_end" else str(k + 1) for k, n in enumerate(names)))
    records = spark.createDataFrame([line(ids[0]), line(ids[0]), line(ids[1], ""), line(ids[2], "NA"), line("other")], ", ".join(f"{n} string" for n in ("sequence_id", *names)))
    reference, counts = annotate.annotated_reference(built, records)
    assert [(x.scaffold_id, x.starts[0], x.ends[-1]) for x in reference.scaffolds.collect()] == [(ids[0], 1, 7)]
    assert sum(x.n_dropped for x in counts.collect()) == len(ids) - 1
    assert annotate.annotated_reference(built, records.drop("fwr4_end"))[0].scaffolds.count() == 0


def test_tables_by_organism_and_locus(spark, tmp_path):
    _, v, j = germlines(spark)
    root = str(tmp_path / "tables")
    reference, _ = annotate.germline_reference(v, j)
    n = reference.ready().scaffolds.count()
    for organism in ("human", "rat", "human"):
        annotate.write_tables(reference, root, organism)
    assert annotate.read_tables(spark, root, "human").scaffolds.count() == n and spark.read.parquet(root).count() == 2 * n
    only = annotate.read_tables(spark, root, "rat", ["IGK"]).scaffolds
    plan = only._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "organism" in filters and "locus" in filters and {x.locus for x in only.collect()} == {"IGK"}
    annotate.write_tables(annotate.Reference(reference.scaffolds.filter("locus = 'IGH'")), root, "rat")
    assert spark.read.parquet(root).count() == 2 * n  # the other locus of rat stays


def test_reads_of_known_origin(spark):
    rows = spark.range(3000).withColumn("s", F.lit("ACGT" * 30 + "N"))
    k, s = F.col("id"), F.col("s")
    made = lambda df: sorted(map(tuple, df.select("id", mutation.replaced(s, k, 0.2), mutation.codon_shift(s, k), mutation.window(s, k, 60), mutation.random_read(k, 70)).collect()))
    got = made(rows)
    assert got == made(rows.repartition(7))
    changed = [sum(a != b for a, b in zip(x[1], "ACGT" * 30 + "N")) for x in got]
    assert all(len(x[1]) == 121 and x[1][-1] == "N" and set(x[1]) <= set("ACGTN") for x in got) and 0.19 < sum(changed) / (3000 * 120) < 0.21
    assert {len(x[2]) for x in got} == {118, 124} and 0.4 < sum(len(x[2]) == 118 for x in got) / 3000 < 0.6
    assert {len(x[3]) for x in got} == {60} and len({x[3] for x in got}) == 5 and len({x[4] for x in got}) == 3000 and {len(x[4]) for x in got} == {70}
    short = spark.createDataFrame([(1, ""), (2, "A"), (3, None)], "id long, s string")
    assert [(x[1], x[3]) for x in made(short)][:2] == [("", ""), ("A", "A")] or pytest.fail(str(made(short)))
