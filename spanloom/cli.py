"""Command line: python -m spanloom.cli COMMAND, or through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from spanloom.operators import aligner, germline, substitution
from spanloom.plans import annotate
from spanloom.session import session
from spanloom.sources import locate, seqfiles, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description="Annotate receptor sequences on Spark.")
    top.add_argument("--master", default="local[*]")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("info", help="loci and their properties")
    c = commands.add_parser("annotate", help="reads to an AIRR table")
    c.add_argument("input")
    c.add_argument("output")
    where = c.add_mutually_exclusive_group(required=True)
    where.add_argument("--reference", help="a reference folder")
    where.add_argument("--organism", help="its reference in the folder that the setting spark.spanloom.references names")
    c.add_argument("--sensitivity", choices=("fast", "normal", "exact"), default="normal")
    c.add_argument("--seqtype", choices=("nt", "aa"), default="nt")
    c.add_argument("--scores", help="amino acids: a file with a square table of scores")
    c.add_argument("--forward-only", action="store_true")
    c.add_argument("--no-d", action="store_true")
    c = commands.add_parser("build-db", help="germline FASTA and region tables to a reference folder")
    for name in ("v", "j", "v_regions", "j_regions", "output"):
        c.add_argument(name)
    c.add_argument("--d")
    c.add_argument("--frames", help="J frames: lines of allele and frame")
    c = commands.add_parser("build-germline", help="gapped V and plain J germlines, headers locus|allele, to a reference folder")
    for name in ("v", "j", "output"):
        c.add_argument(name)
    c.add_argument("--d")
    c = commands.add_parser("build-index", help="reference folders ready for search")
    c.add_argument("folders", nargs="+")
    c.add_argument("--force", action="store_true")
    c = commands.add_parser("split", help="reads to FASTA shards")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-n", type=int, required=True)
    c = commands.add_parser("merge", help="tables to one")
    c.add_argument("pattern")
    c.add_argument("output")
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = session(a.master)
    if a.command == "info":
        germline.loci(spark).show()
    elif a.command == "annotate":
        options = annotate.Options(a.seqtype, both_strands=not a.forward_only, map_d=not a.no_d, sensitivity=a.sensitivity)
        if a.scores:
            lines = [r.value for r in spark.read.text(a.scores).collect()]  # a row for each residue
            options.scoring = aligner.Scoring.aa(substitution.parsed(lines))
        folder = a.reference or locate.reference_folder(spark, a.organism)
        annotate.annotate_path(spark, a.input, a.output, annotate.Reference.load(spark, folder, a.seqtype), options)
    elif a.command == "build-germline":
        alleles = lambda path: seqfiles.read_d_germlines(spark, path)
        reference, built = annotate.germline_reference(alleles(a.v), alleles(a.j), alleles(a.d) if a.d else None)
        annotate.write_reference(reference, a.output, built)
    elif a.command == "build-db":
        alleles = lambda path: seqfiles.read_d_germlines(spark, path)  # noqa: E731  headers locus|allele
        regions = lambda path: spark.read.csv(path, sep="\t", header=True, inferSchema=False)
        v_regions = regions(a.v_regions)
        v_regions = v_regions.select("allele", *(F.col(c).cast("int").alias(c) for c in v_regions.columns if c != "allele"))
        j_regions = regions(a.j_regions).select("allele", F.col("fwr4_offset").cast("int").alias("fwr4_offset"))
        v, j, frames = alleles(a.v), alleles(a.j), seqfiles.read_j_frames(spark, a.frames) if a.frames else None
        reference = annotate.build_reference(v, j, v_regions, j_regions, frames, alleles(a.d) if a.d else None)
        annotate.write_reference(reference, a.output, germline.scaffolds(v, j, frames))
        annotate.write_reference(annotate.protein_reference(reference), a.output)
    elif a.command == "build-index":
        for folder, seqtype in annotate.build_index(spark, a.folders, a.force):
            print(folder, seqtype)
    elif a.command == "split":
        sinks.split(seqfiles.read_sequences(spark, a.input), a.n, a.output)
    else:
        sinks.merge(spark, a.pattern, a.output)


if __name__ == "__main__":
    main()
