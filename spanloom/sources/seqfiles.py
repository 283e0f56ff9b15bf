"""FASTA and FASTQ files, plain or gzipped (by suffix), as DataFrames. Only Spark's readers open them.

Rows are read_id, sequence and rid, which grows in input order: by file name, then by place in the file. Plain files are
split at records, so one large file is read by many tasks and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq

_POSITION = F.monotonically_increasing_id
#: Tables are tab-separated without quoting: a quotation mark is a character like any other.
TSV = {"sep": "\t", "header": True, "quote": "\u0000", "escape": "\u0000"}
#: A rid is the rank of its file, then the byte where its split begins (of a file of up to 2 ** FILE_BITS bytes) plus its
#: number in the partition. Full splits have a partition of their own; what is packed together are last splits.
FILE_BITS = 42
_FORMS = {">": "fasta", "@": "fastq"}


def _mark(spark: SparkSession, path: str) -> str:
    """The first character that is not blank, or nothing."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return first[0].value.strip()[:1] if first else ""


def blank(spark: SparkSession, path: str) -> bool:
    return not _mark(spark, path)


def sniff(spark: SparkSession, path: str) -> str:
    """'fasta' or 'fastq' by the first character of a file that is not blank; a ValueError otherwise, or if there is none."""
    mark = _mark(spark, path)
    if mark not in _FORMS:
        raise ValueError(f"{path} is neither FASTA nor FASTQ" if mark else f"{path} is empty")
    return _FORMS[mark]


def _pieces(spark: SparkSession, path: str | list[str], start: str, files: list[str] | None = None) -> DataFrame:
    """Texts between line breaks that `start` follows, with file, block and rid. files: all, in order, for their ranks."""
    rows = spark.read.option("lineSep", f"\n{start}").text(path)
    ranks = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(map(_plain, files or rows.inputFiles()), key=unquote))], "of string, rank long")
    number = _POSITION().bitwiseAND((1 << 33) - 1)
    rows = rows.select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), F.col("_metadata.file_block_start").alias("block"), number.alias("number"))
    rows = rows.join(F.broadcast(ranks), F.col("file") == F.col("of"), "left")  # names that the driver has listed
    rank = F.coalesce("rank", F.raise_error(F.concat(F.lit("not listed: "), "file")).cast("long"))
    return rows.select("value", "file", (F.shiftleft(rank, FILE_BITS) + F.col("block") + F.col("number")).alias("rid"))


def _plain(name: str) -> str:
    return re.sub("^file:/+", "file:/", name)


def _path(name: str) -> str:
    """What Spark opens, from the name of a file as it lists it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(name))


def _heads(pieces: DataFrame) -> dict[str, tuple[int, str]]:
    """For each file that is not empty the rid of its first piece, and its first character that is not blank, if any. What
    comes after a blank first piece begins with the mark that pieces are parted at."""
    mark = F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1)
    first = pieces.groupBy("file").agg(F.min("rid").alias("rid"), F.min_by(mark, "rid").alias("mark"), F.count(F.lit(1)).alias("n"))
    return {r.file: (r.rid, r.mark or (">" if r.n > 1 else "")) for r in first.collect()}  # a row for each file


def _marks(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """For each file with text its first character that is not blank. Files are read by lines: a file has no piece smaller
    than itself where the mark that pieces are parted at is not in it."""
    line = F.regexp_replace("value", r"^\s+", "")
    rows = spark.read.text(path).select(F.substring(line, 1, 1).alias("mark"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), _POSITION().alias("at"))
    first = rows.filter("mark <> ''").groupBy("file").agg(F.min_by("mark", F.struct("block", "at")).alias("mark"))
    return {_plain(r.file): r.mark for r in first.collect()}  # a row for each file


def _fasta(pieces: DataFrame, heads: dict[str, tuple[int, str]], full_header: bool) -> DataFrame:
    # The first record of a file still has its mark; a first piece without one is text before any record.
    first = pieces.sparkSession.createDataFrame([(r,) for r, _ in heads.values()], "first long")
    rows = pieces.join(F.broadcast(first), F.col("rid") == F.col("first"), "left")
    body = F.regexp_replace("value", r"^\s*>", "")
    record = F.when(F.col("first").isNull(), F.col("value")).when(F.col("value").rlike(r"^\s*>"), body)
    rows = rows.select("rid", record.alias("record")).filter("record is not null")
    header = F.regexp_extract("record", r"^[^\r\n]*", 0)
    sequence = F.regexp_replace(F.regexp_replace("record", r"^[^\r\n]*", ""), r"\s+", "")
    name = F.trim(header) if full_header else F.regexp_extract(header, r"^\s*(\S*)", 1)
    return rows.select("rid", name.alias("read_id"), sequence.alias("sequence"))


def _fastq(pieces: DataFrame) -> DataFrame:
    # What follows a line break and @ is a record if a line with + comes after its sequence; else it is a piece of a
    # quality line that begins with @, which has no line break.
    record = F.regexp_replace("value", r"^\s*@+", "")
    line = lambda k: F.regexp_extract(record, r"^([^\n]*)\n([^\n]*)\n\+", k)
    rows = pieces.filter(F.col("value").rlike(r"^\s*[^\n]*\n[^\n]*\n\+"))
    return rows.select("rid", F.regexp_extract(line(1), r"^\s*(\S*)", 1).alias("read_id"), F.regexp_replace(line(2), r"^\s+|\s+$", "").alias("sequence"))


def read_fasta(spark: SparkSession, path: str | list[str], full_header: bool = False) -> DataFrame:
    """Ids are the first word of a header, or all of it; sequence lines are joined, blank ones skipped, and what
    comes before the first header is left out."""
    pieces = _pieces(spark, path, ">")
    return _fasta(pieces, _heads(pieces), full_header)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of four lines. Quality is not kept; lines that belong to no record are left out, and leading @ signs are no
    part of an id."""
    return _fastq(_pieces(spark, path, "@"))


def read_sequences(spark: SparkSession, path: str, form: str = "auto") -> DataFrame:
    """Of a folder each file by its own first character, with rids in the order of all files. Files without text are left
    out; a ValueError names those that are of neither kind, or the path if there is nothing else."""
    if form != "auto":
        readers = {"fasta": read_fasta, "fastq": read_fastq}
        if form not in readers:
            raise ValueError(f"unknown format {form}")
        return readers[form](spark, path)
    marks = _marks(spark, path)
    if bad := sorted(f for f, mark in marks.items() if mark not in _FORMS):
        raise ValueError(f"neither FASTA nor FASTQ: {', '.join(bad[:10])}")
    if not marks:
        raise ValueError(f"{path} is empty")
    files = spark.read.text(path).inputFiles()
    of = {form: [f for f in files if _FORMS.get(marks.get(_plain(f))) == form] for form in ("fasta", "fastq")}
    some = lambda form: [*map(_path, of[form])]
    parts = []
    if of["fasta"]:
        own = _pieces(spark, some("fasta"), ">", files)
        parts.append(_fasta(own, _heads(own), False))
    if of["fastq"]:
        parts.append(_fastq(_pieces(spark, some("fastq"), "@", files)))
    return reduce(DataFrame.unionByName, parts)


def from_sequences(spark: SparkSession, sequences: Iterable) -> DataFrame:
    """Strings, which get the ids seq0, seq1, ..., or pairs of id and sequence."""
    rows = [(i, f"seq{i}", x) if isinstance(x, str) else (i, str(x[0]), str(x[1])) for i, x in enumerate(sequences)]
    return spark.createDataFrame(rows, "rid long, read_id string, sequence string")


def from_table(df: DataFrame, read_id: Column, sequence: Column) -> DataFrame:
    return df.select(_POSITION().alias("rid"), read_id.cast("string").alias("read_id"), sequence.cast("string").alias("sequence"))


# Hits of another aligner

#: Columns of a table of hits, in order; fixed values.
HIT = ("query", "target", "qstart", "qend", "tstart", "tend", "qlen", "tlen", "alnlen", "mismatch", "gapopen", "cigar", "qaln", "taln", "evalue", "bits", "pident")
_NUMBERS = {"evalue": "double", "bits": "double", "pident": "double", **dict.fromkeys(("qstart", "qend", "tstart", "tend", "qlen", "tlen", "alnlen", "mismatch", "gapopen"), "int")}


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """HIT from tab-separated files without a header; numbers that cannot be read are null, an empty file has no hits."""
    rows = spark.read.csv(path, **{**TSV, "header": False}, schema=", ".join(f"{c} string" for c in HIT))
    return rows.select(*(F.col(c).try_cast(_NUMBERS[c]).alias(c) if c in _NUMBERS else F.col(c) for c in HIT))


# Reference tables


def lenient(text: Column) -> Column:
    """A whole number, or 0 for what cannot be read as one."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """Scaffold markup from a TSV file with a header; numbers that cannot be read, and missing V and J bounds, are 0."""
    rows = spark.read.csv(path, **TSV)
    number = lambda c: lenient(F.col(c)) if c in rows.columns else F.lit(0)
    text = [c for c in ("scaffold_id", "locus", "v_call", "j_call", "productive", "junction", "junction_aa", "sequence") if c in rows.columns]
    ends = [number(c).alias(c) for c in ("v_sequence_end", "j_sequence_start")]
    return rows.select(*text, *ends, *(number(f"{r}_{x}").alias(f"{r}_{x}") for r in sq.REGIONS for x in ("start", "end")))


def read_d_germlines(spark: SparkSession, path: str) -> DataFrame:
    """locus, allele, sequence from headers locus|allele; those without an allele or a sequence are left out."""
    rows = read_fasta(spark, path, full_header=True)
    parts = F.split("read_id", r"\|", 2)
    return rows.select(parts[0].alias("locus"), F.get(parts, F.lit(1)).alias("allele"), F.upper("sequence").alias("sequence")).filter("allele <> '' and sequence <> ''")


def read_j_frames(spark: SparkSession, path: str) -> DataFrame:
    """allele, frame from lines of words; comments, blank lines and lines without a number second are left out."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.trim("value").rlike(r"^(#|$)")).select(words[0].alias("allele"), F.get(words, F.lit(1)).try_cast("int").alias("frame"))
    return rows.filter("frame is not null")


def read_functionality(spark: SparkSession, path: str) -> DataFrame:
    """allele, functionality from the second and fourth fields of FASTA headers: the code before a slash, without
    brackets. Shorter headers are left out."""
    fields = F.split("read_id", r"\|")
    code = F.substring_index(F.trim(F.regexp_replace(F.get(fields, F.lit(3)), r"[()\[\]]", "")), "/", 1)
    rows = read_fasta(spark, path, full_header=True).filter(F.size(fields) >= 4)
    return rows.select(fields[1].alias("allele"), F.substring_index(code, " ", 1).alias("functionality"), "sequence")


def read_airr(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An AIRR table, all strings; of the columns asked for, those that it has."""
    rows = spark.read.csv(path, **TSV)
    return rows.select(*(c for c in columns if c in rows.columns)) if columns else rows
