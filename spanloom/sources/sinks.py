"""Tables written as AIRR TSV and FASTA, in shards, and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.session import materialised, small
from spanloom.sources.seqfiles import TSV


def python_float(value: Column) -> Column:
    """A double as Python prints it: 1e-30, not 1.0E-30."""
    text = value.cast("string")
    mantissa, exponent = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    short = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    long = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")
    return F.when(~F.contains(text, F.lit("E")), text).when((exponent < -4) | (exponent >= 16), short).otherwise(long)


def rendered(df: DataFrame) -> DataFrame:
    """All columns as strings, null as empty, flags as T and F."""
    kinds = dict(df.dtypes)
    show = lambda c: F.when(F.col(c), "T").when(~F.col(c), "F") if kinds[c] == "boolean" else python_float(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")
    return df.select(*(F.coalesce(show(c), F.lit("")).alias(c) for c in df.columns))


def write_airr(df: DataFrame, path: str, files: int | None = None) -> None:
    """TSV with a header, columns in the order of df; no rows give the header only."""
    rows = rendered(df)
    rows = rows.coalesce(files) if files else rows
    rows.write.mode("overwrite").csv(path, emptyValue="", nullValue="", **TSV)


def airr_lines(df: DataFrame) -> DataFrame:
    """Rows as lines."""
    return rendered(df).select(F.concat_ws("\t", *df.columns).alias("line"))


def write_fasta(df: DataFrame, path: str, name: str = "read_id", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence))).write.mode("overwrite").text(path)


def numbered(df: DataFrame, order: str = "rid", number: str = "number") -> DataFrame:
    """df with the place of each row in the order of a column, from 0. Rows are sorted over partitions; counts of
    whole partitions, and a row's place in its own, give its number, so no task sees all rows."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    rows = materialised(rows, "numbered")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(small(parts), F.col("_part") == F.col("_p")).withColumn(number, F.col("_base") + F.col("_place")).drop("_part", "_place", "_p", "_base")


def sharded(df: DataFrame, n: int, order: str = "rid") -> DataFrame:
    """df with a shard: its number modulo n, so shards differ by one row at most."""
    if n < 1:
        raise ValueError("a split needs at least one shard")
    return numbered(df, order).withColumn("shard", (F.col("number") % n).cast("int")).drop("number")


def split(df: DataFrame, n: int, path: str, order: str = "rid") -> None:
    """FASTA shards in folders shard=0 to shard=n-1."""
    rows = sharded(df, n, order).select("shard", F.concat(F.lit(">"), F.col("read_id"), F.lit("\n"), F.col("sequence")).alias("value"))
    rows.repartition(n, "shard").write.mode("overwrite").partitionBy("shard").text(path)


def merged(spark: SparkSession, pattern: str) -> DataFrame:
    """All rows of the TSV files that match a pattern, as strings, with `_file` and `_at` for their order: by the names of
    files, then as they stand. No file is a FileNotFoundError."""
    try:
        rows = spark.read.csv(pattern, **TSV)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(pattern) from error
        raise
    if not rows.columns:
        raise FileNotFoundError(pattern)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))


def merge(spark: SparkSession, pattern: str, path: str, files: int | None = None) -> None:
    """merged() as one table: part files in order, written side by side, each with the header; with files=1 one file."""
    rows = merged(spark, pattern)
    rows = rows.repartitionByRange(*([files] if files else []), "_file", "_at").sortWithinPartitions("_file", "_at").drop("_file", "_at").na.fill("")
    rows.write.mode("overwrite").csv(path, emptyValue="", nullValue="", **TSV)
