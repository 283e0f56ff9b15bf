"""Annotation of files as they arrive. Each read stands alone, so the query keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.plans.annotate import Options, Reference, annotate
from spanloom.plans.records import COLUMNS
from spanloom.session import materialised
from spanloom.sources import seqfiles, sinks


def file_stream(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """The files of a folder, some at a time: their path only, so that none is read here."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return rows.option("maxFilesPerTrigger", files).load(folder).select("path")


def annotate_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, reference: Reference, options: Options | None = None, files: int = 16) -> StreamingQuery:
    """The FASTA and FASTQ files that the folder holds now, plain or gzipped, as an AIRR table by micro-batches; a later
    start goes on with new files. The stream is one of file names; each micro-batch reads its files as annotate_path does,
    so that what a file holds is read alike by both, and writes a folder of its own, anew if the batch has to be repeated.
    A file that cannot be read fails the query; one without any character but blanks has no reads."""

    def run(batch: DataFrame, number: int) -> None:
        paths = sorted(r.path for r in batch.select("path").distinct().collect())  # at most `files`
        reads = [seqfiles.read_sequences(spark, p) for p in paths if not seqfiles.blank(spark, p)]
        if reads:
            every = reads[0]
            for more in reads[1:]:
                every = every.unionByName(more)
            every = materialised(every.withColumn("rid", F.monotonically_increasing_id()), "stream-reads")
            sinks.write_airr(annotate(every, reference, options).select(*COLUMNS), f"{target}/batch-{number}")

    return file_stream(spark, folder, files).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
