"""What the corpus operators share: tables, shared scratch space, batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls 9 to 13, which is what bytes.split() splits at.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Python works through an Arrow batch in slices of about this many bytes of text.
SLICE_BYTES = 2 << 20
#: Most bytes of a batch that Spark hands to Python, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Keep the batches that go to Python small in bytes, so that a worker's memory is bounded for texts of any length;
    a size that the session has set itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a temporary one is made and set; on a cluster a
    folder of each machine's own would lose rows, so that is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        found = sc._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="spanloom-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: Tables that the running operator has stored: path to the session and whether its result reads them.
_MADE: ContextVar[dict[str, tuple[SparkSession, bool]] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a table of its own in the shared folder and read it back: this cuts its lineage, and what
    was computed outlives any executor. In a tidy() function `keep` marks tables that its result still reads."""
    spark = df.sparkSession
    lean(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made[path] = spark, keep
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spanloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Delete a stored() table that nothing reads any more."""
    path = getattr(df, "spanloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def tidy(f: Callable) -> Callable:
    """f, after which the tables that it stored are deleted, but for those stored with `keep`: they feed its result.
    Where f runs inside another tidy function, these go when that one ends."""

    @wraps(f)
    def run(*args, **options):
        own: dict[str, tuple[SparkSession, bool]] = {}
        token = _MADE.set(own)
        try:
            return f(*args, **options)
        finally:
            _MADE.reset(token)
            outer = _MADE.get()
            for path, (spark, keep) in own.items():
                if not keep:
                    _delete(spark, path)
                elif outer is not None:
                    outer[path] = spark, False

    return run


#: A key is hot if it holds over a HOT-th of all rows, so at most so many keys are.
HOT = 4096


def joined_apart(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows and table, joined on columns of equal names. counts: keys and n, how many rows have them; total: of all rows.
    The rows of hot keys meet theirs by broadcast, which is at most HOT rows of the table (keys are unique there) however
    large it is, so that no task gets them all; the others are shuffled. how: inner, or left to keep rows without."""
    hot = counts.filter(F.col("n") * HOT > F.lit(total)).select(*keys)
    hot = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(table, keys, how))


def prefix_sums(rows: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """rows with `nth` (0 for the first in the order) and before_X for each X of sums (its sum over the rows before),
    without a task that sees all rows: these are range-partitioned, and sums of whole partitions, which are few, are put
    before the sums within each."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place")), name, keep=True)
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    every = {"nth": F.lit(1), **{f"before_{c}": F.col(c) for c in sums}}
    parts = ranged.groupBy(F.col("_part").alias("_p")).agg(*(F.sum(c).alias(f"{n}_p") for n, c in every.items()))
    parts = parts.select("_p", *(F.coalesce(F.sum(f"{n}_p").over(upto), F.lit(0)).alias(f"{n}_p") for n in every))
    ranged = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in every.items()})
    out = ranged.join(F.broadcast(parts), F.col("_part") == F.col("_p"))  # a row for each partition
    return out.withColumns({n: F.col(n) + F.col(f"{n}_p") for n in every}).drop("_part", "_place", "_p", *(f"{n}_p" for n in every))


def text_key() -> Column:
    """With the doc_id it tells rows apart, but for those that repeat both id and text."""
    return F.xxhash64(F.col("text").cast("string"))


@tidy
def one_each(docs: DataFrame, gone: DataFrame, twins: DataFrame) -> DataFrame:
    """docs, with all their columns, without the rows whose doc_id and text_key() are in gone; of those in twins one row
    stays. gone, twins: id, text_key; both without repeats."""
    on = lambda t: F.col("_id").eqNullSafe(t["id"]) & (F.col("_text_key") == t["text_key"])
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_key().alias("_text_key"))
    rows = rows.join(gone, on(gone), "left_anti")
    if twins.head(1):
        some = rows.join(twins, on(twins), "left_semi").groupBy("_id", "_text_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        rows = rows.join(twins, on(twins), "left_anti").select("_row").unionByName(some.select("_row"))
    return rows.select("_row.*")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes of text, in order; one long text makes a piece of its own."""
    sizes = batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary())
    lengths = [0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()]
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over batches after which its worker, which Spark keeps for later tasks, does not hold on to freed buffers."""

    @wraps(run)
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return passed


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A stored() table, marked for broadcast only if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


class Bitmap:
    """Which keys may be in a set: a bit for each value of the first bits of a key, which must be random bytes."""

    def __init__(self, bits: int, data: object):
        self.bits, self.data = bits, data  # data: a broadcast of bytes

    def may_have(self, key: bytes) -> bool:
        slot = int.from_bytes(key[:4], "big") >> (32 - self.bits)
        return bool(self.data.value[slot >> 3] >> (slot & 7) & 1)


def key_bitmap(keys: DataFrame, column: str, most_bits: int = 28) -> Bitmap:
    """Of a binary column of random bytes. It has 16 bits a key, but never over 2 ** most_bits (32 MB), whatever
    the number of keys: then more keys pass that are not in the set, and a join on the key decides."""
    bits = min(most_bits, max(16, (16 * keys.count()).bit_length()))
    slot = F.shiftright(F.conv(F.hex(F.substring(column, 1, 4)), 16, 10).cast("long"), 32 - bits)
    rows = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect()
    data = bytearray(1 << (bits - 3))
    for row in rows:  # pages of 4 KB; bit positions count from 1
        data[row.page << 12 : (row.page << 12) + len(row.bits)] = row.bits
    return Bitmap(bits, keys.sparkSession.sparkContext.broadcast(bytes(data)))
