"""Similarity join by k-mer seeds, in DataFrame operations: postings, diagonals, best targets.

k-mers of both sides are joined on equality; what they share is grouped by diagonal, and a query's best target is
the one with the most seeds on a diagonal. Only seed rows move, keyed by k-mer, then by query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from spanloom.operators.aligner import LETTERS, Scoring, packed_seeds
from spanloom.session import materialised, small, spread

#: Postings of the targets up to which they are broadcast to the queries' k-mers; beyond it the join is shuffled.
BROADCAST_POSTINGS = 2_000_000
#: Different seeds of the targets up to which only those of the queries are made that targets have; numbers of seeds that a
#: pattern may have for that.
KNOWN_SEEDS, SEED_NUMBERS = 100_000, 1 << 26
#: Residues of queries whose seeds are numbered at once.
SLICE = 1 << 20


def postings(rows: DataFrame, key: str, sequence: str, k: int) -> DataFrame:
    """key, pos (1-based), kmer, for sequences of at least k characters."""
    rows = rows.filter(F.length(sequence) >= k)
    return rows.select(key, F.explode(F.sequence(F.lit(1), F.length(sequence) - k + 1)).alias("pos"), sequence).select(key, "pos", F.substring(F.col(sequence), F.col("pos"), F.lit(k)).alias("kmer"))


def seeds(queries: DataFrame, targets: DataFrame, k: int, letters: str | None = None) -> DataFrame:
    """queries: query, sequence; targets: target, sequence. Rows of query, target, diagonal (target minus query
    position) and n, how many k-mers they share on it; with `letters`, only k-mers of these.

    Few postings are broadcast, so that the queries' k-mers, which are many, stay where they are and are counted there
    before anything moves."""
    q = postings(spread(queries.select("query", "sequence")), "query", "sequence", k)
    if letters is not None:
        q = q.filter(F.col("kmer").rlike(f"^[{letters}]+$"))
    t = postings(targets, "target", "sequence", k).select("target", F.col("pos").alias("t_pos"), F.col("kmer").alias("t_kmer"))
    if letters is not None:
        t = t.filter(F.col("t_kmer").rlike(f"^[{letters}]+$"))
    pairs = q.join(small(materialised(t, "postings"), BROADCAST_POSTINGS), F.col("kmer") == F.col("t_kmer"))
    return pairs.groupBy("query", "target", (F.col("t_pos") - F.col("pos")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"))


def top(found: DataFrame, most: int) -> DataFrame:
    """For each query the `most` targets with the most seeds on one diagonal; ties go to the smaller target."""
    one = found.groupBy("query", "target").agg(F.max(F.struct("n", F.col("diagonal").alias("diagonal"))).alias("best"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("best.n"), F.asc("target")))
    return one.withColumn("rank", rank).filter(F.col("rank") <= most).select("query", "target", "best.n", "best.diagonal", "rank")


def spaced(rows: DataFrame, key: str, patterns: tuple[str, ...], letters: str) -> DataFrame:
    """key, pos (1-based) and seed, the pattern's number and the letters at its places, for each pattern and place."""
    which = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(len(p)).alias("span")) for i, p in enumerate(patterns))))
    rows = rows.select(key, "sequence", which.alias("p")).filter(F.length("sequence") >= F.col("p.span"))
    rows = rows.select(key, "sequence", "p.i", F.explode(F.sequence(F.lit(1), F.length("sequence") - F.col("p.span") + 1)).alias("pos"))
    seed = F.lit(None)
    for i, p in enumerate(patterns):
        runs = [F.substring(F.col("sequence"), F.col("pos") + m.start(), F.lit(len(m[0]))) for m in re.finditer("1+", p)]
        seed = F.when(F.col("i") == i, F.concat(F.lit(str(i)), *runs)).otherwise(seed)
    return rows.select(key, "pos", seed.alias("seed")).filter(F.col("seed").rlike(f"^[0-9]+[{letters}]+$"))


def known(rows: DataFrame, key: str, patterns: tuple[str, ...], letters: str, seeds: list[str]) -> DataFrame:
    """The rows of spaced() whose seed is one of `seeds`. Seeds are numbers here, and most are ruled out before they are
    rows: a table says for each number whether it is wanted."""
    span = max(map(len, patterns))
    code = {c: i for i, c in enumerate(letters)}
    table = np.full(256, len(letters), np.uint8)
    table[[*map(ord, letters)]] = range(len(letters))
    wanted = []
    for i, p in enumerate(patterns):
        names = [x for x in seeds if x.startswith(str(i)) and len(x) == len(str(i)) + p.count("1")]
        value = [sum(code[c] * len(letters) ** k for k, c in enumerate(reversed(x[len(str(i)) :]))) for x in names]
        order = sorted(range(len(names)), key=value.__getitem__)
        wanted.append((p, [names[k] for k in order], np.array([value[k] for k in order], np.int64)))
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    schema = StructType([rows.schema[key], StructField("pos", IntegerType()), StructField("seed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for p, names, value in shared.value:
            has = np.zeros(len(letters) ** p.count("1"), bool)
            has[value] = True
            held.append((p, pa.array(names, pa.string()), value, has))
        for batch in batches:
            texts = batch.column("sequence").to_pylist()
            parts = ((k, x[a : a + SLICE + span - 1], a) for k, x in enumerate(texts) for a in range(0, len(x or ""), SLICE))
            for some in _bounded(parts):
                owner, pieces, begin = zip(*some)
                sizes = np.array([len(x) for x in pieces], np.int64) + span
                start = np.cumsum(sizes) - sizes
                flat = table[np.frombuffer(("\n" * span).join([*pieces, ""]).encode("ascii", "replace"), np.uint8)]  # no seed reaches over a gap
                for p, names, value, has in held:
                    at, number = packed_seeds(flat, p, len(letters))
                    mine = has[number]
                    at, number = at[mine], number[mine]
                    piece = np.searchsorted(start, at, "right") - 1
                    at -= start[piece]
                    mine = at < SLICE  # what begins later is the next piece's
                    piece, at, number = piece[mine], at[mine], number[mine]
                    pos = (at + np.array(begin, np.int64)[piece] + 1).astype(np.int32)
                    row = batch.column(key).take(pa.array(np.array(owner, np.int64)[piece]))
                    yield pa.RecordBatch.from_arrays([row, pa.array(pos), names.take(pa.array(np.searchsorted(value, number)))], [key, "pos", "seed"])

    return rows.select(key, "sequence").mapInArrow(run, schema)


def _bounded(parts: Iterator[tuple[int, str, int]]) -> Iterator[list[tuple[int, str, int]]]:
    """Pieces of texts in lists of some SLICE residues."""
    held, size = [], 0
    for x in parts:
        held.append(x)
        size += len(x[1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _few(kept: DataFrame, scoring: Scoring) -> list[str] | None:
    """The different seeds of postings, if they are few."""
    if any(len(LETTERS[scoring.alphabet]) ** p.count("1") > SEED_NUMBERS for p in scoring.seeds):
        return None
    found = kept.select("t_seed").filter("t_seed IS NOT NULL").distinct().limit(KNOWN_SEEDS + 1).collect()
    return [r.t_seed for r in found] if len(found) <= KNOWN_SEEDS else None


def write_postings(targets: DataFrame, patterns: tuple[str, ...], letters: str, path: str, buckets: int) -> None:
    """targets: target, sequence. Their seeds as Parquet files in buckets by seed, each sorted by it."""
    rows = spaced(targets, "target", patterns, letters).select("target", F.col("pos").alias("t_pos"), F.col("seed").alias("t_seed"))
    name = _table(path)
    rows.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = rows.repartition(buckets, "t_seed")  # a file for each bucket
    dealt.write.format("parquet").bucketBy(buckets, "t_seed").sortBy("t_seed").option("path", path).mode("overwrite").saveAsTable(name)


def read_postings(spark: SparkSession, path: str, target: str, buckets: int) -> DataFrame:
    """What write_postings has written, in any session: a join by t_seed leaves it where it is. target: the type of names."""
    name, place = _table(path), path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (target {target}, t_pos INT, t_seed STRING) USING parquet CLUSTERED BY (t_seed) SORTED BY (t_seed) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _table(path: str) -> str:
    return f"spanloom_postings_{hashlib.md5(path.encode()).hexdigest()}"


def shared_seeds(queries: DataFrame, targets: DataFrame | None, scoring: Scoring, kept: DataFrame | None = None) -> DataFrame:
    """queries: query, sequence; targets: target, sequence, or kept: their postings as read_postings() has them. Rows of
    query, pos, target and t_pos, one for each seed that they share."""
    letters, rows = LETTERS[scoring.alphabet], spread(queries.select("query", "sequence"))
    if kept is None:
        t = spaced(targets, "target", scoring.seeds, letters).select("target", F.col("pos").alias("t_pos"), F.col("seed").alias("t_seed"))
        kept = small(materialised(t, "postings"), BROADCAST_POSTINGS)
    if scoring.similar is not None:
        q = spaced(rows, "query", scoring.seeds, letters)
        word, other = scoring.words()
        name = lambda x: "".join(letters[x // len(letters) ** i % len(letters)] for i in range(scoring.seeds[0].count("1") - 1, -1, -1))
        pairs = [(f"{i}{name(a)}", f"{i}{name(b)}") for i in range(len(scoring.seeds)) for a, b in zip(word.tolist(), other.tolist())]
        like = q.sparkSession.createDataFrame(pairs, "seed string, similar string")  # words of three residues
        q = q.join(F.broadcast(like), "seed").select("query", "pos", F.col("similar").alias("seed"))
    else:
        few = _few(kept, scoring)
        q = spaced(rows, "query", scoring.seeds, letters) if few is None else known(rows, "query", scoring.seeds, letters, few)
    return q.join(kept, F.col("seed") == F.col("t_seed")).select("query", "pos", "target", "t_pos")


def spaced_cells(queries: DataFrame, targets: DataFrame | None, scoring: Scoring, band: int, kept: DataFrame | None = None) -> DataFrame:
    """As shared_seeds(), by query, target and band of diagonals: n, how many seeds they share in it, and the lowest and
    highest of their diagonals there (target minus query position)."""
    diagonal = F.col("t_pos") - F.col("pos")
    cell = F.floor(diagonal / band).alias("band")
    found = shared_seeds(queries, targets, scoring, kept)
    return found.groupBy("query", "target", cell).agg(F.count(F.lit(1)).alias("n"), F.min(diagonal).alias("low"), F.max(diagonal).alias("high"))


def densest(cells: DataFrame, most: int, least: int) -> DataFrame:
    """query, target, n, low, high: how many seeds each query and target share in the densest band of diagonals (the
    first of equals) and the two on either side of it, and the lowest and highest diagonal of these. For each query the
    `most` targets with the most, if `least` at least, and all that tie with the last of them."""
    dense = F.max_by("band", F.struct(F.col("n"), -F.col("band"))).alias("dense")
    rows = cells.groupBy("query", "target").agg(dense, F.collect_list(F.struct("band", "n", "low", "high")).alias("cells"))
    near = F.filter("cells", lambda c: F.abs(c["band"] - F.col("dense")) <= 2)
    rows = rows.select("query", "target", near.alias("near"))
    rows = rows.select("query", "target", F.aggregate("near", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"), F.array_min("near.low").alias("low"), F.array_max("near.high").alias("high"))
    rank = F.rank().over(Window.partitionBy("query").orderBy(F.desc("n")))
    return rows.filter(F.col("n") >= least).withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def best_hits(hits: DataFrame, key: str = "rid") -> DataFrame:
    """For each query the hit with the most bits (null last); ties go to the smaller target."""
    order = F.struct(F.col("bits").isNull(), -F.col("bits"), F.col("target"))
    fields = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("h")).select(key, "h.*")


def every_read(reads: DataFrame, best: DataFrame, key: str = "rid") -> DataFrame:
    """Reads with what their best hit has; one without a hit stays, with nulls."""
    return reads.join(best, key, "left")


def missed(reads: DataFrame, hits: DataFrame, key: str = "rid") -> DataFrame:
    """Reads without a hit."""
    return reads.join(hits.select(key), key, "left_anti")


def both_strands(reads: DataFrame, reverse: Column, key: str = "query") -> DataFrame:
    """Each read as it is, and reverse-complemented; the column rev tells which."""
    return reads.select(key, "sequence", F.lit(False).alias("rev")).unionByName(reads.select(key, reverse.alias("sequence"), F.lit(True).alias("rev")))


def remapped(start: Column, end: Column, length: Column) -> tuple[Column, Column, Column]:
    """Coordinates of a hit whose query start lies behind its end: reverse, and start and end on the other strand."""
    rev = start > end
    return rev, F.when(rev, length - start + 1).otherwise(start), F.when(rev, length - end + 1).otherwise(end)
