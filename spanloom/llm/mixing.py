"""Mixing sources to target weights by systematic sampling.

Targets are words by source: weights share out a multiple of all words, no source gives more than `cap` times its
own, and what is over goes to the others by weight. Within a source every document expects target / source words
copies. Documents stand in order of size (a keyed hash orders equal sizes); prefix sums of expected copies plus one
random offset give each document as many copies as it crosses integers. Because neighbours in that order have
about the same size, the words taken miss the target by about one document.

Prefix sums need no source in one task: rows are range-partitioned over (source, size, hash), each partition's
counts by source are added up in a small table, and a row's rank is that sum plus its place in its partition. The
targets come from prefix sums over sources made alike, so there may be many sources.

Defined cases: null text has size 0; texts of any length are counted whole. A null source is a source of its own, the
last in order. Where all sizes of a source are 0, its target and its copies are 0. Repeated rows are sampled one by
one, also where they have no doc_id. mix() ignores other columns; mixed() carries them along, whatever they are called.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import prefix_sums, small, stored, text_key, tidy, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 20


def offset(seed: int) -> float:
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: source, source_size; one row a source. Adds target.

    The resharing of excess ends where every target is the smaller of its cap and weight times one level; the level
    is found from sums over the sources in order of cap / weight.
    """
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = prefix_sums(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], [], "mix-sources")
    rows = rows.select("source", "source_size", pick.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("most"))
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    rows = prefix_sums(rows, [F.col("ratio"), F.col("source").asc_nulls_last()], ["most", "weight"], "mix-ratios")
    words, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (words or 0)) - F.col("before_most")) / (F.lit(weight or 1.0) - F.col("before_weight"))
    fits = rows.select("ratio", level.alias("level")).filter("level <= ratio").agg(F.min(F.struct("ratio", -F.col("level")))).first()[0]  # of equal ratios the first
    target = F.least("most", F.col("weight") * F.lit(-fits[1])) if fits else F.col("most")
    return rows.select("source", "source_size", target.alias("target"))


def crossings(rank: Column, rate: Column, shift: float) -> Column:
    """Integers crossed between the prefix sums before and at the row of this rank, counted from 1."""
    upto = lambda k: F.floor(k * rate + F.lit(shift))
    return F.least(upto(rank) - upto(rank - 1), F.ceil(rate)).cast("long")


def _ordered(docs: DataFrame, seed: int, *carried: Column) -> DataFrame:
    """The rows in order of source and size, with their partition and their place in it."""
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        *carried, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        tie.alias("tie"), text_key().alias("text_key"), F.monotonically_increasing_id().alias("nth"),
    )
    # Rows that repeat id and text do the same whichever comes first; by their number they are spread over tasks.
    order = ["source", "size", "tie", "doc_id", "text_key", "nth"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "text_key", "nth")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(rows.select("*", F.spark_partition_id().alias("part"), place.alias("place")), "mix-order", keep=True)


def _sampled(ranked: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int) -> DataFrame:
    """_ordered() rows with source_size, target and copies."""
    cells = stored(ranked.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.sum("size").alias("words")), "mix-cells")
    goals = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("source", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    cells = cells.join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
    cells = stored(cells.select(F.col("source").alias("cell_source"), F.col("part").alias("cell_part"), "base", "source_size", "target"), "mix-goals", keep=True)

    out = ranked.join(small(cells), F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("part") == F.col("cell_part")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = crossings(F.col("base") + F.col("place") + 1, rate, offset(seed))
    return out.withColumn("copies", copies)


@tidy
def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs: doc_id, source, text. Returns doc_id, source, size, source_size, target, copies and taken words by row."""
    rows = _sampled(_ordered(docs, seed), weights, share, cap, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


@tidy
def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as its own copies say, with all its columns. Rows travel whole, so
    they need no id."""
    rows = _sampled(_ordered(docs, seed, F.struct("*").alias("row")), weights, share, cap, seed).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {CAP}::DOUBLE * source_size AS most, [{', '.join(f'{float(x)}::DOUBLE' for x in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
l AS (SELECT *, most / weight AS ratio,
  ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(most, weight * coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level DESC LIMIT 1), 'inf'::DOUBLE)) AS target FROM l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * least(floor(k * rate + {offset(SEED)!r}::DOUBLE) - floor((k - 1) * rate + {offset(SEED)!r}::DOUBLE), ceil(rate)))::BIGINT AS taken FROM r
"""
