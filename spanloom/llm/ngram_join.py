"""Similarity join of documents on word n-grams: all pairs of Jaccard similarity `numerator`/100 or more.

Universe-partition pigeonhole. Sets are put in bands by size; a set meets only sets of its own and the next smaller
band. Two similar sets of a band differ in at most H n-grams. A hash deals the universe of n-grams to m segments.
Of two sets that differ in H places at most, some segment must agree, or, where a segment counts double because its
one-deletion neighbourhood is indexed too, agree up to one n-gram. A set may leave out its `a` smallest segments,
which many unrelated sets share (such as empty ones), if m is 2 * a larger. For each band the numbers of segments, of
one-deletion segments and of segments left out are those of least cost, by a model of index rows and of chance
agreements that takes the number of sets in the band: the more sets, the more selective the segments.

Sets of equal n-grams are one class, known by a 128-bit digest. The sets of an index entry are compared with its hub
first, the one of them that meets the most others: exactly, on all n-grams. Those outside the hub's component find a
hub among themselves, and so on for a few turns. Only then, in entries that still hold sets of different components,
pairs across components are compared too, but for those that their differences from a hub rule out (the triangle
inequality; a prefix filter on the differences where there are many). So no entry is expanded into all pairs, and no link between different components is lost. Entries that
are long within one task are first gathered there under a salted key, so hot entries reach the shuffle reduced.

Defined cases: null and empty texts, and texts without words, have no n-grams and link with nothing: each is its own
component. Texts with fewer words than n have one, the whole; long texts count with all their n-grams. Rows that repeat
a text are one class; if all its doc_ids are null so is its component_id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Bitmap, giving_back, joined_apart, key_bitmap, one_each, slices, small, stored, text_bytes, text_key, tidy
from spanloom.llm.graph import components
from spanloom.llm.substring_dedup import _B, Sequences, _mixed

WORDS = 4
NUMERATOR = 85
#: The last bits of an index key are 0, or the salt of an entry gathered in one task.
SALT = (1 << 12) - 1
#: A task gathers its index in pieces of so many rows; entries of so many rows get a salt.
PIECE, LONG_ENTRY = 500_000, 8
#: Index rows of a batch that goes back to Spark.
BATCH_ROWS = 1 << 16
#: Bytes of text that a pass takes at once: its arrays have many times the size.
TEXT_BYTES = 512 << 10
#: A task sorts about so many rows of the index, however much of it there is for the session's shuffle partitions.
INDEX_ROWS = 500_000
#: Numbers of segments that a set may leave out.
LEFT_OUT = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
#: Hubs that the sets of an entry are compared with, one after the other, before pairs are.
TURNS = 3
#: A hub's sets are paired by their edits if more pairs are left than this for each edit.
EDIT_COST = 32
_C, _D = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


# Sets


def shingle_sets(bodies: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Of each text in lower case, its sorted different n-grams as 64-bit hashes."""
    lists = [x.split() for x in bodies]
    flat = Sequences([w for x in lists for w in x], _B)
    starts = np.arange(max(0, flat.n - words + 1))
    grams = _mixed(flat.of(starts, starts + words)) if len(starts) else np.zeros(0, np.uint64)
    out, at = [], 0
    for x in lists:
        n = len(x)
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        elif n:
            own = flat.of(np.array([at]), np.array([at + n]))
            out.append(_mixed(own + np.array([n], np.uint64) * _C))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams by their last bits, one for about each n-gram, as 64-bit words. An n-gram that only one
    of two sets has flips one, so as many as differ tell how many n-grams do, at least. The two halves of a sketch
    make, by exclusive or, the one of half the length."""
    bits = 1 << max(10, (max(len(grams), 1) - 1).bit_length())
    odd = np.bincount((_mixed(grams * _D) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def short(key: bytes) -> int:
    """A set's id in the index."""
    return int.from_bytes(key[:8], "big", signed=True)


# Bands and their cost


def band_edges(most: int, numerator: int) -> list[int]:
    """Band i has the sizes from edges[i] to edges[i + 1] - 1."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * 100 // numerator + 1))
    return edges


@dataclass(frozen=True)
class Scheme:
    """Of the pairs whose smaller set lies in a band."""

    differ: int  # H; 0 if only equal sets are similar
    segments: int
    doubled: int  # the first ones, with one-deletion neighbourhoods
    left_out: int


def _left(mean: float, a: int) -> float:
    """What of a Poisson number is over a, on average."""
    p = math.exp(-mean)
    below, out = p, mean - a
    for k in range(a + 1):
        out += (a - k) * p
        p *= mean / (k + 1)
    return max(out, 0.0) if below >= 0 else 0.0


def cost(sets: float, size: float, m: int, doubled: int, a: int, common: float = 0.1, passage: int = 50, pair: float = 10.0) -> float:
    """Index rows, plus `pair` for each chance agreement; `common` of all sets are taken to share a passage."""
    load, single = size / m, m - doubled
    rows = single - a + doubled * (1 + load)
    empty = math.exp(-load)
    chance = (_left(single * empty, a) ** 2 / single if single else 0.0) + passage * single / m * (common * empty) ** 2
    near = empty * (1 + load)
    chance += doubled * near**2 + passage * doubled / m * (common * near) ** 2
    return sets * rows + sets * sets / 2 * chance * pair


def allocated(differ: int, sets: float, size: float) -> Scheme:
    """The cheapest allocation: doubled segments count two, left-out ones cost two, and the sum exceeds H."""
    if not differ:
        return Scheme(0, 0, 0, 0)
    best = None
    for a in LEFT_OUT:
        if a > differ // 2 + 1:
            break
        need = differ + 1 + 2 * a
        for part in (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1):
            m = math.ceil(need / (1 + part))
            doubled = need - m
            if a > m - doubled or (a and m - doubled - 2 * a < 0):
                continue
            found = (cost(sets, size, m, doubled, a), Scheme(differ, m, doubled, a))
            if best is None or found[0] < best[0]:
                best = found
    return best[1]


class Plan:
    """Bands, and arrays over them of the schemes' numbers."""

    def __init__(self, counts: dict[int, int], most: int, numerator: int):
        self.numerator = numerator
        self.edges = np.array(band_edges(most, numerator))
        schemes = []
        for i in range(len(self.edges) - 1):
            largest = int(self.edges[i + 1]) - 1
            differ = largest * (100 - numerator) // numerator
            schemes.append(allocated(differ, counts.get(i, 0) + counts.get(i + 1, 0), float(self.edges[i])))
        self.differ, self.m, self.doubled, self.left_out = (np.array([getattr(s, f) for s in schemes], np.int64) for f in ("differ", "segments", "doubled", "left_out"))

    def rows(self, counts: dict[int, int]) -> int:
        """About how many index rows so many sets of each band have: those of its own scheme and of the next smaller."""
        loads = self.edges[:-1] / np.maximum(self.m, 1)
        each = np.where(self.differ > 0, self.m - self.left_out + self.doubled * loads, 0)
        return int(sum(n * (each[i] + (each[i - 1] if i else 0)) for i, n in counts.items()))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1


def index_keys(sets: list[np.ndarray], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all index entries of these sets, and the place of the set that each is of."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sizes = np.array([len(x) for x in sets], np.int64)
    bands = plan.band(sizes)
    for lower in (0, 1):
        scheme = bands - lower
        take = (sizes > 0) & (scheme >= 0)
        take &= plan.differ[np.maximum(scheme, 0)] > 0
        if lower:  # only if a set of that band can be large enough
            take &= sizes * plan.numerator <= (plan.edges[np.maximum(bands, 0)] - 1) * 100
        who = np.flatnonzero(take)
        if not len(who):
            continue
        scheme, sizes_, grams = scheme[who], sizes[who], np.concatenate([sets[i] for i in who])
        m, doubled, left_out = plan.m[scheme], plan.doubled[scheme], plan.left_out[scheme]
        base = np.concatenate([[0], np.cumsum(m)])
        dealt = ((_mixed(grams * _C) >> np.uint64(32)) * np.repeat(m, sizes_).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place = np.repeat(base[:-1], sizes_) + dealt
        order = np.argsort(place, kind="stable")
        values = _mixed(grams * _D)[order]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        counts = np.bincount(place, minlength=base[-1])
        ends = np.cumsum(counts)
        totals = sums[ends] - sums[ends - counts]
        owner = np.repeat(np.arange(len(who)), m)
        nth = np.arange(base[-1]) - base[owner]
        tag = _mixed((nth.astype(np.uint64) + np.uint64(1)) * _C + (scheme[owner].astype(np.uint64) + np.uint64(1)) * _D)
        two = nth < doubled[owner]
        ranked = np.lexsort((np.where(two, np.iinfo(np.int64).max, counts), owner))  # smallest first, by set
        skip = np.zeros(base[-1], bool)
        skip[ranked[np.arange(base[-1]) - base[owner] < left_out[owner]]] = True
        keys.append(_mixed(totals + tag)[~skip])
        owners.append(who[owner[~skip]])
        if two.any():
            at = place[order]
            inside = two[at]
            keys.append(_mixed(totals[at[inside]] - values[inside] + tag[at[inside]]))
            owners.append(who[owner[at[inside]]])
    return np.concatenate(keys), np.concatenate(owners)


# Passes over texts

SETS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), ("id", pa.int64()), ("key", pa.binary()), ("digest", pa.binary())])


def _sets(words: int, numerator: int) -> object:
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(band_edges(1 << 40, numerator))
        for batch in batches:
            for piece in slices(batch, "text", TEXT_BYTES):
                bodies = [x.lower() for x in text_bytes(piece.column(1))]
                sets = shingle_sets(bodies, words)
                keys = [set_key(x) for x in sets]
                sizes = np.array([len(x) for x in sets], np.int64)
                yield pa.record_batch([
                    piece.column(0),
                    piece.column(2),
                    pa.array(sizes),
                    pa.array((np.searchsorted(edges, sizes, side="right") - 1).astype(np.int32)),
                    pa.array([short(k) for k in keys], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([xxhash.xxh3_64_digest(x) for x in bodies], pa.binary()),
                ], schema=SETS)

    return run


def gathered(keys: np.ndarray, owners: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Index rows of one task with its long entries under the salt, but for their first sets."""
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([new, [len(keys)]]))
    long = counts >= LONG_ENTRY
    if not long.any():
        return keys, owners
    firsts, heads = keys[new][long], np.minimum.reduceat(owners, new)[long]
    keys = np.where(np.repeat(long, counts), keys | np.uint64(salt), keys)
    return np.concatenate([keys, firsts]), np.concatenate([owners, heads])


def _index(words: int, plan: Plan) -> object:
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, part = 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, owners = gathered(np.concatenate([k for k, _ in held]), np.concatenate([o for _, o in held]), 1 + part * 2654435761 % SALT)
            for i in range(0, len(keys), BATCH_ROWS):  # the JVM holds each batch as one buffer
                yield pa.record_batch([pa.array(keys[i : i + BATCH_ROWS].view(np.int64)), pa.array(owners[i : i + BATCH_ROWS])], names=["entry", "id"])

        for batch in batches:
            for piece in slices(batch, "text", TEXT_BYTES):
                fresh = []
                for x in shingle_sets([x.lower() for x in text_bytes(piece.column(0))], words):
                    if len(x) and (key := set_key(x)) not in seen:
                        seen.add(key)
                        fresh.append((short(key), x))
                if fresh:
                    keys, owners = index_keys([x for _, x in fresh], plan)
                    held.append((keys & np.uint64(~SALT & (1 << 64) - 1), np.array([i for i, _ in fresh], np.int64)[owners]))
                    size += len(keys)
                if size >= PIECE:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _grams(words: int, bitmap: Bitmap) -> object:
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in slices(batch, "text", TEXT_BYTES):
                bodies = [x.lower() for x in text_bytes(piece.column(0))]
                sets = shingle_sets([x for x in bodies if bitmap.may_have(xxhash.xxh3_64_digest(x))], words)
                keys = [set_key(x) for x in sets]
                fresh = []
                for i, key in enumerate(keys):
                    if len(sets[i]) and key not in seen:
                        seen.add(key)
                        fresh.append(i)
                yield pa.record_batch([
                    pa.array([short(keys[i]) for i in fresh], pa.int64()),
                    pa.array([keys[i] for i in fresh], pa.binary()),
                    pa.array([len(sets[i]) for i in fresh], pa.int64()),
                    pa.array([sketch(sets[i]) for i in fresh], pa.list_(pa.int64())),
                    pa.array([sets[i].view(np.int64) for i in fresh], pa.list_(pa.int64())),
                ], names=["id", "key", "n", "sketch", "grams"])

    return run


# The join


def _dealt(entries: DataFrame, rows: int) -> DataFrame:
    """The index by entry, in as many partitions as its rows need if the session's shuffle has fewer."""
    parts = -(-rows // INDEX_ROWS)
    return entries.repartition(parts, "entry") if parts > int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")) else entries


def _halved(words: Column) -> Column:
    half = F.size(words) / 2
    return F.zip_with(F.slice(words, F.lit(1), half.cast("int")), F.slice(words, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))


def _least_differ(u: Column, v: Column) -> Column:
    """From the sketches of two sets: n-grams that at least are in one of both only."""
    u, v = F.when(F.size(u) > F.size(v), _halved(u)).otherwise(u), F.when(F.size(v) > F.size(u), _halved(v)).otherwise(v)
    return F.aggregate(F.zip_with(u, v, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)


def _only(grams: DataFrame, *ids: DataFrame) -> DataFrame:
    """The sets with these ids. A bounded number of ids is broadcast, so that no other n-grams are shuffled."""
    wanted = ids[0].toDF("only")
    for more in ids[1:]:
        wanted = wanted.union(more.toDF("only"))
    return grams.join(small(stored(wanted.distinct(), "ngram-wanted")), F.col("id") == F.col("only"), "left_semi")


def compared(pairs: DataFrame, grams: DataFrame, numerator: int) -> DataFrame:
    """pairs: u, v (ids). Returns them with the keys a and b of the sets, linked, and bounds of how many n-grams are in
    one of both only (least, most). Sketches of both sets tell most pairs that are not similar; for the others all
    n-grams are compared, and the bounds meet."""
    side = lambda s, k, c: grams.select(F.col("id").alias(f"id_{s}"), F.col("key").alias(k), F.col(c).alias(f"{c}_{s}"), F.col("n").alias(f"n_{s}"))
    rows = pairs.join(side("u", "a", "sketch"), F.col("u") == F.col("id_u")).join(side("v", "b", "sketch"), F.col("v") == F.col("id_v"))
    rows = rows.filter(100 * F.least("n_u", "n_v") >= numerator * F.greatest("n_u", "n_v"))
    rows = stored(rows.select("u", "v", "a", "b", (F.col("n_u") + F.col("n_v")).alias("sum"), _least_differ(F.col("sketch_u"), F.col("sketch_v")).cast("long").alias("least")), "ngram-sketched")
    may = (100 + numerator) * F.col("least") <= (100 - numerator) * F.col("sum")
    grams = _only(grams, rows.filter(may).select("u"), rows.filter(may).select("v"))
    both = rows.filter(may).join(side("u", "a_", "grams").drop("n_u"), F.col("a") == F.col("a_")).join(side("v", "b_", "grams").drop("n_v"), F.col("b") == F.col("b_"))
    both = both.select("u", "v", "a", "b", "sum", F.size(F.array_intersect("grams_u", "grams_v")).cast("long").alias("shared"))
    exact = F.col("sum") - 2 * F.col("shared")
    both = both.select("u", "v", "a", "b", (100 * F.col("shared") >= numerator * (F.col("sum") - F.col("shared"))).alias("linked"), exact.alias("least"), exact.alias("most"))
    return both.unionByName(rows.filter(~may).select("u", "v", "a", "b", F.lit(False).alias("linked"), "least", F.col("sum").alias("most")))


def _crossing(mixed: DataFrame, grams: DataFrame, numerator: int) -> DataFrame:
    """mixed: hub, id, n, label, first (the weightiest hub of id), least, most (bounds of what id and hub differ by).
    Pairs u < v of one hub and of different components that may be similar. A pair whose sets have one first hub is
    looked for at that hub only.

    Where a hub has few such pairs, all are taken that the triangle inequality and the sketches allow. Where it has far
    more than its sets have edits (differences from the hub), pairs are found by what they edited: let A and B be the differences of
    two sets from the hub. The sets differ by |A| + |B| - 2 |A and B|, so similar ones share edits. In one order of all
    edits (what a set has added first, since others seldom have it) a prefix of A must meet one of B (prefix filter)."""
    share = (100 - numerator) / (100 + numerator)  # similar sets differ by at most this part of the sum of their sizes
    names = ("id", "n", "label", "first", "least", "most")
    # A hub all of whose sets have one other first hub has nothing to add.
    load = mixed.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("least", "n")).alias("edits"), F.min("first").alias("lo"), F.max("first").alias("hi"))
    load = load.groupBy(F.col("hub").alias("load_hub")).agg(F.sum("k").alias("sets"), F.sum(F.col("k") * F.col("k")).alias("same"), F.sum("edits").alias("edits"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    load = load.filter((F.col("lo") != F.col("hi")) | (F.col("lo") == F.col("load_hub")))
    load = stored(load.select("load_hub", (F.col("sets") * F.col("sets") - F.col("same") > 2 * F.col("edits") * EDIT_COST).alias("many")), "ngram-load")
    mixed = mixed.join(load, F.col("hub") == F.col("load_hub")).drop("load_hub")
    sized = 100 * F.least("n_u", "n_v") >= numerator * F.greatest("n_u", "n_v")
    here = (F.col("first_u") != F.col("first_v")) | (F.col("first_u") == F.col("hub_u"))

    direct = mixed.filter("not many").join(grams.select(F.col("id").alias("g_id"), "sketch"), F.col("id") == F.col("g_id"))
    one, other = (direct.select(F.col("hub").alias(f"hub_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in (*names, "sketch"))) for s in ("u", "v"))
    may = (F.col("hub_u") == F.col("hub_v")) & (F.col("id_u") < F.col("id_v")) & (F.col("label_u") != F.col("label_v")) & sized & here
    apart = F.greatest(F.col("least_u") - F.col("most_v"), F.col("least_v") - F.col("most_u"))  # what they differ by at least
    may &= F.coalesce((100 + numerator) * apart <= (100 - numerator) * (F.col("n_u") + F.col("n_v")), F.lit(True))
    may &= (100 + numerator) * _least_differ(F.col("sketch_u"), F.col("sketch_v")).cast("long") <= (100 - numerator) * (F.col("n_u") + F.col("n_v"))
    few = one.join(other, may).select("id_u", "id_v")

    heavy = mixed.filter("many").select("hub", "id", "n", "label", "first")
    own = heavy.filter("id = hub").select(F.col("hub").alias("own_hub"), F.col("label").alias("own_label"))
    heavy = heavy.filter("id <> hub").join(own, F.col("hub") == F.col("own_hub"))  # the hub itself has been compared with all
    heavy = stored(heavy, "ngram-heavy")
    grams = _only(grams, heavy.select("id"), heavy.select("hub"))
    of = lambda s: grams.select(F.col("id").alias(f"g_{s}"), F.col("grams").alias(f"grams_{s}"))
    heavy = heavy.join(of("id"), F.col("id") == F.col("g_id")).join(of("hub"), F.col("hub") == F.col("g_hub"))
    edits = F.concat(F.array_sort(F.array_except("grams_id", "grams_hub")), F.array_sort(F.array_except("grams_hub", "grams_id")))
    heavy = heavy.select("hub", "id", "n", "label", "first", (F.col("label") != F.col("own_label")).alias("out"), edits.alias("edits"))
    heavy = stored(heavy.withColumn("excess", F.size("edits") - F.lit(share) * F.col("n")), "ngram-edits")
    # Similar sets share at least half of the sum of their excesses; the least excess of a partner bounds it for a set.
    lows = heavy.groupBy(F.col("hub").alias("low_hub")).agg(F.min("excess").alias("low"), F.min(F.when(F.col("out"), F.col("excess"))).alias("low_out"))
    prefix = lambda low: F.size("edits") - F.greatest(F.ceil((F.col("excess") + F.col(low)) / 2 - 1e-6), F.lit(1)) + 1
    rows = heavy.join(lows, F.col("hub") == F.col("low_hub")).withColumns({"with_out": prefix("low_out"), "with_any": F.when(F.col("out"), prefix("low")).otherwise(0)})
    longest = F.greatest(F.coalesce("with_out", F.lit(0)), F.col("with_any"), F.lit(0)).cast("int")
    rows = rows.select("hub", "id", "n", "label", "first", "out", "excess", F.size("edits").alias("k"), "with_out", "with_any", F.posexplode(F.slice("edits", F.lit(1), longest)).alias("place", "edit"))
    rows = stored(rows.withColumns({"with_out": F.col("place") < F.coalesce("with_out", F.lit(0)), "with_any": F.col("place") < F.col("with_any")}), "ngram-prefixes")
    # One of two sets of different components is outside the hub's; it meets sets outside, and sets inside.
    x = rows.filter("out").select(F.col("hub").alias("hub_u"), F.col("edit").alias("x_edit"), F.col("id").alias("x"), F.col("n").alias("n_u"), F.col("label").alias("label_u"), F.col("first").alias("first_u"), F.col("with_out").alias("x_out"), F.col("with_any").alias("x_any"), F.col("excess").alias("x_excess"), (F.col("k") - F.col("place")).alias("x_left"))
    y = rows.filter("with_out").select("hub", "edit", F.col("id").alias("y"), F.col("n").alias("n_v"), F.col("label").alias("label_v"), F.col("first").alias("first_v"), F.col("out").alias("y_is_out"), F.col("excess").alias("y_excess"), (F.col("k") - F.col("place")).alias("y_left"))
    met = (F.col("hub") == F.col("hub_u")) & (F.col("edit") == F.col("x_edit")) & (F.col("label_u") != F.col("label_v")) & sized & here
    met &= (F.col("y_is_out") & F.col("x_out") & (F.col("x") < F.col("y"))) | (~F.col("y_is_out") & F.col("x_any"))
    # If this is the first edit that they share, they share no more than what is left from here.
    met &= F.least("x_left", "y_left") >= (F.col("x_excess") + F.col("y_excess")) / 2 - 1e-6
    found = x.join(y, met).select(F.least("x", "y").alias("id_u"), F.greatest("x", "y").alias("id_v"))
    return few.union(found).distinct().select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))


@tidy
def _labelled(docs: DataFrame, words: int, numerator: int) -> DataFrame:
    """doc_id, text_key, n, label (of its component; null without n-grams) for each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(_sets(words, numerator), "doc_id long, text_key long, n long, band int, id long, key binary, digest binary")
    sets = stored(sets, "ngram-sets", keep=True)
    bands = sets.filter("n > 0").groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.max("n").alias("most")).collect()  # a row for each power of 1 / 0.85
    counts = {r.band: r.sets for r in bands}
    plan = Plan(counts, max([1, *(r.most for r in bands)]), numerator)

    entries = _dealt(docs.select("text").mapInArrow(_index(words, plan), "entry long, id long"), plan.rows(counts))
    stars = entries.withColumn("head", F.min("id").over(Window.partitionBy("entry"))).filter("id <> head")
    stars = stars.select(F.col("entry").bitwiseAND(F.lit(~SALT)).alias("entry"), F.array("id", "head").alias("ids"))
    members = stored(stars.select("entry", F.explode("ids").alias("id")).distinct(), "ngram-members")
    near = stored(members.select("id").distinct().join(sets, "id").select("id", "n", "key", "digest").distinct(), "ngram-near")
    grams = docs.select("text").mapInArrow(_grams(words, key_bitmap(near, "digest")), "id long, key binary, n long, sketch array<long>, grams array<long>")
    grams = grams.join(near.select(F.col("key").alias("near_key")).distinct(), F.col("key") == F.col("near_key"), "left_semi")
    grams = stored(grams.dropDuplicates(["key"]), "ngram-grams")
    sizes = near.groupBy("id").agg(F.min("n").alias("n"))

    # Sets that meet the most others are the hubs of their entries: of near copies mostly what they were made from.
    members = members.join(sizes, "id")
    width = members.groupBy(F.col("entry").alias("w_entry")).agg(F.count(F.lit(1)).alias("width"))
    width = stored(width, "ngram-width")  # as a table, so that the join below can split a hot entry
    weight = members.join(width, F.col("entry") == F.col("w_entry")).groupBy(F.col("id").alias("w_id")).agg(F.sum("width").alias("weight"))
    members = stored(members.join(weight, F.col("id") == F.col("w_id")).select("entry", "id", "n", "weight"), "ngram-weighed")
    active, links, tested, label_of = members, None, None, None
    for turn in range(TURNS):
        hub = active.groupBy(F.col("entry").alias("h_entry")).agg(F.max(F.struct("weight", "id", "n")).alias("hub"))
        hub = stored(hub.select("h_entry", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "ngram-hubs")
        pairs = active.join(hub, F.col("entry") == F.col("h_entry")).filter((F.col("id") != F.col("hub")) & (100 * F.least("n", "hub_n") >= numerator * F.greatest("n", "hub_n")))
        pairs = pairs.select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
        if turn:
            pairs = pairs.join(tested.select(F.col("u").alias("t_u"), F.col("v").alias("t_v")), (F.col("u") == F.col("t_u")) & (F.col("v") == F.col("t_v")), "left_anti")
            pairs = pairs.join(tested.select(F.col("u").alias("t_v"), F.col("v").alias("t_u")), (F.col("u") == F.col("t_u")) & (F.col("v") == F.col("t_v")), "left_anti")
        found = stored(compared(pairs, grams, numerator), "ngram-compared")
        if turn and not found.filter("linked").head(1):
            tested = tested.unionByName(found)
            break
        tested = found if tested is None else tested.unionByName(found)
        links = tested.filter("linked").select("a", "b")
        labels = components(links)
        label_of = near.select("id", "key").distinct().join(labels, F.col("key") == F.col("node"), "left")
        label_of = stored(label_of.select(F.col("id").alias("l_id"), F.coalesce("label", "key").alias("label")), "ngram-labels")
        # Sets that are not in their hub's component go on, and look for a hub among themselves.
        apart = active.join(hub, F.col("entry") == F.col("h_entry")).join(label_of, F.col("id") == F.col("l_id")).withColumnRenamed("label", "own").drop("l_id")
        apart = apart.join(label_of, F.col("hub") == F.col("l_id")).filter("own <> label")
        active = stored(apart.select("entry", "id", "n", "weight"), "ngram-apart")
        if not active.head(1):
            break

    # What is left: entries with several components. All pairs across them, but for those that sets known to differ
    # from a hub rule out: two sets differ at least by as much as their differences from a third one do.
    mixed = members.join(label_of, F.col("id") == F.col("l_id"))
    several = mixed.groupBy(F.col("entry").alias("s_entry")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("s_entry")
    several = stored(several, "ngram-several")
    mixed = mixed.join(several, F.col("entry") == F.col("s_entry"))
    hub = mixed.groupBy(F.col("entry").alias("h_entry")).agg(F.max(F.struct("weight", "id")).alias("hub"))
    mixed = mixed.join(hub, F.col("entry") == F.col("h_entry"))
    # Entries with one hub are looked at together: a pair counts once for a hub, not once for an entry.
    mixed = mixed.select("hub", "id", "n", "label").distinct()
    first = mixed.groupBy(F.col("id").alias("f_id")).agg(F.max("hub").alias("first"))
    mixed = mixed.join(first, F.col("id") == F.col("f_id")).select(F.col("hub.id").alias("hub"), "id", "n", "label", F.col("first.id").alias("first"))
    far = tested.select(F.col("u").alias("f_u"), F.col("v").alias("f_v"), "least", "most").distinct()
    mixed = mixed.join(far, (F.col("id") == F.col("f_u")) & (F.col("hub") == F.col("f_v")), "left")
    off = [F.when(F.col("id") == F.col("hub"), 0).otherwise(F.col(c)).alias(c) for c in ("least", "most")]
    mixed = stored(mixed.select("hub", "id", "n", "label", "first", *off), "ngram-mixed")
    if mixed.head(1):
        crossing = stored(_crossing(mixed, grams, numerator), "ngram-crossing")
        done = tested.select(F.least("u", "v").alias("t_u"), F.greatest("u", "v").alias("t_v")).distinct()
        crossing = crossing.join(done, (F.col("u") == F.col("t_u")) & (F.col("v") == F.col("t_v")), "left_anti")
        more = stored(compared(crossing, grams, numerator).filter("linked").select("a", "b"), "ngram-more")
        if more.head(1):
            links = links.union(more)
    labels = stored(components(links).withColumnRenamed("node", "key"), "ngram-components", keep=True)
    copies = stored(sets.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "ngram-copies", keep=True)
    rows = joined_apart(sets.select("doc_id", "text_key", "n", "key"), labels, ["key"], copies, sets.count(), "left")
    return rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("label"))


@tidy
def ngram_join(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles and component_id for each row."""
    rows = stored(_labelled(docs, words, numerator), "ngram-rows", keep=True)
    lowest = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("n"))
    lowest = stored(lowest, "ngram-lowest", keep=True)
    rows = joined_apart(rows.withColumnRenamed("n", "n_shingles"), lowest.drop("n"), ["label"], lowest, rows.count(), "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id"))


@tidy
def one_of_each(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest doc_id (null last), of several of these the
    one whose text hashes least, of rows that repeat that too any one. Rows without n-grams all stay."""
    rows = stored(_labelled(docs, words, numerator).filter("label is not null"), "ngram-rows")
    me = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_key")
    best = stored(rows.groupBy("label").agg(F.min(me).alias("best"), F.count(F.lit(1)).alias("n")), "ngram-best")
    rows = joined_apart(rows, best.filter("n > 1").select("label", "best"), ["label"], best, rows.count()).select(me.alias("me"), "best")
    own = rows.groupBy("me.id", "me.text_key").agg(F.max(F.col("me") == F.col("best")).alias("kept"), F.count(F.lit(1)).alias("same"))
    own = stored(own, "ngram-others", keep=True)
    return one_each(docs, own.filter("not kept").select("id", "text_key"), own.filter("kept and same > 1").select("id", "text_key"))
