import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq
from spanloom.operators import aligner, d_mapping, germline, projection, seed_join
from spanloom.sources import seqfiles


@pytest.mark.parametrize(
    "qaln, taln, qstart, tstart, intervals, want",
    [
        ("ACGT", "ACGT", 1, 1, [(1, 2), (3, 4)], [(1, 2), (3, 4)]),
        ("ACTTGT", "AC--GT", 1, 1, [(1, 4)], [(1, 6)]),
        ("AC--GT", "ACTTGT", 1, 1, [(1, 2), (3, 4), (3, 5)], [(1, 2), None, (3, 3)]),
        ("GT", "GT", 3, 10, [(1, 9), (10, 10), (11, 30)], [None, (3, 3), (4, 4)]),
    ],
)
def test_projection(spark, qaln, taln, qstart, tstart, intervals, want):
    q, t = projection.aligned_pairs(qaln, taln, qstart, tstart)
    assert projection.extents(q, t, [a for a, _ in intervals], [b for _, b in intervals]) == want
    hits = spark.createDataFrame([(1, qaln, taln, qstart, tstart)], "rid int, qaln string, taln string, qstart int, tstart int")
    rows = spark.createDataFrame([(1, str(i), a, b) for i, (a, b) in enumerate(intervals)], "rid int, name string, rs int, re int")
    got = {r.name: (r.qs, r.qe) if r.qs else None for r in projection.project_rows(hits, rows, ["rid"]).collect()}
    assert [got[str(i)] for i in range(len(intervals))] == want


def kadane(interior, d):
    best = (0, -1, -1)
    for off in range(-(len(d) - 1), len(interior)):
        cur = start = 0
        for i in range(max(0, off), min(len(interior), off + len(d))):
            if cur <= 0:
                cur, start = 0, i
            cur += 1 if interior[i] == d[i - off] else -1
            if cur > best[0]:
                best = (cur, start, i)
    return best


def test_d_alignment_agrees_with_a_scan(spark):
    random.seed(1)
    pairs = [(i, "".join(random.choice("ACGT") for _ in range(random.randint(0, 25))), "".join(random.choice("ACGT") for _ in range(random.randint(1, 15)))) for i in range(120)]
    want = {i: kadane(q, d) for i, q, d in pairs}
    rows = d_mapping.local_rows(spark.createDataFrame(pairs, "rid int, interior string, d string"), ["rid"]).collect()
    assert {r.rid: (r.score, r.s, r.e) for r in rows} == want
    for i, q, d in pairs:
        assert d_mapping.Germlines([("x", d)]).align(q) == [want[i]]


def test_d_alignment_of_odd_pairs(spark):
    """Each row for itself, also where keys repeat, texts are null or empty, or letters are no bases; a batch may hold long ones."""
    r = random.Random(5)
    text = lambda most, letters: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    pairs = [(i % 7, text(40, x), text(25, x)) for i in range(140) for x in ("ACGT", "A\u00fe\u00ff\u65e5\U0001f600", "\x00A")]
    pairs += [(1, None, "ACGT"), (2, "ACGT", None), (None, "ACGT", "CGT"), (3, "", "A"), (4, text(3000, "ACGT") + "A" * 50, "C" + "A" * 40)]
    want = sorted((i or 0, *kadane(q or "", d or "")) for i, q, d in pairs)
    rows = spark.createDataFrame(pairs, "rid int, interior string, d string")
    for cells in (d_mapping.CELLS, 60):
        found = zip(*(x.tolist() for x in best_runs_in(cells, pairs)))
        assert sorted((i or 0, *x) for (i, *_), x in zip(pairs, found)) == want
    assert sorted((x.rid or 0, x.score, x.s, x.e) for x in d_mapping.local_rows(rows, ["rid"]).collect()) == want
    sq.register(spark)
    sql = spark.sql("SELECT rid, b.score, b.s, b.e FROM (SELECT rid, d_align(interior, d) AS b FROM {rows})", rows=rows)
    assert sorted((x.rid or 0, x.score, x.s, x.e) for x in sql.collect()) == want


def best_runs_in(cells, pairs):
    before, d_mapping.CELLS = d_mapping.CELLS, cells
    try:
        return d_mapping.best_runs([p[1] for p in pairs], [p[2] for p in pairs])
    finally:
        d_mapping.CELLS = before


def test_second_d_does_not_overlap():
    lines = d_mapping.Germlines([("D1", "ACGTACGTAC"), ("D2", "TTTTGGGGTT")])
    assert lines.best("CCACGTACGTACCCTTTTGGGGTTCC", True) == [("D1", 2, 11), ("D2", 14, 23)]
    assert lines.best("CCACGTACGTACCCTTTTGGGGTTCC", False) == [("D1", 2, 11)]
    assert lines.best("CCCC", True) == []


def test_scaffolds_merge_equal_ones(spark):
    v = spark.createDataFrame([("IGH", "V1*01", "ATGGCCATG"), ("IGH", "V2*01", "ATGGCCATG"), ("IGK", "K1*01", "ATGGCCAT")], "locus string, allele string, sequence string")
    j = spark.createDataFrame([("IGH", "J1*01", "GGGGGG"), ("IGK", "J2*01", "CCCCCC")], "locus string, allele string, sequence string")
    frames = spark.createDataFrame([("J2*01", 1)], "allele string, frame int")
    got = {r.scaffold_id: r for r in germline.scaffolds(v, j, frames).collect()}
    assert got["IGH_0"].v_calls == ["V1*01", "V2*01"] and got["IGH_0"].n_pad == 9 and got["IGH_0"].sequence == "ATGGCCATG" + "N" * 9 + "GGGGGG"
    assert got["IGK_0"].n_pad == 0 and got["IGK_0"].sequence == "ATGGCCATCCCCCC"


def test_best_hit_ties_go_to_the_smaller_target(spark):
    hits = spark.createDataFrame([(1, "b", 5.0), (1, "a", 5.0), (1, "c", None), (2, "z", None)], "rid int, target string, bits double")
    assert {r.rid: r.target for r in seed_join.best_hits(hits).collect()} == {1: "a", 2: "z"}


def full_score(q, t, s):
    m, low = s.matrix(), -(10**9)
    h, e, f = (np.full((len(q) + 1, len(t) + 1), x) for x in (0, low, low))
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            e[i, j] = max(h[i, j - 1] - s.gap_open, e[i, j - 1] - s.gap_extend)
            f[i, j] = max(h[i - 1, j] - s.gap_open, f[i - 1, j] - s.gap_extend)
            h[i, j] = max(0, h[i - 1, j - 1] + m[q[i - 1], t[j - 1]], e[i, j], f[i, j])
    return h.max()


@pytest.mark.parametrize("scoring", [aligner.Scoring(), aligner.Scoring.aa()])
def test_banded_alignment_agrees_with_the_full_one(scoring):
    random.seed(2)
    letters = aligner.LETTERS[scoring.alphabet]
    targets = ["".join(random.choice(letters) for _ in range(random.randint(60, 90))) for _ in range(8)]
    index = aligner.Index([f"t{i}" for i in range(8)], targets, scoring)
    reads, source = [], []
    for _ in range(40):
        k = random.randrange(8)
        x = list(targets[k])
        for _ in range(random.randint(0, 5)):
            p = random.randrange(len(x))
            x[p : p + random.randint(0, 4)] = [random.choice(letters) for _ in range(random.randint(0, 4))]
        reads.append("".join(x))
        source.append(k)
    codes = [scoring.codes(r) for r in reads]
    read, target, low, high, _ = aligner.candidates(index, codes, 1)
    a = aligner.align(index, codes, read, target, low, high)
    for i in range(len(read)):
        q, t, _ = aligner.strings(a, i, reads[read[i]], targets[target[i]])
        assert target[i] == source[read[i]] and a.score[i] == full_score(codes[read[i]], index.codes[target[i]], scoring)
        assert q.replace("-", "") == reads[read[i]][a.qstart[i] - 1 : a.qend[i]] and t.replace("-", "") == targets[target[i]][a.tstart[i] - 1 : a.tend[i]]


def test_no_targets_no_candidates():
    index = aligner.Index([], [], aligner.Scoring())
    assert all(len(x) == 0 for x in aligner.candidates(index, [aligner.Scoring().codes("ACGTACGTACGTACGT")], 2))


@pytest.mark.parametrize("scoring", [aligner.Scoring(), aligner.Scoring.aa()])
def test_scores_without_paths_are_those_of_alignments(scoring):
    random.seed(3)
    letters = aligner.LETTERS[scoring.alphabet]
    targets = ["".join(random.choice(letters) for _ in range(random.randint(40, 90))) for _ in range(12)]
    targets += [t[:30] + "X" + t[34:] for t in targets]
    index = aligner.Index([f"t{i:02d}" for i in range(24)], targets, scoring)
    reads = ["".join(c if random.random() > 0.06 else random.choice([*letters, "", "X", "AC"]) for c in random.choice(targets)) for _ in range(60)]
    codes = [scoring.codes(r) for r in reads]
    pairs = aligner.candidates(index, codes, 50)[:4]
    assert len(pairs[0]) > 60
    got = aligner.scores(index, codes, *pairs)
    for i in range(len(got)):
        assert got[i] == aligner.align(index, codes, *(x[i : i + 1] for x in pairs)).score[0]


def test_all_ties_with_the_last_target_are_candidates():
    random.seed(4)
    v, w = ("".join(random.choice("ACGT") for _ in range(40)) for _ in range(2))
    index = aligner.Index([f"t{i:02d}" for i in range(90)], [v] * 30 + [w] * 60, aligner.Scoring())
    read, target, *_ = aligner.candidates(index, [aligner.Scoring().codes(v + w[:30])], 50)
    assert list(target) == list(range(90)) and set(read) == {0}
    assert list(aligner.candidates(index, [aligner.Scoring().codes(v + w[:30])], 1)[1]) == list(range(30))


@pytest.mark.parametrize("seqtype", ["nt", "aa"])
def test_counted_seeds_are_those_of_a_plain_count(seqtype):
    """Targets that begin or end alike, of several lengths, one twice and one too short for a seed, and reads with unknown
    letters: seeds of the densest band, its diagonals and ties at the bar, counted one by one."""
    rng = np.random.default_rng(11)
    s = aligner.Scoring() if seqtype == "nt" else aligner.Scoring.aa()
    letters = aligner.LETTERS[seqtype][: 4 if seqtype == "nt" else 20]
    make = lambda n: "".join(rng.choice(list(letters), n))
    vs, js = [make(n) for n in (40, 40, 47, 61)], [make(n) for n in (20, 23, 30)]
    targets = [v + j for v in vs for j in js] + [vs[0] + js[0], "A", make(90)]
    reads = [vs[0] + make(3) + js[1], vs[3][9:] + js[2], make(5) + vs[2][:30] + "XN" + vs[2][31:] + js[0], make(50), "", js[0] + vs[1]]
    index, codes = aligner.Index([str(i) for i in range(len(targets))], targets, s), [s.codes(r) for r in reads]
    like: dict[int, set] = {}
    for a, b in zip(*s.words()) if seqtype == "aa" else ():
        like.setdefault(int(a), set()).add(int(b))
    n = len(aligner.LETTERS[seqtype])
    zero = -(-max(map(len, reads)) // aligner.BAND) * aligner.BAND
    for most in (1, 4, 50):
        expected = []
        for r, q in enumerate(codes):
            rows = []
            for t, c in enumerate(map(s.codes, targets)):
                found = []
                for pattern in s.seeds:
                    (qa, qv), (ta, tv) = aligner.packed_seeds(q, pattern, n), aligner.packed_seeds(c, pattern, n)
                    found += [int(y - x) for x, v in zip(qa, qv) for y, w in zip(ta, tv) if (w in like.get(int(v), ()) if like else v == w)]
                cells = Counter((d + zero) // aligner.BAND for d in found)
                if len(found) >= s.least:
                    dense = min(c for c, k in cells.items() if k == max(cells.values()))
                    near = [d for d in found if abs((d + zero) // aligner.BAND - dense) <= 2]
                    rows.append((r, t, min(near), max(near), len(near)))
            bar = max([s.least, *sorted((x[4] for x in rows), reverse=True)[most - 1 : most]])
            expected += [x for x in rows if x[4] >= bar]
        assert list(zip(*(x.tolist() for x in aligner.candidates(index, codes, most, s.least)))) == expected
        assert len(expected) > 5


def test_a_file_is_never_one_piece(spark, tmp_path):
    """No row that is read is longer than a few records, whatever kind the file is of."""
    reads = [(f"r{i}", "ACGT" * 30) for i in range(400)]
    (tmp_path / "a.fastq").write_text("\n".join(f"@{n}\n{s}\n+\n{'@>' * 60}" for n, s in reads) + "\n")
    (tmp_path / "b.fasta").write_text("\n \n" + "".join(f">x{n}\n{s}\n" for n, s in reads))
    (tmp_path / "c.txt").write_text("\n\n")
    conf, key = spark.sparkContext._jsc.hadoopConfiguration(), "mapreduce.input.linerecordreader.line.maxlength"
    conf.set(key, "2000")  # longer ones are left out
    try:
        rows = seqfiles.read_sequences(spark, str(tmp_path)).orderBy("rid").collect()
        alone = seqfiles.read_sequences(spark, str(tmp_path / "a.fastq")).orderBy("rid").collect()
    finally:
        conf.unset(key)
    assert [(r.read_id, r.sequence) for r in rows] == reads + [(f"x{n}", s) for n, s in reads]
    assert [(r.read_id, r.sequence) for r in alone] == reads


def test_only_seeds_that_targets_have_become_rows(spark, monkeypatch):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("ACGT" * 9 + "Nac") for _ in range(n))
    patterns, texts = aligner.Scoring().seeds, [text(r.randint(0, 120)) for _ in range(80)] + [None, "", text(900), "\u65e5" + text(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "query long, sequence string")
    every = sorted(map(tuple, seed_join.spaced(rows, "query", patterns, "ACGT").collect()))
    seeds = sorted({x[2] for x in every})[::3]
    want = [x for x in every if x[2] in set(seeds)]
    for size in (seed_join.SLICE, 50):  # long texts in pieces
        monkeypatch.setattr(seed_join, "SLICE", size)
        assert sorted(map(tuple, seed_join.known(rows, "query", patterns, "ACGT", seeds).collect())) == want
    targets = spark.createDataFrame([("t", texts[-2][100:180])], "target string, sequence string")
    made = []
    monkeypatch.setattr(seed_join, "known", lambda *a, f=seed_join.known: made.append(f(*a)) or made[0])
    few = sorted(map(tuple, seed_join.shared_seeds(rows, targets, aligner.Scoring()).collect()))
    monkeypatch.setattr(seed_join, "KNOWN_SEEDS", 0)
    assert few == sorted(map(tuple, seed_join.shared_seeds(rows, targets, aligner.Scoring()).collect())) and len(made) == 1
    assert len(few) >= made[0].count() > 60 and made[0].count() < len(every) / 5
