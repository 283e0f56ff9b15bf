"""Clusters, vector codes and url filters against plain code."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from spanloom.llm import ball_tree, url_filters, vector_codes, vectors

ROWS = "vec_id long, embedding array<float>, label int, cluster string, id long, vector string"
DOUBLES = ROWS.replace("array<float>", "array<double>")


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame([(i, v, l, "clash", 7, "clash") for i, v, l in rows], schema).repartition(3)


def points(n, dims, seed=1, hot=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (6, dims))
    out = [(i, [float(np.float32(x)) for x in middles[rng.integers(6)] + rng.normal(0, 0.05, dims)], int(rng.integers(3))) for i in range(n)]
    same = out[0][1]
    return [(i, same if rng.random() < hot else v, l) for i, v, l in out]


ODD = [(1000, None, 1), (1001, [1.0] * 63, 1), (1002, [], 1), (1003, [None] + [0.5] * 63, 1), (1004, [math.nan] + [0.5] * 63, None), (1005, [math.inf] * 64, 1), (1006, [1.0] * 65, 1)]


def whole(v, scale):
    return [math.floor(Fraction(x) * scale) for x in v]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, centres):
    return min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))


def lloyd(rows, centres, rounds):
    for _ in range(rounds):
        own = [nearest(v, centres) for v in rows]
        for c in range(len(centres)):
            mine = [v for v, o in zip(rows, own) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [nearest(v, centres) for v in rows], centres


def plain_clusters(rows, scale=64):
    kept = [(i, whole(v, scale)) for i, v, _ in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    own, centres = lloyd([v for _, v in kept], [v for _, v in order[:16]], 3)
    far = [square(v, centres[c]) for (_, v), c in zip(kept, own)]
    by = Counter()
    for c, d in zip(own, far):
        by[c] += d
    cap = lambda x: min(x, vectors.MOST)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, cap(d), cap(by[c]), cap(sum(by.values())), sha[c]) for (i, _), c, d in zip(kept, own, far)), key=repr)


@pytest.mark.parametrize("seed,hot", [(1, 0.3), (2, 0.95)])
def test_clusters_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ball_tree, "LEAF", 4)
    rows = points(300, 64, seed, hot) + [(5, [0.25] * 64, 1), (5, [0.5] * 64, 1), (None, [0.125] * 64, None)]
    got = sorted(map(tuple, ball_tree.clusters(frame(spark, rows + ODD)).collect()), key=repr)
    assert got == plain_clusters(rows)


def test_clusters_of_large_components_and_few_or_no_vectors(spark):
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.random.default_rng(3).normal(0, 1e38, (20, 64)))] + points(10, 64)
    rows = [(i, v, l) for i, (_, v, l) in enumerate(rows)] + [(77, [1e9] * 64, 1)]
    assert sorted(map(tuple, ball_tree.clusters(frame(spark, rows, DOUBLES)).collect()), key=repr) == plain_clusters(rows)
    few = rows[:3]
    assert sorted(map(tuple, ball_tree.clusters(frame(spark, few, DOUBLES)).collect()), key=repr) == plain_clusters(few)
    assert ball_tree.clusters(frame(spark, ODD)).collect() == []


def test_balls_store_what_they_hold_and_rule_centroids_out():
    x = np.floor(np.array([v for _, v, _ in points(600, 8, 4, 0.2)]) * 64).astype(np.int64)
    tree, order = ball_tree.Tree.built(x)
    assert (tree.points == x[order]).all() and tree.count[0] == 600
    for a, n, s, r in zip(tree.start, tree.count, tree.sums, tree.radius):
        own = tree.points[a : a + n]
        assert (own.sum(0) == s).all() and r == pytest.approx(np.sqrt(((own - s / n) ** 2).sum(1)).max())
    z = x[:1]
    for _ in range(5):  # far from each other
        z = np.concatenate([z, x[vectors.squared(x, z).min(1).argmax()][None, :]])
    owner, balls, theirs = tree.owners(z)
    assert (owner == vectors.squared(tree.points, z).argmin(1)).all()
    assert tree.count[balls].sum() > 300  # most vectors are assigned by whole balls
    assert (tree.totals(z) == vectors.totals(tree.points, owner, 6)).all()


def plain_codes(rows, scale=4096, parts=8):
    kept = [(i, whole(v, scale), l) for i, v, l in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    wide = 64 // parts
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    found = [lloyd([cut(v, p) for _, v, _ in kept], [cut(v, p) for _, v, _ in order], 6) for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for _, book in found for e in book for x in e).encode()).hexdigest()
    error = [sum(square(cut(v, p), found[p][1][found[p][0][n]]) for p in range(parts)) for n, (_, v, _) in enumerate(kept)]
    by = Counter()
    for e, (_, _, label) in zip(error, kept):
        by[label] += e
    cap = lambda x: min(x, vectors.MOST)
    return sorted(((i, "".join(f"{found[p][0][n]:02x}" for p in range(parts)), cap(error[n]), cap(by[l]), sha) for n, (i, _, l) in enumerate(kept)), key=repr)


@pytest.mark.parametrize("seed,hot", [(1, 0.3), (2, 0.9)])
def test_codes_equal_brute_force(spark, seed, hot):
    rows = points(200, 64, seed, hot) + [(5, [0.25] * 64, None), (5, [0.5] * 64, None), (None, [0.125] * 64, 1)]
    got = sorted(map(tuple, vector_codes.compressed(frame(spark, rows + ODD)).collect()), key=repr)
    assert got == plain_codes(rows)


def test_codes_of_large_components_and_few_or_no_vectors(spark):
    rows = points(12, 64) + [(30 + i, [float(x) for x in v], 1) for i, v in enumerate(np.random.default_rng(3).normal(0, 1e38, (12, 64)))]
    assert sorted(map(tuple, vector_codes.compressed(frame(spark, rows, DOUBLES)).collect()), key=repr) == plain_codes(rows)
    assert sorted(map(tuple, vector_codes.compressed(frame(spark, rows[:2], DOUBLES)).collect()), key=repr) == plain_codes(rows[:2])
    empty = vector_codes.compressed(frame(spark, ODD))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.collect() == []


def test_bounds_skip_most_distances_and_change_nothing():
    x = np.floor(np.array([v for _, v, _ in points(2000, 8, 6, 0.1)]) * 4096).astype(np.int64)
    entries = [x[:16].copy()]
    state = np.zeros((2000, 1), np.int64), np.full((2000, 1), np.inf), np.zeros((2000, 1, 16))
    taken = [vector_codes._assign(x, *state, entries)]
    for _ in range(5):
        old, entries = entries, [vectors.moved([int(v) for v in vectors.totals(x, state[0][:, 0], 16).ravel()], entries[0])]
        row = dict(zip(vector_codes._NAMES[2:7], (a[0].as_py() for a in vector_codes._state(None, None, x, *state, 0, old)[2:7])))
        (_, *state), compared = vector_codes._shifted(row, old, entries, 8)
        taken.append(compared)
        near = vectors.squared(x, entries[0])
        assert (state[0][:, 0] == near.argmin(1)).all()
        assert (state[1][:, 0] >= np.sqrt(near.min(1))).all() and (state[2][:, 0] <= np.sqrt(near) + 1e-9).all()
    assert taken[-1] < 2000 * 16 / 4, taken
    # Equal distances go to the lower index.
    entries = [np.array([[0, 2], [2, 0], [0, 0], [2, 2]])]
    state = np.full((1, 1), 3), np.full((1, 1), np.inf), np.zeros((1, 1, 4))
    vector_codes._assign(np.array([[1, 1]]), *state, entries)
    assert state[0][0, 0] == 0


# Urls


def plain_cut(run, counts, total):
    """All ways to cut a run, the cheapest, by the same costs."""
    opening, letter = max(0, round(1e6 * math.log(total / 10))), round(1e6 * math.log(10))
    cost = lambda w: round(1e6 * math.log(total / counts[w])) if w in counts and len(w) <= 24 else opening + letter * len(w)
    best = math.inf
    for cuts in range(1 << (len(run) - 1)):
        words, at = [], 0
        for i in range(len(run)):
            if i == len(run) - 1 or cuts >> i & 1:
                words.append(run[at : i + 1])
                at = i + 1
        best = min(best, sum(map(cost, words)))
    return best, cost


def test_runs_are_cut_at_the_least_cost(spark):
    random.seed(3)
    words = ["a", "b", "ab", "ba", "bab", "aab", "cab", "abba"]
    counts = {w: random.randint(1, 60) for w in words}
    runs = sorted({"".join(random.choice("abc") for _ in range(random.randint(1, 9))) for _ in range(60)} | {"a" * 12, "xyz", "abxyzab"})
    pieces = spark.createDataFrame([(r,) for r in runs] + [("#3",)], "piece string")
    got = {r.piece: r.words for r in url_filters.segmented(pieces, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got) == {*runs, "#3"} and got["#3"] == ["#3"] and got["xyz"] == ["xyz"]
    total = sum(counts.values())
    for run in runs:
        best, cost = plain_cut(run, counts, total)
        assert "".join(got[run]) == run and sum(map(cost, got[run])) == best, (run, got[run])


URLS = [
    ("https://Cheap-PILLS.example.com/en/1?x=/fr/", "com/", None), ("http://a.example.net/es/a%20b#/x", None, None), ("http://shop.example.org/en/buycheappills/12", None, None),
    ("//no.scheme/en", None, None), (None, None, None), ("://", None, None), ("x://h", None, None), ("x://h?q://z/en/", None, None), ("https://WWW.example.com/en/x", None, None), ("https://b.www.example.com/en/x", None, None),
    ("https://notexample.com/en/", None, None), ("http://net/fr/x", None, None), ("http://é.org/ü/\nz", None, None), ("h://" + "pills" * 3000 + ".org/" + "en/" * 5000, None, None),
]


def plain_verdicts(rows):
    words = Counter()
    low = lambda s: s.translate({c: c + 32 for c in range(65, 91)})
    run = re.compile(r"[a-z]+|[^\x00-\x7f]+")
    for _, _, html in rows:
        words.update(w for w in run.findall(low(re.sub("<[^>]*>", " ", html or ""))) if len(w) <= 24)
    total = max(1, sum(words.values()))
    opening, letter = max(0, round(1e6 * math.log(total / 10))), round(1e6 * math.log(10))

    def cut(piece):
        known = [(a, b, round(1e6 * math.log(total / words[piece[a:b]]))) for a in range(len(piece)) for b in range(a + 1, min(len(piece), a + 24) + 1) if piece[a:b] in words]
        return url_filters.split_run(piece, known, opening, letter)

    cuts, each = {}, []
    for page, url, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = low(host)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        found = []
        for field, text in (("h", host), ("p", low(path))):
            for x in re.findall(r"[a-z]+|[^\x00-\x7f]+|[0-9]+", text):
                if x not in cuts:
                    cuts[x] = [f"#{len(x)}"] if "0" <= x[0] <= "9" else cut(x)
                found += [(field, w) for w in cuts[x]]
        each.append((page, host, path, max(fits, default=None), found))
    seen = {v: Counter(t for *_, fit, found in each if fit and fit[2] == v for t in found) for v in ("allow", "block")}
    size = len(set(seen["allow"]) | set(seen["block"]))
    a, b = (sum(seen[v].values()) + size for v in ("allow", "block"))
    odds = lambda t: round(1e6 * math.log(((seen["block"][t] + 1) / b) / ((seen["allow"][t] + 1) / a))) if seen["allow"][t] + seen["block"][t] else 0
    out = []
    for page, host, path, fit, found in each:
        score = 0 if fit else sum(map(odds, found))
        out.append((page, host, path, fit and fit[1], fit[2] if fit else "block" if score > 0 else "allow", score))
    return sorted(out, key=repr)


def test_urls_are_judged_as_by_plain_code(spark):
    random.seed(4)
    html = ["<p>cheap pills and <b>free</b> bets", None, "", "PILLS pills en de buy fr é ü", "<a href='x'>ad tracks</a> " + "long" * 10]
    pages = [(i, u, random.choice(html)) for i, (u, _, _) in enumerate(URLS)]
    name = lambda: "".join(random.choice(["cheap", "pills", "free", "bets", "zzq", "-", "buy"]) for _ in range(random.randint(1, 4)))
    pages += [(100 + i, f"https://{random.choice(['www.', ''])}{name()}.{random.choice(['example.com', 'net', 'org'])}/{random.choice(['en', 'es', 'de'])}/{name()}/{random.randint(1, 2000)}", random.choice(html)) for i in range(200)]
    pages += pages[-5:] + [(None, "https://twice.org/", None)] * 2
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, piece string").repartition(3)
    got = url_filters.judged(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_verdicts(pages)
    assert len({r[4] for r in plain_verdicts(pages) if r[3] is None}) == 2
    assert url_filters.judged(df.limit(0)).collect() == []
