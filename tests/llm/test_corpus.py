"""Operators over whole tables: mixing, dedup, joins, and the pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import exact_dedup, graph, mixing, ngram_join, quality_knn, substring_dedup
from spanloom.llm.queries import piece_model

DOCS = "doc_id long, text string, source string, n long, key string, hub string"
SHA = lambda s: hashlib.sha256(s).hexdigest()
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "clash", "clash") for i, t in rows], DOCS).repartition(5)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "one two"), (5, "ONE two"), (6, "word " * 20_000), (7, "word " * 20_000), (8, "É é"), (9, "é é")]


# Mixing


def test_mix_meets_its_targets(spark):
    random.seed(1)
    rows = [(i, " ".join(["w"] * int(random.paretovariate(0.8))), random.choice("aaaaaabcde")) for i in range(3000)] + [(5000, None, None), (5001, "x y", None), (5002, "", "zero"), (5002, "", "zero")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, target string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    goals = {s: x[0].target for s, x in by.items()}
    assert sum(goals.values()) == pytest.approx(1.5 * total)
    for s, x in by.items():
        assert abs(sum(r.taken for r in x) - goals[s]) <= 2 * max(r.size for r in x) + 1e-6
        assert goals[s] <= 2 * x[0].source_size + 1e-9
    # Resharing what is over, step by step, ends at the same targets.
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: x[0].source_size for s, x in by.items()}
    want, rest, free = {s: 0.0 for s in names}, 1.5 * total, set(names)
    while rest > 1e-9 and free:
        part = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        rest = 0.0
        for s in list(free):
            want[s] += part[s]
            if want[s] >= 2 * size[s]:
                rest += want[s] - 2 * size[s]
                want[s] = 2.0 * size[s]
                free.discard(s)
    assert all(goals[s] == pytest.approx(want[s], abs=1e-6) for s in names)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.filter("false")).count() == 0 and mixing.mixed(docs.filter("false")).count() == 0


def test_mixed_samples_rows_one_by_one(spark):
    rows = [(7, "a b", "s"), (7, "a b", "s"), (7, "c d e", "s"), (None, "x", "s"), (None, "x", "s"), (None, None, None), (8, "y " * 40, "t")] * 9
    docs = spark.createDataFrame([(*r, k, 1, 2, 3) for k, r in enumerate(rows)], "doc_id long, text string, source string, mix_nth int, copies int, row int, part int").repartition(4)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = mixing.mixed(docs).collect()
    assert Counter((r.doc_id, r.source, len((r.text or "").split())) for r in got) == +want and got[0].asDict().keys() == set(docs.columns)
    assert max(Counter(r.mix_nth for r in got).values()) <= 2  # a row of its own each, with its own columns


def test_many_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('host', id % 1000) AS source", "repeat('w ', cast(1 + id % 17 AS INT)) AS text")
    goals = {r.source: (r.target, r.source_size) for r in mixing.mix(docs).collect()}
    total = sum(s for _, s in goals.values())
    assert len(goals) == 1000 and sum(t for t, _ in goals.values()) == pytest.approx(1.5 * total)
    level = max(t / (5, 2, 1)[i % 3] for i, (t, s) in enumerate(v for _, v in sorted(goals.items())))
    assert all(t == pytest.approx(min(2 * s, level * (5, 2, 1)[i % 3])) for i, (t, s) in enumerate(v for _, v in sorted(goals.items())))


# Exact dedup


def groups_slowly(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[(t or "").encode().translate(LOWER)].append(i)
    out, kept = [], set()
    for i, t in rows:
        body = (t or "").encode().translate(LOWER)
        ids = [x for x in by[body] if x is not None]
        keep = max(ids) if ids else None
        first = i == keep and body not in kept  # of equal ids one is kept
        if first:
            kept.add(body)
        out.append((i, keep, len(by[body]), first, SHA(body)))
    return sorted(out, key=repr)


TWINS = [(70, "twin"), (70, "twin"), (70, "TWIN"), (60, "twin"), (None, "nobody"), (None, "nobody"), (71, "other"), (71, "twin too"), (71, "twin too")]


@pytest.mark.parametrize("bucket_bytes, most", [(64, 4), (1 << 20, 20_000)])
def test_exact_dedup(spark, bucket_bytes, most, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_TASKS", most)
    random.seed(2)
    rows = ODD + TWINS + [(100 + i, "abc " * random.randint(0, 6) + random.choice(["x", "X", "y"])) for i in range(300)]
    got = exact_dedup.exact_dedup(frame(spark, rows), bucket_bytes=bucket_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == groups_slowly(rows)
    kept = exact_dedup.without_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((g[0] for g in groups_slowly(rows) if g[3]), key=repr)
    assert exact_dedup.exact_dedup(frame(spark, rows).filter("false")).count() == 0 and exact_dedup.without_copies(frame(spark, rows).filter("false")).count() == 0


def test_directory_doubles_where_keys_are_dense():
    weights = np.zeros(256, np.int64)
    weights[200] = 1000
    weights[:100] = 3
    index = exact_dedup.Directory.grown(weights, 100)
    assert index.depth == 8 and index.buckets == len(set(index.slots)) and list(index.slots) == sorted(index.slots)
    assert exact_dedup.Directory.grown(np.ones(4, np.int64), 100).buckets == 1
    assert index.bucket(-1) == index.buckets - 1 and index.bucket(0) == 0


@pytest.mark.parametrize("hot", [False, True])
def test_colliding_keys_are_told_apart(hot):
    import pyarrow as pa

    schema = exact_dedup.ENTRY.remove(0)
    columns = [[hot] * 3, [7, 7, 7], [b"s1", b"s2", b"s1"], [1, 2, 3], [1, 1, 2], [b"a", b"b", b"a"]]
    pages = [pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)]
    if hot:  # what an owner has left of it goes on with its text
        pages = [p for p in exact_dedup._pages(last=False)(iter(pages)) if p.num_rows]
        assert [(r["n"], r["body"], r["hot"]) for p in pages for r in p.to_pylist()] == [(3, b"a", True), (1, b"b", True)]
    (page,) = [p for p in exact_dedup._pages(last=hot)(iter(pages)) if p.num_rows]
    assert page.to_pylist() == [{"hot": False, "key": 7, "sha": b"s1", "keep_id": 3, "n": 3, "body": None}]


# Substring dedup


def removed_slowly(rows, least):
    seen, lists = Counter(), [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in lists:
        seen.update(tuple(w[s : s + least]) for s in range(len(w) - least + 1))
    out = []
    for i, w in lists:
        gone = set()
        for s in range(len(w) - least + 1):
            if seen[tuple(w[s : s + least])] > 1:
                gone.update(range(s, s + least))
        out.append((i, len(w), len(gone), SHA(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, seed", [(35, 8), (12, 4), (5, 5), (100, 8)])
def test_substring_dedup(spark, least, seed):
    random.seed(least)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [random.choice(words) for _ in range(n)]
    shared = [text(random.randint(least - 2, 3 * least)) for _ in range(6)]
    rows = list(ODD[:9])
    for i in range(120):
        x = text(random.randint(0, 80))
        for _ in range(random.randint(0, 2)):
            p, s = random.randint(0, len(x)), random.choice(shared)
            x[p:p] = s[random.randint(0, 3) : len(s) - random.randint(0, 3)]
        rows.append((100 + i, " ".join(x)))
    rows += rows[20:24] + [(900, "a b " * 60), (901, " ".join(["z"] * (least - 1)))]
    got = substring_dedup.substring_dedup(frame(spark, rows), least, seed).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == removed_slowly(rows, least)
    for r in got:
        assert sum(r.ranges[1::2]) - sum(r.ranges[::2]) == r.n_removed
    assert substring_dedup.substring_dedup(frame(spark, rows).filter("false"), least, seed).count() == 0


# N-gram join


def components_slowly(rows, words, numerator):
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= numerator * len(x | y):
                parent[top(a)] = top(b)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            lowest[top(k)] = min(lowest.get(top(k), i), i)
    return sorted(((i, len(s), lowest.get(top(k))) for k, (i, s) in enumerate(sets)), key=repr)


def edited(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(800)]
    rows = []
    for size in (3, 6, 12, 40, 120):
        for _ in range(3):
            base = [random.choice(words) for _ in range(size)]
            for k in range(14):
                x = list(base)
                for _ in range(random.randint(0, max(1, size // 18))):
                    x[random.randrange(size)] = random.choice(words)
                rows.append((len(rows) + 100, " ".join(x).upper() if k % 5 == 0 else " ".join(x)))
    return rows


@pytest.mark.parametrize("words, numerator, edit_cost", [(4, 85, 2), (5, 80, 2), (4, 85, 0)])
def test_ngram_join(spark, words, numerator, edit_cost, monkeypatch):
    monkeypatch.setattr(ngram_join, "EDIT_COST", edit_cost)
    rows = ODD + edited(words + numerator)
    got = ngram_join.ngram_join(frame(spark, rows), words, numerator)
    assert sorted(map(tuple, got.collect()), key=repr) == components_slowly(rows, words, numerator)


def test_ngram_join_of_nothing_and_of_copies(spark):
    rows = frame(spark, ODD + TWINS[:4])
    assert ngram_join.ngram_join(rows.filter("false")).count() == 0
    kept = ngram_join.one_of_each(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 8, 9, 60], key=repr)


@pytest.mark.parametrize("scheme", [(1, 2, 0, 0), (5, 6, 0, 0), (5, 10, 0, 2), (6, 4, 4, 0), (7, 9, 3, 2)])
def test_every_allocation_finds_what_it_promises(scheme):
    differ, m, doubled, left_out = scheme
    assert m + doubled >= differ + 1 + 2 * left_out
    plan = ngram_join.Plan({}, 300, 85)
    for name, value in (("differ", differ), ("m", m), ("doubled", doubled), ("left_out", left_out)):
        getattr(plan, name)[:] = value
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64))
        k = int(rng.integers(0, differ + 1))
        drop = int(rng.integers(0, k + 1))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 62, k - drop).astype(np.uint64)]))
        keys, owners = ngram_join.index_keys([base, other], plan)
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


def test_allocations_are_valid_and_sketches_bound():
    for differ in (0, 1, 2, 10, 50, 400):
        for sets in (1, 1000, 10**7, 10**10):
            s = ngram_join.allocated(differ, sets, 6.0 * max(differ, 1))
            assert s.segments + s.doubled >= differ + 1 + 2 * s.left_out or differ == 0
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[50:], rng.integers(0, 1 << 62, 300).astype(np.uint64)]))
    x, y = ngram_join.sketch(a).view(np.uint64), ngram_join.sketch(b).view(np.uint64)
    y = y[: len(y) // 2] ^ y[len(y) // 2 :] if len(y) > len(x) else y
    assert 200 < int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_long_entries_are_salted_but_stay_connected():
    keys, owners = np.array([4096] * 10 + [8192] * 2, np.uint64), np.arange(12)
    k, o = ngram_join.gathered(keys, owners, 5)
    assert sorted(zip(k.tolist(), o.tolist())) == sorted([(4096 | 5, i) for i in range(10)] + [(4096, 0), (8192, 10), (8192, 11)])


def test_passes_of_the_join_take_little_memory():
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(1500)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], names=["doc_id", "text", "text_key"])
    every = SimpleNamespace(may_have=lambda key: True)
    for run, given, most in ((ngram_join._sets(5, 80), batch, 43), (ngram_join._grams(5, every), batch.select(["text"]), 37)):  # MB; 51 and 41 with pieces of 2 MB
        tracemalloc.start()
        assert sum(x.num_rows for x in run(iter([given]))) == len(texts)
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < most, (peak, most)


def test_index_comes_in_small_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(7)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(1000)]
    sizes = [x.num_rows for x in ngram_join._index(5, ngram_join.Plan({i: 1000 for i in range(40)}, 1000, 80))(iter([pa.record_batch([pa.array(texts)], names=["text"])]))]
    assert sum(sizes) > 2 * max(sizes) and max(sizes) <= 1 << 16


def test_index_has_partitions_for_its_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in range(1, 400)]
    for numerator in (80, 85):
        edges = np.array(ngram_join.band_edges(400, numerator))
        counts = Counter((np.searchsorted(edges, [len(x) for x in sets], side="right") - 1).tolist())
        plan = ngram_join.Plan(counts, 399, numerator)
        made = len(ngram_join.index_keys(sets, plan)[0])
        assert made / 1.5 < plan.rows(counts) < made * 1.5
    entries, session = spark.createDataFrame([], "entry long, id long"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ngram_join._dealt(entries, (session + 3) * ngram_join.INDEX_ROWS).rdd.getNumPartitions() == session + 3
    assert ngram_join._dealt(entries, ngram_join.INDEX_ROWS).rdd.getNumPartitions() == entries.rdd.getNumPartitions()
    monkeypatch.setattr(ngram_join, "INDEX_ROWS", 20)
    rows = ODD + edited(3)
    assert sorted(map(tuple, ngram_join.ngram_join(frame(spark, rows)).collect()), key=repr) == components_slowly(rows, 4, 85)


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {}
    top = lambda x: x if parent.setdefault(x, x) == x else top(parent[x])
    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    quality, exact, near, mix, ids = kept
    assert set(exact) == {g[0] for g in groups_slowly([(i, rows[i]) for i in quality]) if g[3]}
    assert set(near) == {i for i, _, c in components_slowly([(i, rows[i]) for i in exact], 5, 80) if i == c}
    assert set(mix) <= set(near) and max(Counter(mix).values()) <= 2 and Counter(ids) == Counter(mix)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(ids)




def test_pipeline_keeps_and_encodes_what_plain_code_does(spark):
    import sentencepiece

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality_knn.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = set()
    for i, r in rows.items():
        v = quality_knn.features((r.text or "").encode()) @ model.project
        cosines = model.vectors @ (v / max(np.linalg.norm(v), 1e-12))
        near = sorted(range(len(cosines)), key=lambda n: -cosines[n])[: quality_knn.NEIGHBOURS]
        weights = [max(float(cosines[n]), 1e-6) ** quality_knn.POWER for n in near]
        if sum(w * model.labels[n] for w, n in zip(weights, near)) / sum(weights) >= quality_knn.THRESHOLD:
            want.add(i)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    quality, _, near_ids, mix = kept
    assert 0 < len(want) < len(rows) and set(quality) == want and len(quality) == len(want)
    goals = {r.source: r.target for r in mixing.mix(spark.createDataFrame([rows[i] for i in near_ids])).collect()}
    by, copies = defaultdict(list), Counter()
    for i in near_ids:
        tie = hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()
        by[rows[i].source].append((len(re.findall("[^\x20\x09-\x0d]+", rows[i].text or "")), tie, i))
    for source, own in by.items():
        total, off = sum(x[0] for x in own), mixing.offset(mixing.SEED)
        rate = goals[source] / total if total else 0.0
        for k, (_, _, i) in enumerate(sorted(own), 1):
            copies[i] += min(math.floor(k * rate + off) - math.floor((k - 1) * rate + off), math.ceil(rate))
    assert Counter(mix) == +copies
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {i: library.encode(rows[i].text or "") for i in set(mix)}
    plain = [(i, len(ids[i]), digest(",".join(map(str, ids[i]))), digest(library.decode(ids[i]))) for i in mix]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(plain)


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    texts = [None, "", " \n", "a b", "A B", *(f"one two three four five six seven eight nine {w}" for w in "aab"), *("some quite ordinary words of prose come here " + w for w in "xyz")]
    clash = "row long, nth long, _id string, text_key string, id long, kept string, size long"
    rows = [(i, t, None if i % 3 else "en", (None, "s", "t")[i % 3], None, 1, 2, "x", "y", 3, "z", 4) for i, t in enumerate(texts)]
    rows += rows[:4] + [(None, "a b", None, None, *[None] * 8), (7, texts[3], "en", "s", *[None] * 8)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(8)] + [(None, 1, 1), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "odd/documents.parquet"))
    labels.write.parquet(str(tmp_path / "odd/labels.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path / "odd"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
            after.write.parquet(str(tmp_path / name.replace(" ", "-")))
            before = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    left = [r.doc_id for r in before.collect()]
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(map(repr, left)) == sorted(repr(r.doc_id) for r in got)
    near = [r.text for r in before.select("text").distinct().collect()]
    assert len({(t or "").lower() for t in near}) == len(near)  # no two equal texts are left
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    none = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert none.collect() == [] and "doc_id" in none.columns
