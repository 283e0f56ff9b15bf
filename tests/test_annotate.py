import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq
from spanloom.operators import concordance, seed_join
from spanloom.plans import annotate
from spanloom.plans.records import COLUMNS
from spanloom.sources import seqfiles, sinks
from spanloom.streaming.annotate import annotate_stream

random.seed(7)


def coding(n):
    return "".join(random.choice([c for c in sq.codon_table() if sq.codon_table()[c] != "*"]) for _ in range(n))


V = coding(30) + "TGTGCGAGAGAT"  # regions of 24, 12, 21, 12 and 24 bases, the last codon of FR3 the cysteine; then CDR3 begins
J = "TGGGGC" + coding(8)
D = "ACGGTATTACGATTGG"
CDR3 = "GCG"


@pytest.fixture(scope="module")
def reference(spark):
    v = spark.createDataFrame([("IGH", "IGHV1*01", V), ("IGK", "IGKV1*01", coding(34))], "locus string, allele string, sequence string")
    j = spark.createDataFrame([("IGH", "IGHJ1*01", "CC" + J), ("IGK", "IGKJ1*01", "AC" + J[:6] + coding(8))], "locus string, allele string, sequence string")
    bounds = {"fwr1": (1, 24), "cdr1": (25, 36), "fwr2": (37, 57), "cdr2": (58, 69), "fwr3": (70, 93)}
    v_regions = v.select("allele", *(F.lit(x).alias(f"{r}_{n}") for r, b in bounds.items() for n, x in zip(("start", "end"), b)))
    j_regions = j.select("allele", F.lit(3).alias("fwr4_offset"))
    frames = j.select("allele", F.lit(1).alias("frame"))
    d = spark.createDataFrame([("IGH", "IGHD1*01", D)], "locus string, allele string, sequence string")
    return annotate.build_reference(v, j, v_regions, j_regions, frames, d)


def run(spark, reference, reads, **options):
    return annotate.annotate_sequences(spark, reads, reference, annotate.Options(**options))


def test_in_frame_read(spark, reference):
    middle = CDR3 + D + "A"
    read = V + middle + "CC" + "A" * ((3 - (len(middle) + 2) % 3) % 3) + J
    (r,) = run(spark, reference, [("r1", read)])
    assert tuple(r) == COLUMNS and r["sequence_id"] == "r1" and r["locus"] == "IGH" and r["v_call"] == "IGHV1*01" and r["j_call"] == "IGHJ1*01"
    assert (r["fwr1_start"], r["fwr1_end"], r["fwr3_end"], r["cdr3_start"]) == ("1", "24", "93", "94")
    assert int(r["cdr3_end"]) == int(r["fwr4_start"]) - 1 and r["rev_comp"] == "F"
    assert r["junction_aa"].startswith("C") and r["junction_aa"].endswith("W") and r["cdr3_aa"] == r["junction_aa"][1:-1]
    assert r["d_call"] == "IGHD1*01" and read[int(r["d_sequence_start"]) - 1 : int(r["d_sequence_end"])].find(D[2:14]) >= 0
    for region in sq.REGIONS:
        assert read[int(r[f"{region}_start"]) - 1 : int(r[f"{region}_end"])] == r[region]


def test_strand_misses_and_switches(spark, reference):
    read = V + CDR3 + D + "ACCAA" + J
    back = annotate.reverse_complement(read)
    a, b, miss, empty = run(spark, reference, [("a", read), ("b", back), ("miss", "ACGT" * 20), ("empty", "")])
    assert b["rev_comp"] == "T" and {k: v for k, v in a.items() if k not in ("sequence_id", "rev_comp")} == {k: v for k, v in b.items() if k not in ("sequence_id", "rev_comp")}
    assert set(v for k, v in miss.items() if k not in ("sequence_id", "sequence")) == {""} and set(empty.values()) == {"empty", ""}
    (off,) = run(spark, reference, [("a", read)], map_d=False)
    assert off["d_call"] == "" and off["v_call"] == a["v_call"]
    (forward,) = run(spark, reference, [("b", back)], both_strands=False)
    assert forward["v_call"] == ""
    with pytest.raises(ValueError):
        run(spark, reference, ["ACGT"], seqtype="xx")


def test_out_of_frame_and_parts(spark, reference):
    shift = V + CDR3 + D + "AC" + "CC" + J
    length = (len(CDR3 + D) + 4) % 3
    (r, v_only, j_only) = run(spark, reference, [shift if length else shift[: len(V)] + "A" + shift[len(V) :], V[:80], J])
    assert "_" in r["junction_aa"] and r["productive"] == "F" and r["sequence_id"] == "seq0"
    assert v_only["fwr1"] and v_only["fwr4"] == "" and v_only["junction"] == ""
    assert j_only["fwr1"] == ""


def test_files_and_stream(spark, reference, tmp_path):
    reads = [(f"r{i}", V + CDR3 + D + "ACC" + J) for i in range(5)]
    frame = seqfiles.from_sequences(spark, reads)
    sinks.write_fasta(frame.coalesce(1), str(tmp_path / "in"))
    annotate.write_reference(reference, str(tmp_path / "ref"))
    again = annotate.Reference.load(spark, str(tmp_path / "ref"))
    annotate.annotate_path(spark, str(tmp_path / "in"), str(tmp_path / "out"), again)
    rows = seqfiles.read_airr(spark, str(tmp_path / "out"))
    assert tuple(rows.columns) == COLUMNS and sorted(r.sequence_id for r in rows.collect()) == [r for r, _ in reads]
    query = annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "live"), str(tmp_path / "state"), again)
    query.awaitTermination()
    live = seqfiles.read_airr(spark, str(tmp_path / "live" / "*"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(FileNotFoundError):
        annotate.Reference.load(spark, str(tmp_path / "nothing"))


def test_stream_reads_files_as_batches_do(spark, reference, tmp_path):
    import gzip

    read = V + CDR3 + D + "ACC" + J
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(f"\n \n>r1 more\n{read[:50]}\n{read[50:]}\n>r2\nACGT\n")
    (tmp_path / "in" / "b.fastq").write_text(f"@r3\n{read}\n+\n{'@' * len(read)}\nbroken\nAA\n+\nII\n")
    (tmp_path / "in" / "empty.fasta").write_text("\n")
    with gzip.open(tmp_path / "in" / "c.fasta.gz", "wt") as f:
        f.write(f">r4\n{read}\n")
    start = lambda: annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "live"), str(tmp_path / "state"), reference, files=2).awaitTermination()
    rows = lambda: sorted((r.sequence_id, r.v_call) for r in seqfiles.read_airr(spark, str(tmp_path / "live" / "*")).collect())
    start()
    assert rows() == [("r1", "IGHV1*01"), ("r2", None), ("r3", "IGHV1*01"), ("r4", "IGHV1*01")]
    (tmp_path / "in" / "d.fasta").write_text(">r5\nACGT\n")
    start()  # goes on with what is new
    assert [i for i, _ in rows()] == ["r1", "r2", "r3", "r4", "r5"]


def test_tables_keep_quotation_marks(spark, tmp_path):
    rows = spark.createDataFrame([('"a"', "b"), ('c"d', '"e"'), ("x", '"')], "p string, q string")
    sinks.write_airr(rows, str(tmp_path / "out_0"), 1)
    sinks.write_airr(rows.filter("p = 'x'"), str(tmp_path / "out_1"), 1)
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, seqfiles.read_airr(spark, str(tmp_path / "out_0")).collect())) == want
    sinks.merge(spark, str(tmp_path / "out_*"), str(tmp_path / "all"))
    sinks.merge(spark, str(tmp_path / "out_*"), str(tmp_path / "one"), 1)
    for name in ("all", "one"):
        assert sorted(map(tuple, seqfiles.read_airr(spark, str(tmp_path / name)).collect())) == sorted([*want, ("x", '"')])
    assert len(list((tmp_path / "one").glob("part-*"))) == 1


def test_reference_files_and_index(spark, reference, tmp_path, monkeypatch):
    built = reference.ready().scaffolds.selectExpr("scaffold_id", "locus", "array(v_call) AS v_calls", "array(j_call) AS j_calls", "0 AS n_pad")
    extra = spark.createDataFrame([("IGH_9", "IGH", ["V"], ["J"], 3)], built.schema)
    folder = str(tmp_path / "human")
    annotate.write_reference(reference, folder, built.unionByName(extra))
    annotate.write_reference(annotate.protein_reference(reference), folder)
    assert {(r.locus, r.n_scaffolds, r.n_annotated, r.n_dropped) for r in seqfiles.read_airr(spark, folder + "/build_log.tsv").collect()} == {("IGH", "2", "1", "1"), ("IGK", "1", "1", "0")}
    assert seqfiles.read_airr(spark, folder + "/combinations.tsv").count() == 3
    row = seqfiles.read_airr(spark, folder + "/markup.tsv").filter("locus = 'IGH'").first()
    assert row.junction_aa[0] == "C" and row.junction[-3:] == "TGG" and row.fwr1 == V[:24]
    assert annotate.build_index(spark, [folder, str(tmp_path / "none")]) == [(folder, "nt"), (folder, "aa")]
    assert annotate.build_index(spark, [folder]) == [] and annotate.build_index(spark, [folder], force=True) == [(folder, "nt"), (folder, "aa")]
    read = V + CDR3 + D + "ACC" + J
    loaded = annotate.Reference.load(spark, folder)
    assert loaded.stored and run(spark, loaded, [read]) == run(spark, reference, [read])
    # Postings on disk: joined where they are, by another session too, with the same result as the index in memory.
    monkeypatch.setattr(annotate, "BROADCAST_RESIDUES", 0)
    spark.sql(f"DROP TABLE {loaded.postings[1]._jdf.queryExecution().analyzed().collectLeaves().head().catalogTable().get().identifier().table()}")
    loaded = annotate.Reference.load(spark, folder)
    mutated = [("r", read[:40] + "A" + read[42:]), ("s", annotate.reverse_complement(read)), ("none", "ACGT" * 20)]
    assert run(spark, loaded, mutated) == run(spark, reference, mutated)
    queries = spark.createDataFrame([(1, read)], "query long, sequence string")
    found = seed_join.shared_seeds(queries, None, annotate.Options().scores(), loaded.postings[1].hint("merge"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.rindex("Exchange hashpartitioning") :]
    assert plan.count("Exchange hashpartitioning") == 1 and "t_seed" not in side.split("\n")[0] and "Bucketed: true" in plan, plan
    assert found.count() > 300
    monkeypatch.undo()
    (r,) = annotate.annotate_sequences(spark, [("p", protein(read))], annotate.Reference.load(spark, folder, "aa"))
    assert r["locus"] == "IGH" and r["fwr1_aa"] == protein(V[:24]) and r["junction"][0] == "C" and r["productive"] == "T" and r["d_call"] == ""
    (stop,) = annotate.annotate_sequences(spark, [("p", protein(read)[:40] + "*" + protein(read)[41:])], annotate.Reference.load(spark, folder, "aa"))
    assert stop["productive"] == "F"


def protein(nt):
    return "".join(sq.codon_table()[nt[i : i + 3]] for i in range(0, len(nt) - 2, 3))


def test_command_line(spark, tmp_path, capsys):
    from spanloom import cli

    with pytest.raises(SystemExit):
        cli.parser().parse_args([])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["annotate", "in", "out"])  # a reference is required
    fasta = lambda name, rows: (tmp_path / name).write_text("".join(f">{n}\n{s}\n" for n, s in rows)) and str(tmp_path / name)
    v, j = fasta("v.fa", [("IGH|IGHV1*01", V)]), fasta("j.fa", [("IGH|IGHJ1*01", "CC" + J)])
    d, reads = fasta("d.fa", [("IGH|IGHD1*01", D)]), fasta("reads.fa", [("r1", V + CDR3 + D + "ACC" + J), ("r2", "ACGT" * 20)])
    bounds = (1, 24, 25, 36, 37, 57, 58, 69, 70, 93)
    (tmp_path / "v.tsv").write_text("allele\t" + "\t".join(f"{r}_{x}" for r in sq.REGIONS[:5] for x in ("start", "end")) + "\nIGHV1*01\t" + "\t".join(map(str, bounds)) + "\n")
    (tmp_path / "j.tsv").write_text("allele\tfwr4_offset\nIGHJ1*01\t3\n")
    (tmp_path / "frames").write_text("# frames\nIGHJ1*01 1 JH\n")
    ref, out = str(tmp_path / "ref"), str(tmp_path / "out")
    call = lambda *a: cli.main(list(map(str, a)))
    call("info")
    call("build-db", v, j, tmp_path / "v.tsv", tmp_path / "j.tsv", ref, "--d", d, "--frames", tmp_path / "frames")
    call("build-index", ref)
    assert f"{ref} nt" in capsys.readouterr().out
    call("annotate", reads, out, "--reference", ref)
    got = {r.sequence_id: r for r in seqfiles.read_airr(spark, out).collect()}
    assert got["r1"].v_call == "IGHV1*01" and got["r1"].d_call == "IGHD1*01" and got["r2"].v_call is None
    call("annotate", reads, out + "2", "--reference", ref, "--no-d", "--forward-only")
    assert {r.d_call for r in seqfiles.read_airr(spark, out + "2").collect()} == {None}
    call("split", reads, out + "_shards", "-n", 2)
    assert seqfiles.read_fasta(spark, out + "_shards/*").count() == 2
    call("merge", out + "*/part-*", out + "_merged")
    assert seqfiles.read_airr(spark, out + "_merged").count() == 4
    with pytest.raises(FileNotFoundError):
        call("annotate", reads, out + "3", "--reference", tmp_path / "nothing")


def test_hits_of_another_aligner(spark, reference, tmp_path):
    read = V + CDR3 + D + "ACC" + J
    target = next(r for r in reference.ready().scaffolds.collect() if r.locus == "IGH")
    n = len(V) - 10
    line = lambda q, t, a, b, bits: "\t".join(map(str, [q, t, a, b, 1, n, len(read), len(target.sequence), n, 0, 0, f"{n}M", V[:n], V[:n], "1e-9", bits, 100.0]))
    (tmp_path / "hits.tsv").write_text("\n".join([line("r", target.scaffold_id, 1, n, 200), line("r", "other", 1, n, "n/a"), line("back", target.scaffold_id, len(read), len(read) - n + 1, 150), line("lost", "other", 1, n, 90)]) + "\n")
    (tmp_path / "none.tsv").write_text("")
    reads = seqfiles.from_sequences(spark, [("r", read), ("back", annotate.reverse_complement(read)), ("lost", read), ("r", read)])
    got = annotate.from_hits(reads, seqfiles.read_hits(spark, str(tmp_path / "hits.tsv")), reference).orderBy("rid").collect()
    assert [r.locus for r in got] == ["IGH", "IGH", None, "IGH"] and [r.rev_comp for r in got] == [False, True, None, False]
    assert {r.sequence for r in got} == {read} and {r.fwr2 for r in got} == {V[36:57], None} and got[0].aln_score == 200.0
    assert {r.v_call for r in annotate.from_hits(reads, seqfiles.read_hits(spark, str(tmp_path / "none.tsv")), reference).collect()} == {None}


def test_concordance_with_itself(spark, reference):
    rows = annotate.annotate(seqfiles.from_sequences(spark, [V + CDR3 + D + "ACC" + J] * 3), reference)
    for r in concordance.regions(rows, rows).collect():
        assert r.compared == r.agree


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("junk\n>id1 more words\nACGT\n\nAC\n>id2\r\nGG\r\n>id3\n")
    got = [(r.read_id, r.sequence) for r in seqfiles.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("rid").collect()]
    assert got == [("id1", "ACGTAC"), ("id2", "GG"), ("id3", "")]
    (tmp_path / "b.fastq").write_text("@r1 x\nACGT\n+\n@@@@\n@r2\nGG\n+\nII\nbroken\nAA\n+\nII\n")
    assert [(r.read_id, r.sequence) for r in seqfiles.read_sequences(spark, str(tmp_path / "b.fastq")).orderBy("rid").collect()] == [("r1", "ACGT"), ("r2", "GG")]
    import gzip

    with gzip.open(tmp_path / "c.fasta.gz", "wt") as f:
        f.write(">z\nAC\n")
    assert [(r.read_id, r.sequence) for r in seqfiles.read_sequences(spark, str(tmp_path / "c.fasta.gz")).collect()] == [("z", "AC")]
    for text in ("", "\n\n", "hello\n"):
        (tmp_path / "d.txt").write_text(text)
        with pytest.raises(ValueError):
            seqfiles.sniff(spark, str(tmp_path / "d.txt"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"r{i}", "ACGT") for i in range(10)], "rid long, read_id string, sequence string")
    sizes = sorted(r["count"] for r in sinks.sharded(rows, 3).groupBy("shard").count().collect())
    assert sizes == [3, 3, 4]
    with pytest.raises(ValueError):
        sinks.sharded(rows, 0)
    empty = rows.filter("rid < 0").select("read_id", "sequence")
    sinks.write_airr(empty, str(tmp_path / "empty"), 1)
    assert (next((tmp_path / "empty").glob("part-*"))).read_text() == "read_id\tsequence\n"
    with pytest.raises(FileNotFoundError):
        sinks.merge(spark, str(tmp_path / "none_*"), str(tmp_path / "m"))
    values = spark.createDataFrame([(1e-30,), (0.5,), (100.0,), (1.5e-7,), (12345678.0,), (1e16,)], "x double")
    assert [r.x for r in sinks.rendered(values).collect()] == [str(v) for v in (1e-30, 0.5, 100.0, 1.5e-7, 12345678.0, 1e16)]


def scaffold_rows(spark, rows):
    """A reference of scaffold id, V, J and call, with regions as V has them."""
    starts, ends = [1, 25, 37, 58, 70, 94, 100], [24, 36, 57, 69, 93, 99, 104]
    rows = [(i, "IGH", call, "J" + i, v + j, starts, ends, len(v), len(v) + 1) for i, v, j, call in rows]
    return annotate.Reference(spark.createDataFrame(rows, "scaffold_id string, locus string, v_call string, j_call string, sequence string, starts array<int>, ends array<int>, v_sequence_end int, j_sequence_start int"))


def test_targets_that_seeds_do_not_tell_apart_are_all_aligned(spark):
    r = random.Random(11)
    js = sorted({"".join(r.choice("ACGT") for _ in range(10)) for _ in range(120)}, key=lambda _: r.random())
    own = scaffold_rows(spark, [(f"s{i:03d}", V, "N" + j, "V") for i, j in enumerate(js)])
    wanted = [3, 40, 77, 119]
    got = run(spark, own, [V + "A" + js[i] for i in wanted] + [annotate.reverse_complement(V + "A" + js[i]) for i in wanted])
    assert [x["j_call"] for x in got] == [f"Js{i:03d}" for i in wanted] * 2
    assert {x["rev_comp"] for x in got[:4]} == {"F"} and {x["rev_comp"] for x in got[4:]} == {"T"}


def kernel(rows, options):
    """Targets of a reference for the kernel alone."""
    from spanloom.operators import aligner

    index = aligner.Index([r[0] for r in rows], [r[4] for r in rows], options.scores())
    return annotate.Targets(index, [r[4] for r in rows], [(r[1], r[2], r[3], *r[5:]) for r in rows])


def test_best_scores_are_those_of_all_pairs_and_long_reads_are_bounded():
    import tracemalloc

    r = random.Random(13)
    nt = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    swap = lambda x, k: "".join(r.choice("ACGT") if i in at else c for at in [set(r.sample(range(len(x)), k))] for i, c in enumerate(x))
    v, j = nt(96), nt(32)
    vs, js = [swap(v, r.randint(0, 6)) for _ in range(20)], [swap(j, r.randint(0, 5)) for _ in range(10)]
    starts, ends = [1, 25, 37, 58, 70, 94, 100], [24, 36, 57, 69, 93, 99, 104]
    rows = [(f"s{i:02d}{k}", "IGH", f"V{i}", f"J{k}", a + "N" * 9 + b, starts, ends, 96, 106) for i, a in enumerate(vs) for k, b in enumerate(js)]
    mutated = lambda x, rate: "".join(c if r.random() > rate else r.choice(["", "A", "C", "G", "T", c + "AC"]) for c in x)
    reads = [{"rid": i, "read_id": str(i), "sequence": mutated(r.choice(vs) + nt(r.randint(0, 25)) + r.choice(js), r.choice((0.01, 0.04, 0.1)))} for i in range(500)]
    near, every = annotate.Options(both_strands=False), annotate.Options(both_strands=False, sensitivity="exact")
    got, want = ([x.get("score", 0) for x in annotate.placed(kernel(rows, o), o, reads)] for o in (near, every))
    assert sum(a == b for a, b in zip(got, want)) >= 0.99 * len(reads) and all(a <= b for a, b in zip(got, want))
    long = [*reads[:100], {"rid": 999, "read_id": "long", "sequence": nt(4_000) + vs[0] + nt(12) + js[0] + nt(6_000)}]
    targets = kernel([*rows, ("zz", "IGH", "V", "J", nt(5_000), starts, ends, 96, 106)], near)
    tracemalloc.start()
    out = annotate.placed(targets, annotate.Options(), long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.get("score", 0) for x in out[:100]] == got[:100] and out[-1]["qstart"] in range(3_990, 4_011) and out[-1]["v_call"]
    assert peak < 300 << 20


def test_both_searches_agree_on_mutated_and_borderline_reads(spark, monkeypatch):
    r = random.Random(12)
    nt = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    vs, js = [nt(100) for _ in range(12)], [nt(30) for _ in range(8)]
    own = scaffold_rows(spark, [(f"s{i:02d}{k}", v, "N" * 9 + j, f"V{i}") for i, v in enumerate(vs) for k, j in enumerate(js)])
    mutated = lambda x, rate: "".join(c if r.random() > rate else r.choice(["", "A", "C", "G", "T", "N", c + "AC"]) for c in x)
    reads = [mutated(r.choice(vs) + nt(r.randint(0, 30)) + r.choice(js), r.choice((0.02, 0.08, 0.15))) for _ in range(120)]
    reads += [nt(40) + r.choice(vs)[k : k + n] + nt(40) for n in range(11, 27) for k in (0, 30, 60)]  # about the threshold
    reads = [x if r.random() < 0.5 else annotate.reverse_complement(x) for x in reads] + ["", "N" * 50, nt(80)]
    frame = seqfiles.from_sequences(spark, reads)
    want = annotate.annotate(frame, own).orderBy("rid").collect()
    monkeypatch.setattr(annotate, "BROADCAST_RESIDUES", 0)
    got = annotate.annotate(frame, own).orderBy("rid").collect()
    assert got == want
    hits = [x.aln_evalue is not None for x in want[120:168]]
    assert 5 < sum(hits) < 43 and sum(x.aln_evalue is not None for x in want[:120]) > 100
    # The exact search, with all scaffolds at once and in blocks.
    exact = annotate.Options(sensitivity="exact")
    some = frame.filter("rid % 4 = 0 OR rid > 165")
    parted = annotate.annotate(some, own, exact).orderBy("rid").collect()
    monkeypatch.setattr(annotate, "BROADCAST_RESIDUES", 4000)
    blocks = annotate.annotate(some, own, exact).orderBy("rid").collect()
    monkeypatch.setattr(annotate, "BROADCAST_RESIDUES", 8_000_000)
    whole = annotate.annotate(some, own, exact).orderBy("rid").collect()
    assert parted == whole and blocks == whole
    found = {r.rid: r.aln_score or 0 for r in want}
    assert all((r.aln_score or 0) >= found[r.rid] for r in whole)


@pytest.mark.parametrize("length,share", [(60, 0.12), (96, 0.2)])
def test_seeds_find_what_the_exact_search_finds(length, share):
    r = random.Random(21)
    nt = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    other = {c: [x for x in "ACGT" if x != c] for c in "ACGT"}
    vs, js = [nt(96) for _ in range(25)], [nt(32) for _ in range(6)]
    starts, ends = [1, 25, 37, 58, 70, 94, 100], [24, 36, 57, 69, 93, 99, 104]
    rows = [(f"s{i:02d}{k}", "IGH", f"V{i}", f"J{k}", a + "N" * 9 + b, starts, ends, 96, 106) for i, a in enumerate(vs) for k, b in enumerate(js)]
    reads = []
    for i in range(300):
        whole = r.choice(vs) + nt(9) + r.choice(js)
        at = r.randrange(len(whole) - length + 1) if length == 60 else 0
        x = "".join(r.choice(other[c]) if r.random() < share else c for c in whole[at : at + length])
        x = x[: length // 2] + "ACG" + x[length // 2 :] if i % 4 == 0 else x
        reads.append({"rid": i, "read_id": str(i), "sequence": x if i % 2 else annotate.reverse_complement(x)})
    found = {}
    for name in ("fast", "normal", "exact"):
        options = annotate.Options(sensitivity=name)
        found[name] = [x.get("score") or 0 for x in annotate.placed(kernel(rows, options), options, reads)]
    hits = sum(x > 0 for x in found["exact"])
    assert hits > 270 and sum(x > 0 for x in found["normal"]) >= 0.99 * hits
    assert sum(a == b > 0 for a, b in zip(found["normal"], found["exact"])) >= 0.99 * hits
    assert all(a <= b for name in ("fast", "normal") for a, b in zip(found[name], found["exact"]))


def test_folders_of_both_kinds_and_splits(spark, tmp_path, monkeypatch):
    import gzip

    r = random.Random(5)
    folder = tmp_path / "mixed files"
    folder.mkdir()
    read = lambda: "".join(r.choice("ACGT") for _ in range(r.randint(0, 60)))
    quality = lambda n: "".join(r.choice("@>+I") for _ in range(n))
    fasta = [(f"a{i}", read()) for i in range(300)]
    fastq = [(f"q{i}", read()) for i in range(400)]
    (folder / "b.fasta").write_text("".join(f">{n} x\n{s[:20]}\n{s[20:]}\n" for n, s in fasta))
    (folder / "a.fastq").write_text("".join(f"@{n} x\n{s}\n+{n * (i % 2)}\n{quality(len(s))}\n" for i, (n, s) in enumerate(fastq)))
    (folder / "c[1].txt").write_text("\n\n>z last\r\nAC\r\nGT\r\n")
    (folder / "d.fasta").write_text("\n")
    with gzip.open(folder / "c.gz", "wt") as f:
        f.write("@g1\nACGT\n+\n@@@@\n@g2 x\r\nGG\r\n+\r\n@I")
    want = fastq + [("g1", "ACGT"), ("g2", "GG"), ("z", "ACGT")]
    want[400:400] = fasta
    for size in ("100b", "1k", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "1k" else "4m")
        rows = seqfiles.read_sequences(spark, str(folder))
        found = rows.collect()
        assert len({x.rid for x in found}) == len(found)
        # gzipped by its suffix only: c.gz comes before c[1].txt
        assert [(x.read_id, x.sequence) for x in sorted(found, key=lambda x: x.rid)] == want, size
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "SinglePartition" not in plan
        one = seqfiles.read_fastq(spark, str(folder / "a.fastq"))
        assert [(x.read_id, x.sequence) for x in one.orderBy("rid").collect()] == fastq
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)
    (folder / "e.txt").write_text("hello\n")
    with pytest.raises(ValueError, match="e.txt"):
        seqfiles.read_sequences(spark, str(folder))
    with pytest.raises(ValueError):
        seqfiles.read_sequences(spark, str(folder / "d.fasta"))


def test_long_calls_stay_out_of_the_search(spark, monkeypatch):
    r = random.Random(21)
    nt = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    vs, js = [nt(100) for _ in range(5)], [nt(30) for _ in range(3)]
    rows = [(f"s{i}{k}", v, "N" * 9 + j, None if i == 4 else ",".join(f"V{i}*{n}" for n in range(200))) for i, v in enumerate(vs) for k, j in enumerate(js)]
    reads = [v + nt(9) + j for v in vs for j in js] + [nt(80), ""]
    frame, own = seqfiles.from_sequences(spark, reads), scaffold_rows(spark, rows)
    want = annotate.annotate(frame, own).orderBy("rid").collect()
    assert [x.v_call for x in want] == [row[3] for row in rows] + [None, None] and [x.j_call for x in want[:-2]] == [f"Js{i}{k}" for i in range(5) for k in range(3)]
    (held,) = own._known.values()
    assert all(x[1] is None and x[2] is None for x in held.value.rows)
    monkeypatch.setattr(annotate, "CALLS", 0)
    for most in (1 << 20, 0):  # the different calls broadcast, and joined
        monkeypatch.setattr(annotate, "DIFFERENT_CALLS", most)
        assert annotate.annotate(frame, scaffold_rows(spark, rows)).orderBy("rid").collect() == want


def test_of_equal_alignments_a_gap_goes_between_v_and_j():
    """What repeats the end of V, or the start of J, after it is no insertion into V or J."""
    r = random.Random(4)
    v, j = "".join(r.choice("ACGT") for _ in range(84)) + "GTCAGCAGC", "TGGAAGGCATCGGGCCATGAAATATGATAGCC"
    for pad, middle in ((9, "AGCTTTCCTTGA"), (0, "AGC"), (9, "CAT"), (0, ""), (9, "ACTATTTCCTGG")):
        row = ("s0", "IGH", "V", "J", v + "N" * pad + j, [1, 25, 37, 58, 70, 94, 94 + pad + 12], [24, 36, 57, 69, 93, 93 + pad + 12, 125 + pad], 93, 94 + pad)
        (x,) = annotate.placed(kernel([row], annotate.Options()), annotate.Options(), [{"rid": 0, "read_id": "r", "sequence": v + middle + j}])
        assert (x["v_end"], x["j_start"], x["ends"][4]) == (93, 94 + len(middle), 93), (pad, middle, x["cigar"])
