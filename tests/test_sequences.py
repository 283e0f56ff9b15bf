import pytest
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "nt, frame, aa",
    [("ATGGCC", 0, "MA"), ("atggcc", 0, "MA"), ("AATGGCC", 1, "MA"), ("ATGTAA", 0, "M*"), ("ATGNCC", 0, "MX"), ("ATGGC", 0, "M"), ("AT", 0, ""), ("", 0, ""), ("ATG", -1, "M"), ("ATGRYK", 0, "MX"), ("AAATG", 2, "M")],
)
def test_translate(spark, nt, frame, aa):
    assert one(spark, sq.translate(F.lit(nt), F.lit(frame))) == aa
    sq.register(spark)
    assert spark.sql(f"SELECT seq_translate('{nt}', {frame}) x").first().x == aa


def test_codon_table(spark):
    table = sq.codon_table()
    assert len(table) == 64 and table["ATG"] == "M" and sorted(c for c, a in table.items() if a == "*") == ["TAA", "TAG", "TGA"]
    rows = spark.createDataFrame(list(table.items()), "c string, a string")
    assert rows.filter(sq.translate(F.col("c")) != F.col("a")).count() == 0


@pytest.mark.parametrize("nt, frame", [("ATGGCCATG", 0), ("AATGGCCATG", 0), ("TAATAATAACC", 1), ("CTAATAATAA", 0), ("", 0), ("TAACTAACTAAC", 0)])
def test_coding_frame_is_the_first_with_fewest_stops(spark, nt, frame):
    def stops(k):
        return sum(nt[i : i + 3] in ("TAA", "TAG", "TGA") for i in range(k, len(nt) - 2, 3))

    want = min(range(3), key=stops)
    assert one(spark, sq.coding_frame(F.lit(nt))) == want
    sq.register(spark)
    assert spark.sql(f"SELECT seq_frame('{nt}') x").first().x == want


def test_reverse_complement(spark):
    assert one(spark, sq.reverse_complement(F.lit("AACGT"))) == "ACGTT"
    assert one(spark, sq.reverse_complement(F.lit("acgn-R"))) == "NNNCGT"
    assert one(spark, sq.reverse_complement(sq.reverse_complement(F.lit("GATTACA")))) == "GATTACA"


def test_back_translate_round_trip(spark):
    aa = "ACDEFGHIKLMNPQRSTVWY"
    assert one(spark, sq.translate(sq.back_translate(F.lit(aa)))) == aa
    assert one(spark, sq.back_translate(F.lit("Ma*"))) == "ATGNNNNNN"


@pytest.mark.parametrize("at, origin, aa", [(1, 1, 1), (3, 1, 1), (4, 1, 2), (0, 1, 0), (1, 5, -1)])
def test_aa_coordinate_floors(spark, at, origin, aa):
    assert one(spark, sq.aa_coordinate(F.lit(at), F.lit(origin))) == aa


def test_small_ones(spark):
    assert one(spark, sq.gene_of_call(F.lit("IGHV1-2*01,IGHV3*02"))) == "IGHV1-2"
    assert one(spark, sq.locus_of_id(F.lit("TRB_17"))) == "TRB"
    assert one(spark, sq.ungapped(F.lit("ac..gt"))) == "ACGT"
    assert [one(spark, sq.n_padding(F.lit(v), F.lit(f), F.lit(d))) for v, f, d in ((9, 0, False), (10, 0, False), (10, 1, True))] == [0, 2, 10]
    assert [one(spark, sq.canonical_junction(F.lit(j))) for j in ("CAF", "CW", "C", "CA_F", "AAF", "")] == [True, True, False, False, False, False]


def test_files_are_located(spark, tmp_path):
    from spanloom.sources import locate

    (tmp_path / "wrap" / "Mus_musculus" / "TR").mkdir(parents=True)
    (tmp_path / "wrap" / "Mus_musculus" / "TR" / "TRBV.fasta").write_text(">a\nAC\n")
    assert locate.gene_file(spark, str(tmp_path), "Mus_musculus", "TR", "TRBV").endswith("/wrap/Mus_musculus/TR/TRBV.fasta")
    (tmp_path / "Mus_musculus" / "TR").mkdir(parents=True)
    (tmp_path / "Mus_musculus" / "TR" / "TRBV.fasta").write_text(">a\nAC\n")
    assert "wrap" not in locate.gene_file(spark, str(tmp_path), "Mus_musculus", "TR", "TRBV")
    with pytest.raises(FileNotFoundError):
        locate.gene_file(spark, str(tmp_path), "Mus_musculus", "TR", "TRBJ")
    with pytest.raises(RuntimeError):
        locate.reference_folder(spark, "mouse")
    spark.conf.set(locate.REFERENCES, str(tmp_path))
    try:
        assert locate.reference_folder(spark, "wrap").endswith("/wrap")
        with pytest.raises(FileNotFoundError):
            locate.reference_folder(spark, "mouse")
    finally:
        spark.conf.unset(locate.REFERENCES)
