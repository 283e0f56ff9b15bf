"""Annotation records from placed hits: 52 columns in the order of the AIRR table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import sequences as sq

R = sq.REGIONS
V_SIDE = R[:5]
# The columns of the output table, in order.
SCALARS = (
    "sequence_id", "sequence", "locus", "v_call", "d_call", "d2_call", "j_call", "aln_score", "aln_evalue", "aln_identity", "rev_comp", "productive",
    "v_sequence_start", "v_sequence_end", "d_sequence_start", "d_sequence_end", "d2_sequence_start", "d2_sequence_end", "j_sequence_start",
    "np1", "np2", "np3", "junction", "junction_aa",
)
COLUMNS = (*SCALARS, *(f"{r}{x}" for r in R for x in ("_start", "_end", "", "_aa")))
#: What a placed hit has besides: extents of the seven regions, points, and D segments.
PLACED = (
    "target string, rev boolean, score int, bits double, evalue double, pident double, qstart int, qend int, tstart int, tend int, cigar string, qaln string, taln string, "
    "starts array<int>, ends array<int>, v_end int, j_start int, frame_point int, d array<struct<allele:string,s:int,e:int>>"
)


def junction(q: Column, cdr3: Column, fwr4: Column, coding: Column, v_end: Column) -> dict[str, Column]:
    """The junction of a read: from the codon before CDR3 to the first codon of FR4. Out of frame, Ns after the V end
    (kept inside the first and last codon) bring J into frame for the translation, and their codons read _. All null
    if it does not lie in the read."""
    js, je = cdr3 - 3, fwr4 + 2
    within = (js >= 1) & (je <= F.length(q))
    nt = F.when(within, sq.sliced(q, js, je))
    phase = F.pmod(fwr4 - coding, F.lit(3))
    k = F.pmod(3 - phase, F.lit(3))
    high = F.length(nt) - 3
    wish = F.when(v_end.isNotNull(), v_end - js + 1).otherwise(high)
    at = F.when(high < 3, F.greatest(F.lit(0), high)).otherwise(F.least(F.greatest(wish, F.lit(3)), high)).cast("int")
    bridged = F.concat(F.substring(nt, F.lit(1), at), F.repeat(F.lit("N"), k.cast("int")), F.substring(nt, at + 1, F.length(nt)))
    first, last = F.floor(at / 3), F.floor((at + k - 1) / 3)
    marked = F.array_join(F.transform(F.regexp_extract_all(sq.translate(bridged), F.lit("."), F.lit(0)), lambda c, i: F.when((i >= first) & (i <= last), "_").otherwise(c)), "")
    return {"nt": nt, "aa": F.when(k > 0, marked).otherwise(sq.translate(nt)), "phase": F.when(within, phase)}


def assembled(rows: DataFrame, seqtype: str = "nt") -> DataFrame:
    """rows: read_id, sequence (as oriented), locus, v_call, j_call and the fields of PLACED, target null for a read
    without a hit. Returns COLUMNS (and rid if there is one)."""
    q = F.col("sequence")
    rows = rows.select("*", *(F.get("starts", F.lit(i)).alias(f"{r}_s") for i, r in enumerate(R)), *(F.get("ends", F.lit(i)).alias(f"{r}_e") for i, r in enumerate(R)))
    anchored = (F.col("fwr4_s") - 1) >= F.col("cdr3_s")  # CDR3 ends where FR4 starts
    rows = rows.withColumn("cdr3_e", F.when(anchored, F.col("fwr4_s") - 1).otherwise(F.col("cdr3_e")))
    out: dict[str, Column] = {f"{r}{x}": c for r in R for x, c in (("_start", F.col(f"{r}_s")), ("_end", F.col(f"{r}_e")), ("", sq.sliced(q, F.col(f"{r}_s"), F.col(f"{r}_e"))))}
    both = F.col("cdr3_s").isNotNull() & F.col("fwr4_s").isNotNull()
    empty = lambda c: F.nullif(c, F.lit(""))
    if seqtype == "nt":
        # Coding starts at the first aligned position in the frame of the reference, else by fewest stops from FR1.
        to = F.coalesce("fwr3_e", F.length(q))
        guess = F.col("fwr1_s") + sq.coding_frame(sq.sliced(q, F.col("fwr1_s"), to))
        rows = rows.withColumn("coding", F.coalesce("frame_point", guess).cast("int"))
        rows = rows.withColumn("protein", sq.translate(q, F.col("coding") - 1))
        coded = F.col("coding").isNotNull()
        for r in R[:6]:
            out[f"{r}_aa"] = F.when(coded & F.col(f"{r}_s").isNotNull(), sq.aa_slice(F.col("protein"), F.col(f"{r}_s"), F.col(f"{r}_e"), F.col("coding")))
        out["fwr4_aa"] = F.when(coded, sq.translate(out["fwr4"]))
        j = junction(q, F.col("cdr3_s"), F.col("fwr4_s"), F.col("coding"), F.col("v_end"))
        rows = rows.withColumns({"j_nt": F.when(coded & both, j["nt"]), "j_aa": empty(F.when(coded & both, j["aa"])), "phase": F.when(coded & both, j["phase"])})
        has = F.col("j_aa").isNotNull()
        out |= {"junction": F.when(has, F.col("j_nt")), "junction_aa": F.col("j_aa")}
        inner = F.when(F.length("j_aa") > 2, F.substring("j_aa", F.lit(2), F.length("j_aa") - 2)).otherwise("")
        out["cdr3_aa"] = F.when(has, inner).otherwise(out["cdr3_aa"])
        clean = F.lit(True)
        for r in V_SIDE:
            clean &= ~F.contains(F.coalesce(out[f"{r}_aa"], F.lit("")), F.lit("*"))
        clean &= ~F.coalesce(F.col("j_aa"), F.lit("")).rlike("[*_]")
        out["productive"] = F.when(coded, F.coalesce(F.col("phase") == 0, F.lit(False)) & clean)
    else:
        out |= {f"{r}_aa": out[r] for r in R}
        inside = both & (F.col("cdr3_s") >= 2) & (F.col("fwr4_s") <= F.length(q))
        whole = F.when(inside, sq.sliced(q, F.col("cdr3_s") - 1, F.col("fwr4_s")))
        out |= {"junction": whole, "junction_aa": whole}
        out["cdr3_aa"] = F.when(inside, F.when(F.length(whole) > 2, F.substring(whole, F.lit(2), F.length(whole) - 2)).otherwise("")).otherwise(out["cdr3"])
        span = sq.sliced(q, F.col("fwr1_s"), F.col("fwr4_e"))
        out["productive"] = F.when(F.col("fwr1_s").isNotNull() & F.col("fwr4_s").isNotNull(), ~F.contains(span, F.lit("*")))
    hit = F.col("target").isNotNull()
    base = F.col("v_end") + 1
    d = [F.get("d", F.lit(i)) for i in (0, 1)]
    place = lambda x, field: (base + x[field]).cast("int")
    one, two = d[0].isNotNull(), d[1].isNotNull()
    between = lambda a, b: sq.sliced(q, a, b)
    out |= {
        "sequence_id": F.col("read_id"), "sequence": q, "locus": F.col("locus"), "v_call": F.col("v_call"), "j_call": F.col("j_call"),
        "aln_score": F.col("bits"), "aln_evalue": F.col("evalue"), "aln_identity": F.col("pident"),
        "rev_comp": F.when(hit, F.col("rev")), "v_sequence_start": F.col("fwr1_s"), "v_sequence_end": F.col("v_end"), "j_sequence_start": F.col("j_start"),
        "d_call": d[0]["allele"], "d_sequence_start": place(d[0], "s"), "d_sequence_end": place(d[0], "e"),
        "d2_call": d[1]["allele"], "d2_sequence_start": place(d[1], "s"), "d2_sequence_end": place(d[1], "e"),
        "np1": F.when(one, between(base, place(d[0], "s") - 1)),
        "np2": F.when(two, between(place(d[0], "e") + 1, place(d[1], "s") - 1)).when(one, between(place(d[0], "e") + 1, F.col("j_start") - 1)),
        "np3": F.when(two, between(place(d[1], "e") + 1, F.col("j_start") - 1)),
    }
    keep = ["rid"] if "rid" in rows.columns else []
    return rows.select(*keep, *(out[c].alias(c) for c in COLUMNS))
