"""Alignments derived from the business tables, and SQL for a second engine that makes records of them.

The SQL follows the definition of a record, step by step, and shares no code with the package: positions by running
counts over the columns of an alignment, extents by a range join, D segments by prefix sums, the rest as expressions.
"""

from __future__ import annotations

from spanloom.plans.derived import CODONS_SQL, D_SQL, nt

REGIONS = ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4")
_K = "c_custkey"
_S = lambda text, start, n: f"substring({text}, cast({start} AS INT), cast({n} AS INT))"
_GAPS = lambda n: f"repeat('-', cast({n} AS INT))"

#: One alignment for each customer, in SQL that both engines evaluate alike. V and J of every other one have no T, so no
#: stops. There are deletions, insertions, D segments (one or two) between, alignments cut at either end (bare V, bare J),
#: reverse hits, scaffolds without FR1, V end or J start, hits of unknown scaffolds only, and reads without hits.
_PARTS = f"""SELECT {_K} AS rid, CASE {_K} % 4 WHEN 0 THEN 'IGH' WHEN 1 THEN 'IGK' WHEN 2 THEN 'TRB' ELSE 'IGH' END AS locus, CASE {_K} % 4 WHEN 1 THEN 0 ELSE 9 END AS pad,
  CASE {_K} % 2 WHEN 0 THEN replace({nt(_K, 'a')} || {nt(_K, 'b')} || {nt(_K, 'c')}, 'T', 'C') ELSE {nt(_K, 'a')} || {nt(_K, 'b')} || {nt(_K, 'c')} END AS v,
  CASE {_K} % 3 WHEN 0 THEN {nt(_K, 'j')} ELSE replace({nt(_K, 'j')}, 'T', 'G') END AS j,
  CASE {_K} % 8 WHEN 7 THEN '' ELSE {_S(nt(_K, 'n'), 1, f'{_K} % 7')} || {_S(nt(f'{_K} % 25', 'd'), 1, f'8 + {_K} % 25 % 24')} || {_S(nt(_K, 'm'), 1, f'{_K} % 5')}
    || CASE {_K} % 3 WHEN 0 THEN {_S(nt(f'({_K} + 8) % 25', 'd'), 1, 14)} ELSE '' END END AS mid FROM customer"""
_COLUMNS = f"""SELECT rid, locus, pad, v, j,
  CASE rid % 5 WHEN 0 THEN {_S('v', 1, 29)} || {_GAPS('1 + rid % 4')} || {_S('v', '31 + rid % 4', 96)} WHEN 1 THEN {_S('v', 1, 50)} || {_S("'ACGTA'", 1, '1 + rid % 3')} || {_S('v', 51, 96)} ELSE v END
    || mid || {_GAPS('greatest(0, pad - length(mid))')} || j AS q,
  CASE rid % 5 WHEN 1 THEN {_S('v', 1, 50)} || {_GAPS('1 + rid % 3')} || {_S('v', 51, 96)} ELSE v END || repeat('N', cast(pad AS INT)) || {_GAPS('greatest(0, length(mid) - pad)')} || j AS t
  FROM ({_PARTS}) a"""
_CUT = f"""SELECT *, 1 + CASE rid % 9 WHEN 1 THEN 2 WHEN 2 THEN 14 WHEN 3 THEN 100 ELSE 0 END AS a, length(q) - CASE rid % 7 WHEN 1 THEN 3 WHEN 2 THEN 36 ELSE 0 END AS b,
  {_S(nt('rid', 'x'), 1, 'rid % 4')} AS lead, {_S(nt('rid', 'y'), 1, 'rid % 3')} AS tail FROM ({_COLUMNS}) c"""
DERIVED = f"""SELECT rid, concat('read', rid) AS read_id, concat(locus, '_', rid) AS scaffold_id, locus, pad, rid % 5 = 2 AS turned, {_S('q', 'a', 'b - a + 1')} AS qaln, {_S('t', 'a', 'b - a + 1')} AS taln,
  length(lead) + 1 AS qs, a - length({_S('t', 1, 'a - 1')}) + length(replace({_S('t', 1, 'a - 1')}, '-', '')) AS tstart, lead || replace({_S('q', 'a', 'b - a + 1')}, '-', '') || tail AS oriented FROM ({_CUT}) d"""
READS = f"SELECT rid, read_id, CASE WHEN turned THEN reverse(translate(oriented, 'ACGT', 'TGCA')) ELSE oriented END AS sequence FROM ({DERIVED}) e"
_SPOT = lambda at: f"CASE WHEN turned THEN length(oriented) - ({at}) + 1 ELSE {at} END"
_HIT = f"""SELECT read_id AS query, {{target}} AS target, cast({_SPOT('qs')} AS INT) AS qstart, cast({_SPOT("qs + length(replace(qaln, '-', '')) - 1")} AS INT) AS qend, cast(tstart AS INT) AS tstart,
  cast(tstart + length(replace(taln, '-', '')) - 1 AS INT) AS tend, 'x' AS cigar, qaln, taln, cast(1.5 AS DOUBLE) AS evalue, cast({{bits}} AS DOUBLE) AS bits, cast(97.25 AS DOUBLE) AS pident FROM ({DERIVED}) f WHERE rid % 19 <> 0"""
#: The true hit; one that ties with it, one of an unknown scaffold with fewer bits, for some with more, and one without.
HITS = " UNION ALL ".join(
    _HIT.format(target=t, bits=b) + w
    for t, b, w in (("scaffold_id", "100 + rid % 10", ""), ("concat(scaffold_id, 'z')", "100 + rid % 10", " AND rid % 6 = 0"), ("'no'", "20 + 500 * greatest(0, rid % 17 - 15)", ""), ("'null'", "NULL", " AND rid % 2 = 0"))
)
_FIXED = {"fwr1": (1, 24), "cdr1": (25, 36), "fwr2": (37, 57), "cdr2": (58, 69), "fwr3": (70, 87)}
_BOUNDS = {f"{r}_{x}": f"CASE WHEN rid % 11 = 0 THEN 0 ELSE {v} END" if r == "fwr1" else str(v) for r, b in _FIXED.items() for x, v in zip(("start", "end"), b)}
_BOUNDS |= {"cdr3_start": "88", "cdr3_end": "108 + pad", "fwr4_start": "109 + pad", "fwr4_end": "128 + pad"}
MARKUP = f"""SELECT scaffold_id, locus, concat(locus, 'V', rid, '*01') AS v_call, concat(locus, 'J', rid, '*01') AS j_call,
  cast(CASE WHEN rid % 13 = 0 THEN 0 ELSE 96 END AS INT) AS v_sequence_end, cast(CASE WHEN rid % 23 = 0 THEN 0 ELSE 97 + pad END AS INT) AS j_sequence_start, {', '.join(f'cast({e} AS INT) AS {n}' for n, e in _BOUNDS.items())} FROM ({DERIVED}) g"""

#: The same alignments taken as amino acids: forward, and for some with stops.
_STOPPED = "CASE rid % 3 WHEN 0 THEN replace({0}, 'T', '*') ELSE {0} END"
READS_AA = f"SELECT rid, read_id, {_STOPPED.format('oriented')} AS sequence FROM ({DERIVED}) e"
HITS_AA = f"""SELECT read_id AS query, scaffold_id AS target, cast(qs AS INT) AS qstart, cast(qs + length(replace(qaln, '-', '')) - 1 AS INT) AS qend, cast(tstart AS INT) AS tstart, cast(1 AS INT) AS tend,
  'x' AS cigar, {_STOPPED.format('qaln')} AS qaln, taln, cast(1.5 AS DOUBLE) AS evalue, cast(80 AS DOUBLE) AS bits, cast(97.25 AS DOUBLE) AS pident FROM ({DERIVED}) f WHERE rid % 19 <> 0"""

# DuckDB only, from here on

_AA = lambda s, frame="0": f"array_to_string([{CODONS_SQL} FOR c IN regexp_extract_all(upper(substr({s}, 1 + ({frame}))), '...')], '')"
_STOPS = lambda s, k: f"len([c FOR c IN regexp_extract_all(substr({s}, {k + 1}), '...') IF c IN ('TAA', 'TAG', 'TGA')])"
_SLICE = lambda s, a, b: f"substr({s}, ({a})::BIGINT, greatest(({b}) - ({a}) + 1, 0)::BIGINT)"
_MOD = lambda x: f"((({x}) % 3 + 3) % 3)"
_POINTS = {"v": "v_sequence_end", "j": "j_sequence_start", "p": f"tstart + {_MOD('fwr1_start - tstart')}"}
_WANTED = ", ".join([*(f"('{r}', {r}_start, {r}_end)" for r in REGIONS), *(f"('{n}', {e}, {e})" for n, e in _POINTS.items())])
_PICK = ", ".join([*(f"max(CASE name WHEN '{r}' THEN lo END)::INTEGER AS {r}_s, max(CASE name WHEN '{r}' THEN hi END)::INTEGER AS {r}_e0" for r in REGIONS), *(f"max(CASE name WHEN '{n}' THEN lo END)::INTEGER AS at_{n}" for n in _POINTS)])
_ENDS = ", ".join("CASE WHEN fwr4_s - 1 >= cdr3_s THEN fwr4_s - 1 ELSE cdr3_e0 END AS cdr3_e" if r == "cdr3" else f"{r}_e0 AS {r}_e" for r in REGIONS)

#: Up to the extents of regions and the points of each read.
_BASE = f"""mk AS ({MARKUP}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC NULLS LAST, target) AS r FROM hits) WHERE r = 1),
h AS (SELECT rid, read_id, mk.* EXCLUDE (scaffold_id), scaffold_id IS NOT NULL AS hit, qstart > qend AS rev, qaln, taln, tstart, evalue, bits, pident,
  CASE WHEN qstart > qend THEN reverse(translate(sequence, 'ACGT', 'TGCA')) ELSE sequence END AS q, CASE WHEN qstart > qend THEN length(sequence) - qstart + 1 ELSE qstart END AS qs
  FROM reads LEFT JOIN best ON query = read_id LEFT JOIN mk ON target = scaffold_id),
c AS (SELECT rid, qs, tstart, i, substr(qaln, i::BIGINT, 1) AS qc, substr(taln, i::BIGINT, 1) AS tc FROM h, unnest(range(1, length(qaln) + 1)) AS u(i) WHERE hit),
al AS (SELECT rid, qs - 1 + sum((qc <> '-')::INT) OVER w AS qp, tstart - 1 + sum((tc <> '-')::INT) OVER w AS tp, qc <> '-' AND tc <> '-' AS paired FROM c WINDOW w AS (PARTITION BY rid ORDER BY i)),
iv AS (SELECT rid, name, s, e FROM h, LATERAL (VALUES {_WANTED}) AS t(name, s, e) WHERE hit AND s > 0),
pr AS (SELECT iv.rid, name, min(qp) AS lo, max(qp) AS hi FROM iv JOIN al ON al.rid = iv.rid AND paired AND tp BETWEEN s AND e GROUP BY ALL),
pk AS (SELECT rid, {_PICK} FROM pr GROUP BY rid),
g AS (SELECT h.*, pk.* EXCLUDE (rid), {_ENDS} FROM h LEFT JOIN pk USING (rid))"""
STEPS = f"""reads AS ({READS}), hits AS ({HITS}), {_BASE},
x AS (SELECT g.rid, d.allele, i - y AS off, i, CASE WHEN substr(q, (at_v + 1 + i)::BIGINT, 1) = substr(d.sequence, (y + 1)::BIGINT, 1) THEN 1 ELSE -1 END AS sc
  FROM g JOIN ({D_SQL}) d USING (locus), unnest(range(0, at_j - at_v - 1)) AS a(i), unnest(range(0, length(d.sequence))) AS b(y)),
p1 AS (SELECT *, sum(sc) OVER (PARTITION BY rid, allele, off ORDER BY i) AS ps FROM x),
p2 AS (SELECT *, ps - sc AS pre, min(ps - sc) OVER (PARTITION BY rid, allele, off ORDER BY i) AS mn FROM p1),
p3 AS (SELECT *, max(CASE WHEN pre = mn THEN i END) OVER (PARTITION BY rid, allele, off ORDER BY i) AS s, ps - mn AS score FROM p2),
u AS (SELECT rid, allele, score, s, i AS e FROM (SELECT *, row_number() OVER (PARTITION BY rid, allele ORDER BY score DESC, off, i) AS r FROM p3) WHERE r = 1 AND score >= 6),
d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, e - s DESC, allele) AS r FROM u) WHERE r = 1),
d2 AS (SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY u.rid ORDER BY u.score DESC, u.e - u.s DESC, u.allele) AS r FROM u JOIN d1 USING (rid) JOIN g USING (rid)
  WHERE g.locus IN ('IGH', 'TRD') AND u.score >= 7 AND (u.e < d1.s OR u.s > d1.e)) WHERE r = 1),
dd AS (SELECT rid, CASE WHEN d2.s < d1.s THEN d2.allele ELSE d1.allele END AS da, CASE WHEN d2.s < d1.s THEN d2.s ELSE d1.s END AS ds, CASE WHEN d2.s < d1.s THEN d2.e ELSE d1.e END AS de,
  CASE WHEN d2.s < d1.s THEN d1.allele ELSE d2.allele END AS ea, CASE WHEN d2.s < d1.s THEN d1.s ELSE d2.s END AS es, CASE WHEN d2.s < d1.s THEN d1.e ELSE d2.e END AS ee FROM d1 LEFT JOIN d2 USING (rid)),
k AS (SELECT *, coalesce(at_p, fwr1_s + (SELECT f FROM (VALUES (0, {_STOPS('part', 0)}), (1, {_STOPS('part', 1)}), (2, {_STOPS('part', 2)})) AS t(f, n) ORDER BY n, f LIMIT 1)) AS coding
  FROM (SELECT *, substr(q, fwr1_s, coalesce(fwr3_e, length(q)) - fwr1_s + 1) AS part FROM g)),
jn AS (SELECT *, {_AA('q', 'coding - 1')} AS protein, coding IS NOT NULL AND cdr3_s - 3 >= 1 AND fwr4_s + 2 <= length(q) AS joined, fwr4_s + 2 - (cdr3_s - 3) + 1 AS n,
  {_MOD('fwr4_s - coding')} AS phase, {_MOD(f"3 - {_MOD('fwr4_s - coding')}")} AS fill FROM k),
jo AS (SELECT *, substr(q, (cdr3_s - 3)::BIGINT, greatest(n, 0)::BIGINT) AS jnt, CASE WHEN n - 3 < 3 THEN greatest(0, n - 3) ELSE least(greatest(CASE WHEN at_v IS NULL THEN n - 3 ELSE at_v - (cdr3_s - 3) + 1 END, 3), n - 3) END AS cut FROM jn),
jp AS (SELECT *, {_AA("jnt[:cut] || repeat('N', fill) || jnt[cut + 1:]")} AS raw FROM jo),
jq AS (SELECT *, CASE WHEN NOT joined THEN '' WHEN fill = 0 THEN {_AA('jnt')} ELSE array_to_string([CASE WHEN i - 1 BETWEEN cut // 3 AND (cut + fill - 1) // 3 THEN '_' ELSE substr(raw, i, 1) END FOR i IN range(1, length(raw) + 1)], '') END AS jaa FROM jp),
aa AS (SELECT *, {', '.join(f"CASE WHEN {r}_s IS NOT NULL AND coding IS NOT NULL THEN array_slice(protein, greatest(1, floor(({r}_s - coding) / 3.0)::BIGINT + 1), floor(({r}_e - coding) / 3.0)::BIGINT + 1) END AS {r}_v" for r in REGIONS[:6])} FROM jq)"""
_CLEAN = " AND ".join(f"NOT contains(coalesce({r}_v, ''), '*')" for r in REGIONS[:5])
_HAS, _LOOK = "coalesce(jaa, '') <> ''", "aa LEFT JOIN dd USING (rid)"
#: The columns of a record by name.
FIELDS = {
    "sequence_id": "read_id", "sequence": "q", "locus": "locus", "v_call": "v_call", "d_call": "da", "d2_call": "ea", "j_call": "j_call",
    "aln_score": "CASE WHEN hit THEN bits END", "aln_evalue": "CASE WHEN hit THEN evalue END", "aln_identity": "CASE WHEN hit THEN pident END", "rev_comp": "CASE WHEN hit THEN rev END",
    "productive": f"CASE WHEN coding IS NOT NULL THEN coalesce(joined AND phase = 0, false) AND {_CLEAN} AND NOT regexp_matches(coalesce(jaa, ''), '[*_]') END",
    "v_sequence_start": "fwr1_s", "v_sequence_end": "at_v", "d_sequence_start": "(at_v + 1 + ds)::INTEGER", "d_sequence_end": "(at_v + 1 + de)::INTEGER",
    "d2_sequence_start": "(at_v + 1 + es)::INTEGER", "d2_sequence_end": "(at_v + 1 + ee)::INTEGER", "j_sequence_start": "at_j",
    "np1": f"CASE WHEN da IS NOT NULL THEN {_SLICE('q', 'at_v + 1', 'at_v + ds')} END",
    "np2": f"CASE WHEN ea IS NOT NULL THEN {_SLICE('q', 'at_v + 2 + de', 'at_v + es')} WHEN da IS NOT NULL THEN {_SLICE('q', 'at_v + 2 + de', 'at_j - 1')} END",
    "np3": f"CASE WHEN ea IS NOT NULL THEN {_SLICE('q', 'at_v + 2 + ee', 'at_j - 1')} END",
    "junction": f"CASE WHEN {_HAS} THEN jnt END", "junction_aa": f"CASE WHEN {_HAS} THEN jaa END",
}
for _r in REGIONS:
    FIELDS |= {f"{_r}_start": f"{_r}_s", f"{_r}_end": f"{_r}_e::INTEGER", _r: _SLICE("q", f"{_r}_s", f"{_r}_e"), f"{_r}_aa": f"{_r}_v" if _r != "fwr4" else f"CASE WHEN coding IS NOT NULL THEN {_AA(_SLICE('q', 'fwr4_s', 'fwr4_e'))} END"}
FIELDS["cdr3_aa"] = f"CASE WHEN {_HAS} THEN substr(jaa, 2, greatest(length(jaa) - 2, 0)) ELSE cdr3_v END"


def record_sql(*columns: str) -> str:
    return f"WITH {STEPS} SELECT {', '.join(f'{FIELDS[c]} AS {c}' for c in columns)} FROM {_LOOK}"


_INNER = "cdr3_s >= 2 AND fwr4_s <= length(q)"
_WHOLE = f"CASE WHEN {_INNER} THEN {_SLICE('q', 'cdr3_s - 1', 'fwr4_s')} END"
FIELDS_AA = {
    "sequence_id": "read_id", "locus": "locus", "productive": f"CASE WHEN fwr1_s IS NOT NULL AND fwr4_s IS NOT NULL THEN NOT contains({_SLICE('q', 'fwr1_s', 'fwr4_e')}, '*') END",
    "d_call": "NULL::VARCHAR", "junction": _WHOLE, "junction_aa": _WHOLE, "cdr3_end": "cdr3_e::INTEGER", **{f"{r}_aa": _SLICE("q", f"{r}_s", f"{r}_e") for r in REGIONS},
}
FIELDS_AA["cdr3_aa"] = f"CASE WHEN {_INNER} THEN substr(junction_aa, 2, greatest(length(junction_aa) - 2, 0)) ELSE {FIELDS_AA['cdr3_aa']} END"
RECORD_AA = f"WITH reads AS ({READS_AA}), hits AS ({HITS_AA}), {_BASE} SELECT {', '.join(f'{e} AS {c}' for c, e in FIELDS_AA.items())} FROM g"
