"""URL filters: rules decide first; where none fits, naive Bayes over segmented names does.

Letters of hosts and paths come in runs ("cheappills"), which are split into words by the most likely sequence of words: a
Viterbi search over unigram counts that are taken from the text of all pages. Runs meet the words that they contain in a
join (substrings with words), so no dictionary is ever broadcast. What no word covers is a word of its own, at a cost that
rises with its length. A multinomial model learns from the urls that rules decide: how often each word of a host or of a
path stands in allowed and in blocked ones, plus one. It scores the others. Its classes weigh alike, as rules are no sample
of the urls, and words that it has not seen count for nothing. Costs and scores are whole millionths, so their sums do not
depend on the order, and reruns agree.

Defined cases: a null url, and one without `://`, has an empty host and path. Without tokens a score is 0; a score over 0
blocks, any other one allows. Equal segmentations: at each place the longest last word wins, then one that is known. Of
rules of equal length that fit, the last one by its text wins. Null html has no words. Runs of digits are tokens of their
length and are not split. Words of the text of over LONGEST letters are no part of the dictionary; runs may have any length.
Repeated rows each count and are each judged. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import joined_apart, stored, tidy

#: Hosts and paths of the rules, and what they say.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LONGEST = 24
#: What costs and scores are counted in.
UNIT = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-z]+|[^\\x00-\\x7F]+"


def lower(s: Column) -> Column:
    """A-Z only."""
    return F.translate(s, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """A struct of the rule that fits and its verdict, or null."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    found = [F.when(fits(h, p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*found)) if found else F.lit(None).cast("struct<n: int, rule: string, verdict: string>")


def tokens(host: Column, path: Column) -> Column:
    """Runs of letters and of digits, as structs of field (h or p) and piece; digits as # and how many there are."""
    runs = lambda s: F.regexp_extract_all(s, F.lit(f"({RUN}|[0-9]+)"), F.lit(1))
    name = lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)
    part = lambda s, f: F.transform(runs(s), lambda x: F.struct(F.lit(f).alias("field"), name(x).alias("piece")))
    return F.concat(part(host, "h"), part(lower(path), "p"))


def dictionary(pages: DataFrame) -> DataFrame:
    """word, n: words of the pages' text, that is of the html between tags."""
    words = F.regexp_extract_all(lower(F.regexp_replace("html", "<[^>]*>", " ")), F.lit(f"({RUN})"), F.lit(1))
    return pages.select(F.explode(words).alias("word")).filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _cost(share: Column) -> Column:
    return F.round(UNIT * F.log(share)).cast("long")


def split_run(run: str, known: list[tuple[int, int, int]], opening: int, letter: int) -> list[str]:
    """The cheapest words of a run. known: start, end and cost of the dictionary's words in it; what is not known costs
    `opening` once and `letter` for each of its letters."""
    ending: dict[int, list[tuple[int, int]]] = {}
    for start, end, cost in known:
        ending.setdefault(end, []).append((start, cost))
    best, back = [0], [0]
    unknown, since = None, 0  # cheapest way that ends in letters that are not known, and where these begin
    for i in range(1, len(run) + 1):
        fresh = best[i - 1] + opening
        if unknown is None or fresh < unknown:
            unknown, since = fresh, i - 1
        unknown += letter
        # Of equals the earliest start, then what is known.
        cost, start, _ = min([(unknown, since, 1)] + [(best[s] + c, s, 0) for s, c in ending.get(i, ())])
        best.append(cost)
        back.append(start)
    out, at = [], len(run)
    while at:
        out.append(run[back[at] : at])
        at = back[at]
    return out[::-1]


@tidy
def segmented(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """pieces: piece, without repeats; words: word, n. Returns piece and its words."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lexicon = words.select(F.col("word").alias("part"), _cost(F.lit(float(max(total, 1))) / F.col("n")).alias("cost"))
    letters = pieces.filter(~F.col("piece").startswith("#"))
    # All substrings of up to LONGEST letters that may be words; starts count from 0.
    starts = letters.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    ends = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("at") + 1))
    parts = starts.select("piece", "at", F.explode(ends).alias("wide")).withColumn("part", F.substring(F.col("piece"), F.col("at"), F.col("wide")))
    counts = stored(parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "parts", keep=True)
    all_parts = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = joined_apart(parts, lexicon, ["part"], counts, all_parts)
    found = found.groupBy("piece").agg(F.collect_list(F.struct((F.col("at") - 1).alias("a"), (F.col("at") - 1 + F.col("wide")).alias("b"), "cost")).alias("known"))
    rows = letters.join(found, "piece", "left")
    opening = max(0, round(UNIT * math.log(max(total, 1) / 10)))
    letter = round(UNIT * math.log(10))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [split_run(x, [(m["a"], m["b"], m["cost"]) for m in k or ()], opening, letter) for x, k in zip(names, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.list_(pa.string()))], names=["piece", "words"])

    out = rows.select("piece", "known").mapInArrow(run, "piece string, words array<string>")
    digits = pieces.filter(F.col("piece").startswith("#")).select("piece", F.array("piece").alias("words"))
    return stored(out.unionByName(digits), "segmented", keep=True)


@tidy
def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, host, path, rule, verdict and score (millionths, 0 where a rule decides)
    for each row."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by", ruled(F.col("host"), F.col("path"), rules))
    decided = lambda v: F.count_if(F.col("verdict") == v)
    each = rows.select("by.verdict", F.explode(tokens(F.col("host"), F.col("path"))).alias("t")).select("verdict", "t.*")
    pieces = stored(each.groupBy("field", "piece").agg(decided("allow").alias("allow"), decided("block").alias("block"), F.count(F.lit(1)).alias("n")), "pieces", keep=True)
    words = stored(dictionary(pages.select(F.col("html").cast("string").alias("html"))), "dictionary", keep=True)
    cut = segmented(pieces.select("piece").distinct(), words)
    word_of = stored(pieces.join(cut, "piece").select("field", "piece", "allow", "block", F.explode("words").alias("word")), "words", keep=True)
    seen = stored(word_of.groupBy("field", "word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count(F.lit(1)).alias("n")), "seen", keep=True)
    known = seen.filter("allow + block > 0")
    size, allow, block, uses = (known.agg(F.count(F.lit(1)), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first() + seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first())
    odds = ((F.col("block") + 1) / F.lit(float(block + size))) / ((F.col("allow") + 1) / F.lit(float(allow + size)))
    known = known.select("field", "word", _cost(odds).alias("odds"))
    scored = joined_apart(word_of.select("field", "piece", "word"), known, ["field", "word"], seen, uses)
    scored = stored(scored.groupBy("field", "piece").agg(F.sum("odds").alias("odds")), "odds", keep=True)
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    open_ = rows.filter("by IS NULL").select("page_id", "host", "path", F.monotonically_increasing_id().alias("row"))
    open_ = stored(open_, "open", keep=True)
    own = open_.select("*", F.explode(tokens(F.col("host"), F.col("path"))).alias("t")).select("row", "t.*")
    own = joined_apart(own, scored, ["field", "piece"], pieces, total).groupBy("row").agg(F.sum("odds").alias("score"))
    own = open_.join(own, "row", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    own = own.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") > 0, "block").otherwise("allow").alias("verdict"), "score")
    return rows.filter("by IS NOT NULL").select("page_id", "host", "path", "by.rule", "by.verdict", F.lit(0).cast("long").alias("score")).unionByName(own)


_LOW = f"translate({{0}}, '{_UPPER}', '{_LOWER}')"
_FITS = ", ".join(f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'n': {len(h + p)}, 'rule': '{h + p}', 'verdict': '{v}'}} END" for h, p, v in RULES)
_TOKENS = f"[{{{{'field': '{{1}}', 'piece': CASE WHEN regexp_matches(x, '^[0-9]') THEN '#' || length(x) ELSE x END}}}} FOR x IN regexp_extract_all({{0}}, '{RUN}|[0-9]+')]"
SQL = f"""
WITH RECURSIVE r0 AS (SELECT page_id, html, row_number() OVER () AS row, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r1 AS (SELECT page_id, html, row, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT * REPLACE (coalesce(rest, '') AS rest) FROM r0) t),
r AS MATERIALIZED (SELECT *, list_max([{_FITS}]) AS fit FROM r1),
t AS MATERIALIZED (SELECT row, fit.verdict AS verdict, unnest(list_concat({_TOKENS.format("host", "h")}, {_TOKENS.format(_LOW.format("path"), "p")}), recursive := true) FROM r),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_LOW.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")}, '{RUN}')) AS word FROM r) x WHERE length(word) <= {LONGEST} GROUP BY word),
total AS MATERIALIZED (SELECT greatest(coalesce(sum(n), 0), 1)::DOUBLE AS total FROM w),
pieces AS MATERIALIZED (SELECT DISTINCT piece FROM t WHERE NOT starts_with(piece, '#')),
places AS (SELECT piece, a, unnest(range(a + 1, least(a + {LONGEST}, length(piece)) + 1)) AS b FROM (SELECT piece, unnest(range(length(piece))) AS a FROM pieces) x),
m AS MATERIALIZED (SELECT piece, b, list({{'a': a, 'cost': round({UNIT} * ln((SELECT total FROM total) / n))::BIGINT}}) AS known FROM (SELECT *, substr(piece, a + 1, b - a) AS word FROM places) p JOIN w USING (word) GROUP BY piece, b),
fee AS (SELECT greatest(0, round({UNIT} * ln(total / 10)))::BIGINT AS opening, round({UNIT} * ln(10))::BIGINT AS letter FROM total),
steps AS MATERIALIZED (SELECT p.piece, b, coalesce(known, []) AS known, opening, letter FROM (SELECT piece, unnest(range(1, length(piece) + 1)) AS b FROM pieces) p LEFT JOIN m USING (piece, b), fee),
v AS (SELECT piece, 0::BIGINT AS i, [0::BIGINT] AS best, [[]::VARCHAR[]] AS words, NULL::BIGINT AS unknown, 0::BIGINT AS since FROM pieces
UNION ALL SELECT piece, b, list_append(best, pick.c), list_append(words, list_append(words[pick.a + 1], substr(piece, pick.a + 1, b - pick.a))), unknown, since FROM (
SELECT *, list_min(list_append([{{'c': best[k.a + 1] + k.cost, 'a': k.a, 'u': 0}} FOR k IN known], {{'c': unknown, 'a': since, 'u': 1}})) AS pick FROM (
SELECT s.piece, s.b, v.best, v.words, s.known, CASE WHEN v.unknown IS NULL OR v.best[s.b] + s.opening < v.unknown THEN v.best[s.b] + s.opening ELSE v.unknown END + s.letter AS unknown,
CASE WHEN v.unknown IS NULL OR v.best[s.b] + s.opening < v.unknown THEN s.b - 1 ELSE v.since END AS since FROM v JOIN steps s ON s.piece = v.piece AND s.b = v.i + 1) x) y),
cut AS MATERIALIZED (SELECT piece, words[i + 1] AS words FROM v WHERE i = length(piece) UNION ALL SELECT DISTINCT piece, [piece] FROM t WHERE starts_with(piece, '#')),
tw AS MATERIALIZED (SELECT row, verdict, field, unnest(words) AS word FROM t JOIN cut USING (piece)),
seen AS MATERIALIZED (SELECT field, word, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM tw WHERE verdict IS NOT NULL GROUP BY field, word),
odds AS MATERIALIZED (SELECT field, word, round({UNIT} * ln(((b + 1) / (sb + v)::DOUBLE) / ((a + 1) / (sa + v)::DOUBLE)))::BIGINT AS odds FROM seen, (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS v FROM seen) s),
score AS (SELECT row, sum(odds) AS score FROM tw JOIN odds USING (field, word) WHERE verdict IS NULL GROUP BY row)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN coalesce(score, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
CASE WHEN fit IS NULL THEN coalesce(score, 0)::BIGINT ELSE 0 END AS score FROM r LEFT JOIN score USING (row)
"""
