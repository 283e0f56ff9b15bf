"""PII by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find e-mail and IP addresses, card and phone numbers; what they find are seeds. The two words before a
seed are a lexical pattern. Words with digits or an at sign, and runs of words of digits and separators, that no base
span touches are instances without a kind; they stand behind lexical patterns too. Over the graph of patterns and instances, scores go back and forth: a
pattern is worth the share of its instances that are of a kind, where those that have the form of the kind but no score
yet do not count for or against it, nor do words of a run that has a form, an instance what the patterns in front of it are worth together, and instances that score well count as evidence and as support of all their patterns in the next
round, until nothing changes. Where a pattern of high
confidence stands before an instance that has the form of its kind, the instance becomes a span.

Positions are code points, end exclusive. They come from running sums over the lengths of matches and of what lies
between them, by row, so that long texts with many matches take linear time.

Defined cases: null text counts as empty and has no spans. Repeated rows are found alike, each for itself. A value
that occurs often counts once for a pattern. Of kinds that score the same for an instance, the more confident pattern
and then the later kind in the alphabet decides. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import joined_apart, stored, tidy

#: Patterns by kind, in the order of kinds. Possessive repeats and starts only at a run's first character (or where
#: the last match ended) find the same matches in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE)))
#: Words with a digit or an at sign.
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Two words or more of digits and separators, with blanks between; a mark such as a comma ends the run.
_MARKS = r"[^\x20\x09-\x0D\p{L}\p{N}]*+(?![^\x20\x09-\x0D])"
RUN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}+(]*+[+(]*+[0-9][0-9().\-/]*+(?:\x20++[0-9().\-/]++(?=" + _MARKS + "))++" + _MARKS
EDGE = r"^[^\p{L}\p{N}+(]++|[^\p{L}\p{N})]++$"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
CONFIDENCE, SUPPORT, SCORE = 0.5, 3, 0.5
#: Rounds end when as many instances count as before and their scores grew by less than this in all.
SETTLED = 1e-6


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a kind's base pattern counts."""
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(OCTETS))
        .when(kind == "phone", n.between(9, 15))
        .when(n.between(12, 19), _luhn(_digits(value)))
        .otherwise(F.lit(False))
    )


def formed(kind: Column, value: Column) -> Column:
    """Whether a word without a base span has the form of a kind, loosely."""
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", value.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == "ip", value.rlike(r"^[0-9]{1,3}(?:[.:\-][0-9]{1,3}){3}$|^[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}$"))
        .when(kind == "phone", n.between(6, 15) & value.rlike(r"^[+(]{0,2}[0-9][0-9().\-/\x20]*$"))
        .otherwise(n.between(12, 19) & value.rlike(r"^[0-9][0-9.\-/\x20]*$"))
    )


def shaped(kind: Column, value: Column) -> Column:
    """formed(), but a run whose first word has the form on its own ends there: what follows is another number."""
    first = F.substring_index(value, " ", 1)
    return formed(kind, value) & ~((first != value) & formed(kind, first))


def _last(text: Column) -> Column:
    """The end of a text from the fourth blank from its end on, with one blank for each stretch of white space. What is
    joined to its front can change the first word only, and a context is the last two words and the blank after them."""
    return F.substring_index(F.regexp_replace(text, r"[\x20\x09-\x0D]++", " "), " ", -4)


def _found(text: Column, pattern: str) -> Column:
    """The matches of a pattern, each with the length of the text between it and the last one and that text's last words."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    rows = F.transform(pairs, lambda x: F.struct(F.char_length(x["g"]).alias("gap"), x["m"].alias("value"), _last(x["g"]).alias("left")))
    return F.filter(rows, lambda x: x["value"].isNotNull())


def _placed(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Matches as rows, with start and end; left goes on through the last two matches, which may be words of a context."""
    rows = rows.select(*by, F.posexplode(column).alias("i", "m")).select(*by, "i", "m.*")
    upto = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy(*by).orderBy("i")
    whole = _last(F.concat("left", "value"))
    rows = rows.withColumn("left", _last(F.concat(F.lag(whole, 2, "").over(order), F.lag(whole, 1, "").over(order), "left")))
    end = F.sum(F.col("gap") + F.char_length("value")).over(upto)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.char_length("value"))


def _context(left: Column) -> Column:
    """The last two words before a match, in lower case; null if there are not two."""
    words = F.substring_index(left, " ", -3)
    return F.when(words.rlike(r"^[^\x20]+\x20[^\x20]+\x20$"), F.lower(F.rtrim(words)))


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts: row_id, doc_id, what the base patterns match by kind, and words that may be
    instances. Texts are looked through for a pattern only if they hold a character that it needs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<gap:int,value:string,left:string>>")
    digit, sign = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    needs = {"email": sign, "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    lists = [F.when(needs[k], _found(text, PATTERNS[k])).otherwise(none).alias(k) for k in KINDS]
    lists.append(F.when(digit | sign, _found(text, INSTANCE)).otherwise(none).alias("words"))
    lists.append(F.when(digit & F.contains(text, F.lit(" ")), _found(text, RUN)).otherwise(none).alias("runs"))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), *lists)
    return stored(rows, "pii-scan", keep=True)


def base_spans(scan: DataFrame) -> DataFrame:
    """row_id, kind, start, end, value, pattern of the base spans."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in KINDS))
    rows = scan.filter(" or ".join(f"size({k}) > 0" for k in KINDS)).select("row_id", F.explode(kinds).alias("k")).select("row_id", "k.*").filter("size(found) > 0")
    rows = _placed(rows, "found", ["row_id", "kind"]).filter(valid(F.col("kind"), F.col("value")))
    return rows.select("row_id", "kind", "start", "end", F.lower("value").alias("value"), _context(F.col("left")).alias("pattern"))


def instances(scan: DataFrame, base: DataFrame) -> DataFrame:
    """row_id, start, end, value, pattern of words and runs with four digits or an at sign that touch no base span; inner:
    whether it is a word of a run that has the form of a kind."""
    part = lambda name, run: _placed(scan.filter(f"size({name}) > 0"), name, ["row_id"]).withColumn("run", F.lit(run))
    rows = part("words", False).unionByName(part("runs", True))
    lead = F.char_length(F.regexp_extract("value", r"^[^\p{L}\p{N}+(]++", 0))
    core = F.regexp_replace("value", EDGE, "")
    rows = rows.withColumn("start", F.col("start") + lead).withColumn("value", core).withColumn("end", F.col("start") + F.char_length("value"))
    rows = rows.filter((F.length(_digits(F.col("value"))) >= 4) | F.contains("value", F.lit("@"))).filter("start < end")
    rows = rows.select("row_id", "start", "end", F.lower("value").alias("value"), _context(F.col("left")).alias("pattern"), "run")
    spans = base.select(F.col("row_id").alias("b_row"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    touch = (F.col("row_id") == F.col("b_row")) & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    rows = rows.join(spans, touch, "left_anti").distinct()
    some = lambda has, value: F.exists(F.array(*map(F.lit, KINDS)), lambda k: has(k, value))
    whole = some(shaped, F.col("value"))
    # A run of a number and what merely follows it is no instance, its first word is.
    rows = rows.filter(~(F.col("run") & ~whole & some(formed, F.substring_index("value", " ", 1))))
    before = Window.partitionBy("row_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("run") & whole, F.col("end"))).over(before)
    return rows.withColumn("inner", ~F.col("run") & F.coalesce(reach >= F.col("end"), F.lit(False))).drop("run")


def bootstrapped(base: DataFrame, words: DataFrame) -> DataFrame:
    """Added spans: row_id, kind, start, end, score. Rounds go on until they change nothing: scores only grow, as each
    round has all that the one before it had."""
    seeds = stored(base.filter("pattern is not null").select("pattern", "kind", "value").distinct(), "pii-seeds")
    loose = stored(words.filter("pattern is not null").groupBy("pattern", "value").agg(F.min("inner").alias("inner"), F.count(F.lit(1)).alias("n")), "pii-loose")
    # The words of a run count with it, not as members of their own.
    members = seeds.select("pattern", "value").union(loose.filter("not inner").select("pattern", "value")).distinct()
    members = members.groupBy(F.col("pattern").alias("all_pattern")).agg(F.count(F.lit(1)).alias("members"))
    seeded = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support"))
    kinds = F.explode(F.array(*map(F.lit, KINDS))).alias("kind")
    edges = loose.select("pattern", "value", "inner", kinds).filter(shaped(F.col("kind"), F.col("value"))).join(seeds, ["pattern", "kind", "value"], "left_anti")
    edges = stored(edges, "pii-forms")
    counts = stored(edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("inner")).alias("outer_n")), "pii-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Only patterns with enough seeds and instances can ever count.
    able = counts.join(seeded, ["pattern", "kind"], "left").filter(F.col("n") + F.coalesce("support", F.lit(0)) >= SUPPORT)
    able = able.join(members, F.col("pattern") == F.col("all_pattern"), "left")
    able = stored(able.select("pattern", "kind", F.coalesce("support", F.lit(0)).alias("support"), (F.coalesce("members", F.lit(0)) - F.col("outer_n")).alias("known")), "pii-patterns")
    edges = stored(joined_apart(edges.drop("inner"), able.select("pattern", "kind"), ["pattern", "kind"], counts, total), "pii-edges")
    scores, last = None, None
    while True:
        gained, more, now = F.lit(0.0), F.lit(0), able
        if scores is not None:
            extra = edges.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"), F.count(F.lit(1)).alias("more"))
            now = able.join(extra, ["pattern", "kind"], "left")
            gained, more = F.coalesce("gained", F.lit(0.0)), F.coalesce("more", F.lit(0))
        now = now.filter(F.col("support") + more >= SUPPORT)
        good = now.select("pattern", "kind", ((F.col("support") + gained) / (F.col("known") + more + 1)).alias("confidence")).filter(F.col("confidence") >= CONFIDENCE)
        good = stored(good, "pii-good")
        votes = joined_apart(edges, good, ["pattern", "kind"], counts, total)
        votes = votes.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = stored(votes.filter(F.col("score") >= SCORE), "pii-scores")
        n, grown = scores.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if n == 0 or last is not None and n == last[0] and grown - last[1] < SETTLED:
            break
        last = n, grown
    often = stored(loose.groupBy("pattern").agg(F.sum("n").alias("n")), "pii-often")
    every = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    added = joined_apart(words.filter("pattern is not null").drop("inner"), good, ["pattern"], often, every).join(scores, ["value", "kind"])
    best = F.max(F.struct("score", "confidence", "kind")).alias("best")
    added = added.groupBy("row_id", "start", "end").agg(best).select("row_id", "best.kind", "start", "end", "best.score")
    # Of a run and words in it, the run stays.
    before = Window.partitionBy("row_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return added.withColumn("upto", F.max("end").over(before)).filter("upto is null or end > upto").drop("upto")


def _joined(start: str = "start", end: str = "end") -> Column:
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    text = F.concat_ws(":", "kind", start, end)
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(F.col(start), order.alias("o"), text.alias("text")))), lambda x: x["text"]))


@tidy
def find(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added."""
    scan = scanned(docs)
    base = stored(base_spans(scan), "pii-base", keep=True)
    words = stored(instances(scan, base), "pii-words")
    added = stored(bootstrapped(base, words), "pii-added", keep=True)
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    own = base.groupBy(F.col("row_id").alias("own_row")).agg(*counts, _joined().alias("base"))
    every = base.select("row_id", "kind", "start", "end").withColumn("more", F.lit(0)).unionByName(added.select("row_id", "kind", "start", "end").withColumn("more", F.lit(1)))
    every = every.groupBy(F.col("row_id").alias("all_row")).agg(_joined().alias("spans"), F.sum("more").alias("n_added"))
    rows = scan.select("row_id", "doc_id").join(own, F.col("row_id") == F.col("own_row"), "left").join(every, F.col("row_id") == F.col("all_row"), "left")
    return rows.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"),
    )
