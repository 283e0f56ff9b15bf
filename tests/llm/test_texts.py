"""Operators that judge or rewrite single texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from spanloom.llm import chat, piece_bpe, pii, quality_knn, quality_rules, queries, token_counts

DOCS = "doc_id long, text string, source string, size string, failed long, score string, key string"
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "null id"), (5, "a " * 30_000), (6, "x" * 60_000), (7, "ünï cödé 😀 ﬁ　wide"), (8, "\x00\x1f\x85 odd spaces")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", "clash", 1, "clash", "clash") for i, t in ODD], DOCS)


def empty(df):
    return df.filter("false")


# Quality rules


def measured_slowly(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(repeated))


def test_measures_agree_with_a_slow_count():
    random.seed(1)
    for _ in range(200):
        text = "".join(random.choice(["a", "b", " ", "\n", "a b", "é", "#", "<", "\x0b", "\x85", "　"]) for _ in range(random.randint(0, 60)))
        assert quality_rules.measured(text.encode())[:6] == measured_slowly(text)


def test_ledger_and_policies(odd):
    rows = quality_rules.verdicts(quality_rules.ledger(odd)).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[1, 0].base_failed and not by[1, 0].kept and by[5, 30_000].failed & quality_rules.BIT["repeats"]
    assert by[6, 1].word_chars == 60_000
    assert quality_rules.ledger(empty(odd)).count() == 0


def test_ablations_agree_with_a_count(odd):
    book = quality_rules.ledger(odd)
    bits = [r.failed for r in book.collect()]
    for r in quality_rules.ablations(book).collect():
        mask = next(p.mask for p in quality_rules.POLICIES if p.version == r.policy)
        bit = quality_rules.BIT[r.rule]
        assert (r.n_docs, r.kept, r.failing, r.alone, r.kept_without) == (len(bits), sum(b & mask == 0 for b in bits), sum(b & bit != 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))
    all_bits = quality_rules.combined(book.withColumn("one", F.lit(1)), "one").first()
    assert all_bits.some_fail == int(np.bitwise_or.reduce(bits)) and all_bits.all_fail == int(np.bitwise_and.reduce(bits))


# Quality classifier


def test_classifier_learns_and_is_defined_everywhere(spark, odd):
    random.seed(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    good = [(i, " ".join(random.choice(words) for _ in range(60)), 1) for i in range(0, 400, 2)]
    bad = [(i, "| ".join(random.choice(words).upper() for _ in range(60)), 0) for i in range(1, 400, 2)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (3, None), (0, 7)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels, per_class=50)
    got = {r.doc_id: r for r in quality_knn.scored(docs, model).collect()}
    held = [(i, q) for i, _, q in good + bad if got[i].held_out]
    assert 40 < len(held) < 120 and all(got[i].predicted == q for i, q in held)
    assert quality_knn.good(docs.withColumn("score", F.lit("clash")), model).count() == 200
    rows = quality_knn.scored(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and next(r for r in rows if r.doc_id is None).held_out
    none = quality_knn.fit(docs, empty(labels))
    assert {r.score for r in quality_knn.scored(odd, none).collect()} == {0.5}
    one = quality_knn.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in quality_knn.scored(docs, one).collect()} == {1.0}


def test_votes_agree_with_a_slow_count(spark):
    random.seed(12)
    words = ["red", "Green", "blue!", "42", "gold", "| x"]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randint(0, 12)))) for i in range(150)]
    rows += [(i, "same text") for i in range(200, 230)] + [(7, "another text of seven"), (8, None)]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 230, 2)] + [(i, 5) for i in range(0, 230, 2)] + [(10, 1 - int(10 % 3 == 0)), (9, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_knn.fit(docs.repartition(3), marks)
    again = quality_knn.fit(docs.repartition(5), marks)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.labels, again.labels)
    # The labelled rows, by doc_id: 0 or 1 only, 1 if both; of several texts of an id the smallest.
    import zlib

    known: dict[int, int] = {}
    for i, q in labels:
        if q in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(q, known.get(i, 0))
    text_of: dict[int, list] = {}
    for i, t in rows:
        text_of.setdefault(i, []).append((t is not None, t or ""))
    ids = sorted(i for i in known if i in text_of)
    assert list(model.labels) == [known[i] for i in ids]
    unit = lambda t: (lambda v: v / max(np.linalg.norm(v), 1e-12))(quality_knn.features(t.encode()) @ model.project)
    vectors = [unit(min(text_of[i])[1]) for i in ids]
    assert np.allclose(vectors, model.vectors)
    want = []
    for i, t in rows:
        v = unit(t or "")
        near = sorted((-round(float(v @ u), 9), n) for n, u in enumerate(vectors))[: quality_knn.NEIGHBOURS]
        weights = [max(-c, 1e-6) ** quality_knn.POWER for c, _ in near]
        want.append((i, sum(w * model.labels[n] for w, (_, n) in zip(weights, near)) / sum(weights)))
    got = sorted((r.doc_id, r.score) for r in quality_knn.scored(docs, model).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose([x for _, x in got], [x for _, x in sorted(want)], atol=1e-6)
    monkey = {r.doc_id: r.score for r in quality_knn.scored(docs.filter("doc_id = 200"), model).collect()}
    assert monkey[200] in [x for i, x in got if i == 200]  # batches do not matter


def test_held_out_column(spark):
    import zlib

    rows = spark.range(200).select("id", quality_knn.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return queries.piece_model()


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_encoding_agrees_with_the_library(model, library):
    table = piece_bpe.PieceTable(model)
    random.seed(3)
    parts = [" ", "▁", "\n", "\t", "a", "the", "é", "日本", "😀", "\x00", "ﬁ", "00", "==", "  ", "xxxxx", "<0x0A>", "</s>", "ing", "Ａ", "\r"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += [" " * n for n in range(70)] + ["=" * 700, "a" * 500, "ab" * 300] + [" " * n + "x" for n in range(40)]
    for text in texts:
        want = library.encode(text)
        assert table.encode(text) == ",".join(map(str, want)) and table.decode(table.encode(text)) == library.decode(want)


def test_encoded_rows(odd, model, library):
    rows = piece_bpe.encoded(odd, model).collect()
    want = sorted((i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in ODD)
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == want
    short = piece_bpe.encoded(odd, model, digests=True).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in short) == sorted((i, len(x), digest(",".join(map(str, x))), digest(d)) for i, x, d in want)
    assert piece_bpe.encoded(empty(odd), model).count() == 0


# Token counts


def test_limits_agree_with_sums(spark):
    random.seed(4)
    lengths = [random.choice([0, 1, 5, 1023, 1024, 1025, 5000, random.randint(0, 9000)]) for _ in range(500)]
    frame = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    table = token_counts.limits(token_counts.histogram(frame)).cache()
    for r in table.collect():
        over = [n for n in lengths if n > r.length]
        assert (r.n_docs, r.docs_over, r.tokens_over, r.total) == (lengths.count(r.length), len(over), sum(over), sum(min(n, r.length) for n in lengths))
    for limit in (0, 3, 1000, 4999, 10_000):
        assert token_counts.truncated_total(table, limit) == sum(min(n, limit) for n in lengths)
    for q in (0.1, 0.5, 1.0):
        assert token_counts.quantile(table, q) == sorted(lengths)[max(0, int(np.ceil(q * len(lengths))) - 1)]
    assert token_counts.limits(token_counts.histogram(empty(frame))).count() == 0


def test_token_counts_of_texts(odd, model, library):
    rows = token_counts.token_counts(odd, model).collect()
    assert sum(r.n_docs for r in rows) == len(ODD) and max(r.length for r in rows) == max(len(library.encode(t or "")) for _, t in ODD)


# PII

SLOW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(SLOW.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_base_spans_agree_with_a_plain_search(spark, odd):
    random.seed(5)
    parts = list("0123456789") * 2 + [" ", "-", ".", "@", "+", "(", ")", "a", "b", "_", "😀", "é", "\n", "12", "1.2.3.4", "x@y.z", "+1 555"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 80)))) for i in range(800)]
    rows += [(9001, "1" * 20_000), (9002, "a" * 20_000), (9003, "1 " * 20_000), (9004, "a." * 9_000 + "@b.c"), (9005, "+1" + "(2" * 9_000)]
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = base_spans(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(k, want)) for k in SLOW]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    found = pii.find(odd).collect()
    assert len(found) == len(ODD) and {r.spans for r in found} == {""}
    assert pii.find(empty(odd)).count() == 0


def test_labels_of_any_type(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(40)], "doc_id long, text string")
    plain = quality_knn.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int"))
    odd = [(i, str(i % 2)) for i in range(30)] + [(30, "0.9"), (31, "good"), (32, None), (33, "2"), (34, "NaN")]
    for kind in ("string", "double"):
        labels = spark.createDataFrame(odd, "doc_id long, quality string").selectExpr("doc_id", f"try_cast(quality AS {kind}) AS quality")
        model = quality_knn.fit(docs, labels)
        assert (model.labels == plain.labels).all() and (model.vectors == plain.vectors).all()


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 (555) 555-01{i:02d} today, my mail address bob{i}@x.example.com works") for i in range(8)]
    rows += [(100, "then call me at 555-0199 now"), (101, "it is my mail address jane@localhost too"), (102, "costs 555-0198 and 12345"), (103, "call me at noon")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:16:24" and got[101].spans.startswith("email:22:") and got[102].spans == got[103].spans == ""
    assert all(got[i].n_added == 0 for i in range(8))


def test_patterns_discover_identifiers_with_spaces(spark):
    rows = [(i, f"please call me at +1 (555) 555-01{i:02d} today, my card number is 4111 1111 1111 1111 or card number is 5500 0000 0000 0004, card number is 3400 0000 0000 009") for i in range(8)]
    new = {100: ("call me at ", "(555) 123-4567", " now", "phone"), 101: ("so call me at ", "020 7946 0958", ", or not", "phone"), 102: ("the card number is ", "4111 1111 1111 1112", ".", "card"), 103: ("555 0100 then call   me\tat \n", "(555)  123 4568", "; 555 0101", "phone")}
    rows += [(k, a + v + b) for k, (a, v, b, _) in new.items()] + [(104, "costs (555) 123-4567 and 12 345 678"), (105, "x" * 100 + " call" + " " * 90 + "me at 555-0199")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (a, v, _, kind) in new.items():
        assert got[k] == f"{kind}:{len(a)}:{len(a) + len(v)}"
    assert got[104] == "" and got[105].startswith("phone:201:")


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_cards_in_blocks_and_numbers_that_follow(spark, share):
    random.seed(21)
    block = lambda: f"{random.randint(1000, 9999)}"
    rows, want = [], {}
    for i in range(60):
        seed = i < 60 * share
        while True:
            number = " ".join(block() for _ in range(4))
            if luhn(number.replace(" ", "")) == seed:
                break
        rows.append((i, f"so the card number is {number}, or"))
        want[i] = f"card:22:{22 + len(number)}"
        phone = f"+1 (555) 555-{i:04d}" if seed else f"555-{i:04d}"
        rows.append((1000 + i, f"please call me at {phone} {7 if not seed else 'all'} days a week"))
        want[1000 + i] = f"phone:18:{18 + len(phone)}"
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_bootstrap_goes_on_through_discovered_identifiers(spark):
    rows = [(i, f"please call me at +1 (555) 555-01{i:02d} today") for i in range(40)]
    chain = ["call me at", "text him on", "ring us via", "fax it to", "dial up number"]
    for k, c in enumerate(chain):  # each group of new values stands behind its pattern and all later ones
        rows += [(1000 + 100 * k + 20 * g + i, f"x {c} 77{g}-01{i:02d} now") for g in range(min(k, 3) + 1) for i in range(3 if g else 12)]
    rows += [(5000, "so dial up number 999-0199 now"), (5001, "we sold about 999-0198 now")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")).collect()}
    assert all(got[d] for d, _ in rows if d < 5000) and got[5000] == "phone:18:26" and got[5001] == ""


BLANK = r"\x20\x09-\x0D"


def context_slowly(before):
    found = regex.search(rf"([^{BLANK}]+)[{BLANK}]+([^{BLANK}]+)[{BLANK}]+$", before)
    return f"{found[1]} {found[2]}".lower() if found else None


def spans_slowly(texts):
    """Spans of all texts, by rounds over dictionaries, with every context taken from the text before a match."""
    forms = {"email": r"[^@]+@[^@]+", "ip": r"[0-9]{1,3}(?:[.:\-][0-9]{1,3}){3}|[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){3,7}", "phone": r"[+(]{0,2}[0-9][0-9().\-/ ]*", "card": r"[0-9][0-9.\-/ ]*"}
    size = {"email": (0, 99999), "ip": (0, 99999), "phone": (6, 15), "card": (12, 19)}
    formed = lambda kind, v: re.fullmatch(forms[kind], v) and size[kind][0] <= len(re.sub("[^0-9]", "", v)) <= size[kind][1]
    shaped = lambda kind, v: formed(kind, v) and not (" " in v and formed(kind, v.split(" ")[0]))
    base, loose = [], []
    for row, text in enumerate(texts):
        own = []
        for kind, pattern in SLOW.items():
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                    own.append((row, kind, m.start(), m.end(), m[0].lower(), context_slowly(text[: m.start()])))
        base += own
        runs = []
        for pattern in (pii.RUN, pii.INSTANCE):
            for m in regex.finditer(pattern, text):
                start = m.start() + len(regex.match(r"[^\p{L}\p{N}+(]*", m[0])[0])
                core = regex.sub(pii.EDGE, "", m[0])
                end = start + len(core)
                if core and (len(re.sub("[^0-9]", "", core)) >= 4 or "@" in core) and not any(start < e and s < end for _, _, s, e, _, _ in own):
                    whole = any(shaped(k, core.lower()) for k in pii.KINDS)
                    if pattern == pii.RUN and not whole and any(formed(k, core.lower().split(" ")[0]) for k in pii.KINDS):
                        continue
                    inner = pattern == pii.INSTANCE and any(a <= start and end <= b for a, b in runs)
                    if pattern == pii.RUN and whole:
                        runs.append((start, end))
                    loose.append((row, start, end, core.lower(), context_slowly(text[: m.start()]), inner))
    seeds = {(p, k, v) for _, k, _, _, v, p in base if p}
    pairs = {(p, v) for *_, v, p, _ in loose if p}
    outer = {(p, v) for *_, v, p, inner in loose if p and not inner}
    members = Counter(p for p, _ in {(p, v) for p, _, v in seeds} | outer)
    edges = {(p, v, k) for p, v in pairs for k in pii.KINDS if shaped(k, v) and (p, k, v) not in seeds}
    support, forms_of = Counter((p, k) for p, k, _ in seeds), Counter((p, k) for p, v, k in edges if (p, v) in outer)
    scores: dict = {}
    while True:
        gained, more = defaultdict(float), Counter()
        for p, v, k in edges:
            if (v, k) in scores:
                gained[p, k] += scores[v, k]
                more[p, k] += 1
        good = {(p, k): (support[p, k] + gained[p, k]) / (members[p] - forms_of[p, k] + more[p, k] + 1) for p, k in {(p, k) for p, _, k in edges} if support[p, k] + more[p, k] >= pii.SUPPORT}
        good = {x: c for x, c in good.items() if c >= pii.CONFIDENCE}
        left = defaultdict(lambda: 1.0)
        for p, v, k in edges:
            if (p, k) in good:
                left[v, k] *= 1 - good[p, k]
        before, scores = scores, {x: 1 - y for x, y in left.items() if 1 - y >= pii.SCORE}
        if len(scores) == len(before) and sum(scores.values()) - sum(before.values()) < pii.SETTLED:
            break
    added = []
    for row, start, end, v, p, _ in loose:
        kinds = [(scores[v, k], good[p, k], k) for k in pii.KINDS if (p, k) in good and (v, k) in scores]
        if kinds:
            added.append((row, start, -end, max(kinds)[2]))
    out, upto = [[(s, pii.KINDS.index(k), k, e) for r, k, s, e, _, _ in base if r == row] for row in range(len(texts))], {}
    for row, start, end, kind in sorted(set(added)):
        if -end > upto.get(row, -1):
            out[row].append((start, pii.KINDS.index(kind), kind, -end))
        upto[row] = max(upto.get(row, -1), -end)
    return [",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(x)) for x in out]


def test_bootstrap_agrees_with_a_slow_twin(spark):
    random.seed(13)
    n = lambda k: "".join(random.choice("0123456789") for _ in range(k))
    values = {
        "phone": (lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(4)}", lambda: f"({n(3)}) {n(3)} {n(4)}"),
        "email": (lambda: f"bob{n(2)}@x.example.com", lambda: f"jane{n(2)}@localhost"),
        "ip": (lambda: f"10.0.{n(1)}.{n(2)}", lambda: f"10:0:{n(1)}:{n(2)}", lambda: f"10:0:{n(4)}::{n(1)}"),
        "card": (lambda: random.choice(["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "4012888888881881"]), lambda: n(16), lambda: f"{n(4)} {n(4)} {n(4)} {n(4)}"),
        "none": (lambda: n(5), lambda: f"x{n(4)}y"),
    }
    fronts = {"call me at ": "phone", "mail to: ": "email", "gate 9 phone: ": "phone", "my host  is\n": "ip", "card no ": "card", "a" * 90 + " number ": "phone", "555-0100 or ": "none", "room 1234 5678 at ": "email", "(": "phone"}
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(random.randint(0, 4)):
            front, kind = random.choice(list(fronts.items()))
            forms = values[kind if random.random() < 0.95 else "none"]
            parts.append(front + (forms[0] if random.random() < 0.7 else random.choice(forms))())
        texts.append(random.choice([" ", " and ", ", ", "\n", ";"]).join(parts))
    texts += [f"gate 9 phone: +1 (555) 555-01{i:02d} x" for i in range(8)] + ["gate 9 phone: 555-0199"]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = spans_slowly(texts)
    assert [got[i].spans for i in range(len(texts))] == want
    assert sum(r.n_added for r in got.values()) > 50 and got[len(texts) - 1].spans == "phone:14:22"


# Chat


def test_escape_round_trip():
    random.seed(6)
    parts = [*chat.CONTROLS, "\\", "<", "|", "a", "[", "s>", "\n", "<|end|>", "<|image:0|>"]
    for _ in range(2000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_typed_parts(spark):
    parts = [{"kind": "text", "text": "see <|end|> "}, {"kind": "image", "ref": "a.png", "width": 56, "height": 30}, {"kind": "audio", "ref": "b.wav", "seconds": 2.0}, {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "text", "text": None}]
    body, attachments = chat.Visitor().visit(parts)
    assert body == "see <\\|end|> <|image:0|><|audio:1|><|document:2|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attachments] == [("image", "a.png", 4), ("audio", "b.wav", 25), ("document", "c.pdf", 768)]
    _, attachments = chat.Visitor().visit([{"kind": "audio", "seconds": 1e308}, {"kind": "audio", "seconds": 1e300}, {"kind": "image", "width": 2**31 - 1, "height": 2**31 - 1}, {"kind": "document", "pages": 2**31 - 1}])
    assert [a["tokens"] for a in attachments[:2]] == [12_500_000_000] * 2 and all(0 < a["tokens"] < 2**62 for a in attachments)
    body, attachments = chat.Visitor().visit([{"kind": "video", "ref": "v"}, None, {"kind": "audio", "seconds": float("nan")}, {"kind": "image", "width": -5}, {"kind": "document", "pages": 0}])
    assert body == "<|other:0|><|audio:1|><|image:2|><|document:3|>" and [(a["kind"], a["tokens"]) for a in attachments] == [("video", 1), ("audio", 1), ("image", 1), ("document", 256)]
    turns = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.formatted(turns).first()
    assert row.added_tokens == 797 and len(row.attachments) == 3 and row.loss_start == row.loss_end


def test_parts_cut_anywhere_read_back():
    for c in (*chat.CONTROLS, chat.START, chat.END, chat.MESSAGE, "\\", "<|image:0|>"):
        for i in range(len(c) + 1):
            body, _ = chat.Visitor().visit([{"kind": "text", "text": "x" + c[:i]}, {"kind": "text", "text": c[i:] + "y"}, {"kind": "image"}, {"kind": "text", "text": c}])
            assert chat.read_parts(body) == ["x" + c + "y", 0, c]
            assert not any(x in body.replace("<|image:0|>", "", 1) for x in chat.CONTROLS)
            assert chat.read_back(chat.START + "user" + chat.MESSAGE + body + chat.END)[0][1] == "x" + c + "y<|image:0|>" + c


def test_conversations_read_back(spark):
    rows = [(4, 0, "user", "a"), (4, 0, "user", "a b"), (4, 0, "user", "a<"), (4, 0, "user", "a<|"), (4, 0, None, "z"), (4, 0, "", "y")]
    rows += [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 3, "tool\n", "x\\y")] + [(3, i, "user" if i % 2 == 0 else "assistant", f"t{i} [INST]") for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, fragment string")
    got = {r.conv_id: r for r in chat.read_digests(chat.formatted(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = [t for _, _, role, t in own if role == "assistant"]
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == digest("".join(f"{role}\n{t}\n" for _, _, role, t in own))
        assert got[conv].loss_chars == len("".join(said)) and got[conv].loss_sha256 == digest("".join(said))
    assert chat.read_digests(chat.formatted(df.filter("false").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).count() == 0
