import random

import numpy as np
import pytest

from spanloom.operators import aligner, substitution
from spanloom.plans import annotate

SCORES = np.array(substitution.codon_scores())


def test_scores_follow_the_genetic_code():
    at = substitution.RESIDUES.index
    assert (SCORES == SCORES.T).all() and (SCORES.diagonal() > 0).all() and (SCORES.argmax(1) == np.arange(20)).all()
    assert SCORES[at("F"), at("L")] > SCORES[at("F"), at("K")] and SCORES[at("D"), at("E")] > SCORES[at("D"), at("W")]


@pytest.mark.parametrize("scores,shares", [(SCORES, substitution.background()), (np.where(np.eye(4) > 0, 2, -3), np.full(4, 0.25)), (np.where(np.eye(4) > 0, 1, -1), np.full(4, 0.25))])
def test_lambda_solves_its_equation_and_kappa_is_that_of_the_walk(scores, shares):
    lam, kappa = substitution.solved(scores, shares)
    assert abs((np.outer(shares, shares) * np.exp(lam * scores)).sum() - 1) < 1e-6
    assert 0 < kappa < 1
    if len(scores) == 4 and scores.max() == 1:  # steps of one: kappa has a closed form
        down, up = 0.75, 0.25
        assert lam == pytest.approx(np.log(down / up)) and kappa == pytest.approx((down - up) ** 2 / down, rel=1e-3)


def test_tables_without_statistics_are_errors():
    with pytest.raises(ValueError):
        substitution.solved(np.full((4, 4), 1), np.full(4, 0.25))
    with pytest.raises(ValueError):
        substitution.solved(np.full((4, 4), -1), np.full(4, 0.25))


def test_tables_of_files():
    letters = substitution.RESIDUES[::-1] + "X*"
    lines = ["# a comment", "   " + "  ".join(letters)] + [f"{a}  " + " ".join(str(i * 30 + j) for j in range(22)) for i, a in enumerate(letters)]
    got = substitution.parsed(lines)
    assert got[0][0] == 19 * 30 + 19 and got[19][0] == 19 and got[0][19] == 19 * 30
    with pytest.raises(ValueError):
        substitution.parsed(lines[:5])


@pytest.mark.parametrize("k,least", [(1, 2), (2, 7), (2, 40)])
def test_similar_words_are_those_that_score_enough(k, least):
    word, other = substitution.similar_words(SCORES, k, least)
    split = lambda x: [x // 20 ** (k - 1 - i) % 20 for i in range(k)]
    want = {(a, b) for a in range(20**k) for b in range(20**k) if a == b or sum(SCORES[p, q] for p, q in zip(split(a), split(b))) >= least}
    assert set(zip(word.tolist(), other.tolist())) == want and len(word) == len(want) and (np.diff(word) >= 0).all()


def test_similar_seeds_find_what_the_exact_search_finds():
    r = random.Random(3)
    residues = lambda n: "".join(r.choice(substitution.RESIDUES) for _ in range(n))
    targets = [residues(47) for _ in range(150)]
    scoring = aligner.Scoring.aa()
    index = aligner.Index([f"s{i:03d}" for i in range(150)], targets, scoring)
    known = annotate.Targets(index, targets, [("IGH", "V", "J", [1] * 7, [5] * 7, 0, 0)] * 150)
    reads = [{"rid": i, "read_id": "x", "sequence": "".join(r.choice(substitution.RESIDUES) if r.random() < 0.3 * 20 / 19 else c for c in r.choice(targets))} for i in range(120)]
    got, want = ([x.get("score") or 0 for x in annotate.placed(known, annotate.Options("aa", sensitivity=s), reads)] for s in ("normal", "exact"))
    hits = sum(x > 0 for x in want)
    assert hits > 100 and sum(a == b > 0 for a, b in zip(got, want)) >= 0.95 * hits
