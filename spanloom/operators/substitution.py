"""Scores of replaced residues from a rule, and the statistics of a table of scores.

The rule: residues change as their codons do when every base mutates alike. A score is the logarithm of how much likelier
two residues stand for each other than by chance, so replacements by one base cost least. Any other square table, such as a
published one read from its file, can take its place.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from math import exp

import numpy as np

from spanloom.functions import sequences as sq

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


@cache
def codon_scores(changed: float = 0.25, units: float = 2.0) -> tuple[tuple[int, ...], ...]:
    """Whole scores over RESIDUES, in 1 / `units` bits, where a base is changed with this probability."""
    codons = {c: a for c, a in sq.codon_table().items() if a != "*"}
    own = {a: [c for c in codons if codons[c] == a] for a in RESIDUES}
    step = lambda x, y: np.prod([1 - changed if p == q else changed / 3 for p, q in zip(x, y)])
    kept = {a: sum(step(x, y) for x in own[a] for y in codons) / len(own[a]) for a in RESIDUES}
    out = []
    for a in RESIDUES:
        row = [sum(step(x, y) for x in own[a] for y in own[b]) / len(own[a]) / kept[a] for b in RESIDUES]
        out.append([p / (len(own[b]) / len(codons)) for p, b in zip(row, RESIDUES)])
    odds = np.array(out)
    scores = np.rint(units * np.log2(np.sqrt(odds * odds.T))).astype(int)
    return tuple(map(tuple, scores.tolist()))


def parsed(lines: Iterable[str]) -> tuple[tuple[int, ...], ...]:
    """Scores over RESIDUES from the lines of a table with a header of letters and a letter before each row; comments begin
    with #, and other letters are left out."""
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    head, body = rows[0], {r[0]: dict(zip(rows[0], r[1:])) for r in rows[1:]}
    if missing := [a for a in RESIDUES if a not in body or a not in head]:
        raise ValueError(f"no scores of {''.join(missing)}")
    return tuple(tuple(int(body[a][b]) for b in RESIDUES) for a in RESIDUES)


def background() -> np.ndarray:
    """How often residues are, by their codons."""
    codons = [a for a in sq.codon_table().values() if a != "*"]
    return np.array([codons.count(a) / len(codons) for a in RESIDUES])


def spectrum(scores: np.ndarray, shares: np.ndarray) -> tuple[int, np.ndarray]:
    """The lowest score, and the chance of each score from there on, of two residues drawn by their shares."""
    low = int(scores.min())
    return low, np.bincount((scores - low).ravel(), np.outer(shares, shares).ravel())


def solved(scores: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Lambda and kappa of ungapped alignments: lambda makes the mean of exp(lambda * score) 1; kappa from the walk's sums.
    A mean score that is not below 0, or no score above it, has neither."""
    low, chance = spectrum(scores, shares)
    values = np.arange(low, low + len(chance))
    if (values * chance).sum() >= 0 or scores.max() <= 0:
        raise ValueError("scores must be negative on average, and some positive")
    excess = lambda x: (chance * np.exp(x * values)).sum() - 1
    a, b = 1e-9, 1.0
    while excess(b) < 0:
        b *= 2
    for _ in range(200):
        middle = (a + b) / 2
        a, b = (middle, b) if excess(middle) < 0 else (a, middle)
    lam = (a + b) / 2
    entropy = lam * (values * chance * np.exp(lam * values)).sum()
    walk, sigma = np.ones(1), 0.0
    for k in range(1, 80):
        walk = np.convolve(walk, chance)
        at = np.arange(k * low, k * low + len(walk))
        sigma += (walk[at >= 0].sum() + (walk[at < 0] * np.exp(lam * at[at < 0])).sum()) / k
    unit = int(np.gcd.reduce(np.abs(values[chance > 0])))
    return lam, unit * lam * exp(-2 * sigma) / (entropy * (1 - exp(-lam * unit)))


def similar_words(scores: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words of k residues, as numbers in the base of the residues, that score at least `least` against each
    other, or are equal. Words grow letter by letter; what cannot reach the score any more is cut off."""
    n = len(scores)
    word = np.arange(n**k)
    letter = np.array([word // n ** (k - 1 - i) % n for i in range(k)])
    best = scores.max(1)
    rest = np.concatenate([np.cumsum(best[letter[::-1]], 0)[::-1], np.zeros((1, n**k), np.int64)])  # the most that letters from i on can add
    grown, total = np.zeros_like(word), np.zeros_like(word)
    for i in range(k):
        total = (total[:, None] + scores[letter[i][word]]).ravel()
        grown = (grown[:, None] * n + np.arange(n)).ravel()
        word = np.repeat(word, n)
        keep = (total + rest[i + 1][word] >= least) | (grown == word // n ** (k - 1 - i))
        word, grown, total = word[keep], grown[keep], total[keep]
    return word, grown


