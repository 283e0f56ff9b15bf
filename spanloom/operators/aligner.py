"""Search and gapped alignment of batches of reads against a bounded set of targets.

The targets' seeds are an index of sorted arrays that is broadcast; its size is checked first. Seeds are spaced: some of
their places may differ, and several patterns stand in for each other. A batch of reads is looked up at once: shared seeds
are counted by read, strand, target and band of diagonals, and the best targets of each read and strand go on, with all
ties. These are scored together, row by row of a banded local alignment
with affine gaps, many pairs in one array; the best pair of each read is aligned again with its path, and the traceback
steps through many of them at once.

Scores are ours: match, mismatch and gap costs as parameters, bits and E-values by Karlin-Altschul with published
constants for these costs. Residues of other letters than the alphabet match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from spanloom.operators import substitution

#: Letters by alphabet.
LETTERS = {"nt": "ACGT", "aa": substitution.RESIDUES}


@dataclass(frozen=True)
class Scoring:
    """match and mismatch, or a table of scores over the letters. seeds: patterns of places that have to agree (1) and that
    may differ (0); least: how many of them a target needs on its diagonals. Of amino acids words that score `similar`
    against each other are seeds, too."""

    alphabet: str = "nt"
    match: int = 2
    mismatch: int = -3
    gap_open: int = 5
    gap_extend: int = 2
    lam: float = 0.625
    kappa: float = 0.41
    #: Chosen by simulation so that reads of 60 bases with 12 % of them replaced, and of 96 with 20 %, nearly always have three.
    seeds: tuple[str, ...] = ("11001011110101", "11010000111010011", "1110001010011011")
    least: int = 3
    table: tuple[tuple[int, ...], ...] | None = None
    similar: int | None = None

    @classmethod
    def fast(cls) -> Scoring:
        """Runs of eleven equal bases, three of them: for reads that are close to a scaffold."""
        return cls(seeds=("1" * 11,), least=3)

    @classmethod
    def aa(cls, table: tuple[tuple[int, ...], ...] | None = None) -> Scoring:
        """With lambda and kappa of the table, by default the one that the genetic code makes."""
        table = table or substitution.codon_scores()
        scores = np.array(table)
        lam, kappa = substitution.solved(scores, substitution.background())
        return cls("aa", int(scores.max()), int(scores.min()), 11, 1, lam, kappa, ("111",), 2, table, SIMILAR)

    def matrix(self) -> np.ndarray:
        """Scores of two codes; the last code is any other letter."""
        n = len(LETTERS[self.alphabet])
        out = np.full((n + 1, n + 1), self.mismatch, np.int32)
        if self.table is not None:
            out[:n, :n] = self.table
        else:
            out[np.arange(n), np.arange(n)] = self.match
        return out

    def codes(self, sequence: str) -> np.ndarray:
        table = np.full(256, len(LETTERS[self.alphabet]), np.uint8)
        for i, c in enumerate(LETTERS[self.alphabet]):
            table[ord(c)] = table[ord(c.lower())] = i
        return table[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]

    def bits(self, score: np.ndarray) -> np.ndarray:
        return (self.lam * score - np.log(self.kappa)) / np.log(2)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of similar seeds, as numbers; patterns of amino acids have one length."""
        (weight,) = {p.count("1") for p in self.seeds}
        return substitution.similar_words(np.array(self.table), weight, self.similar)


#: Least score of two words of three residues that are seeds of each other.
SIMILAR = 14


def packed_seeds(codes: np.ndarray, pattern: str, n_letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the seeds of a pattern whose letters are all known."""
    n = len(codes) - len(pattern) + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for i in (i for i, c in enumerate(pattern) if c == "1"):
        part = codes[i : n + i]
        value = value * n_letters + part
        ok &= part < n_letters
    at = np.flatnonzero(ok)
    return at, value[at]


class Postings:
    """Where the seeds of one pattern are in the targets: for each seed a range of places, each in a set of targets.

    Targets that begin or end alike have the same seeds at the same distance from their start or end; these are one place of
    a set of targets. Each seed of a target takes the end that more targets share with it."""

    def __init__(self, codes: list[np.ndarray], pattern: str, scoring: Scoring, longest: int):
        n = len(LETTERS[scoring.alphabet])
        self.pattern, self.n_letters = pattern, n
        parts = [packed_seeds(c, pattern, n) for c in codes]
        which = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
        at, value = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
        ahead = at + (longest - np.array([len(c) for c in codes], np.int64))[which]  # as if all targets had one end
        begin, end = (_alike(value * (longest + 1) + x) for x in (at, ahead))
        name = 2 * (value * (longest + 1) + np.where(end > begin, ahead, at)) + (end > begin)
        order = np.argsort(name, kind="stable")
        first = np.flatnonzero(np.diff(name[order], prepend=-1))
        name = name[order[first]]
        self.target, self.members, self.by_end = which[order].astype(np.int32), np.append(first, len(order)), name % 2
        self.at, value = name // 2 % (longest + 1), name // 2 // (longest + 1)
        size = n ** pattern.count("1")
        self.first = np.searchsorted(value, np.arange(size + 1)).astype(np.int64)  # a number for each possible seed
        self.like: tuple[np.ndarray, np.ndarray] | None = None
        if scoring.similar is not None:
            word, other = scoring.words()
            self.like = np.searchsorted(word, np.arange(size + 1)), other

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of coded reads in a row: places of seeds that targets have, and the ranges of these."""
        at, value = packed_seeds(codes, self.pattern, self.n_letters)
        if self.like is not None:
            first, other = self.like
            count = first[value + 1] - first[value]
            at, value = np.repeat(at, count), other[_runs(first[value], count)]
        first, count = self.first[value], self.first[value + 1] - self.first[value]
        some = count > 0
        return at[some], first[some], count[some]


class Sets:
    """The sets of targets that the postings of all patterns name. place: for each posting its set and its place, as a
    number; a posting of the k-th pattern comes start[k] after its own number."""

    def __init__(self, postings: list[Postings]):
        self.start = np.cumsum([0, *(len(p.at) for p in postings)])
        below = np.cumsum([0, *(len(p.target) for p in postings)])
        target = np.concatenate([np.zeros(0, np.int32), *(p.target for p in postings)])
        first = np.concatenate([np.zeros(0, np.int64), *(p.members[:-1] + b for p, b in zip(postings, below))])
        count = np.concatenate([np.zeros(0, np.int64), *(np.diff(p.members) for p in postings)])
        by_end = np.concatenate([np.zeros(0, np.int64), *(p.by_end for p in postings)])
        # Equal sets have equal sums of random numbers; two sums, as one of them might agree by chance.
        sums = [np.add.reduceat(_odd(target.astype(np.int64) * 2 + k), first) if len(first) else np.zeros(0, np.uint64) for k in (0, 1)]
        order = np.lexsort((*sums, count, by_end))
        new = np.zeros(len(order), bool)
        for x in (*sums, count, by_end):
            new |= np.concatenate([[True], np.diff(x[order]) != 0])[: len(order)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]  # a posting for each set
        self.count, self.by_end = count[one], by_end[one]
        self.first = np.cumsum(self.count) - self.count
        self.target = target[_runs(first[one], self.count)]
        self.place = (number << 26) + np.concatenate([np.zeros(0, np.int64), *(p.at for p in postings)])
        for p in postings:
            del p.target, p.members, p.by_end, p.at


def _alike(x: np.ndarray) -> np.ndarray:
    """How often each number occurs."""
    _, which, count = np.unique(x, return_inverse=True, return_counts=True)
    return count[which]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one range after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Index:
    """The targets and their seeds; none of these without `seeds`, where candidates are known."""

    def __init__(self, ids: list[str], sequences: list[str], scoring: Scoring, seeds: bool = True):
        self.ids, self.scoring = ids, scoring
        self.codes = [scoring.codes(s) for s in sequences]
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        n = len(LETTERS[scoring.alphabet])
        self.longest = int(self.lengths.max(initial=0))
        self.postings = [Postings(self.codes, p, scoring, self.longest) for p in scoring.seeds] if seeds and ids else []
        self.sets = Sets(self.postings)
        # All targets in a row, so that a long one does not make the others longer; one more residue stands for none.
        self.start = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.flat = np.concatenate([*self.codes, np.full(1, n, np.uint8)])
        most = np.append(np.maximum(scoring.matrix().max(1)[:n], 0), 0)
        self.most = np.concatenate([[0], np.cumsum(most[self.flat])])  # what the residues before each place can add to a score
        self._prefixes: tuple[np.ndarray, np.ndarray] | None = None

    def residues(self, target: np.ndarray, at: np.ndarray, other: int) -> np.ndarray:
        """Codes of targets at 0-based positions, which broadcast against them; `other` outside a target."""
        lengths = self.lengths[target]
        inside = (at >= 0) & (at < lengths)
        return np.where(inside, self.flat[self.start[target] + np.clip(at, 0, np.maximum(lengths - 1, 0))], other).astype(np.uint8)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the targets' prefixes of BLOCK, 2 * BLOCK, ... residues, and where each target's begin. The last one is
        of the whole target, told apart by its number."""
        if self._prefixes is None:
            counts = -(-np.maximum(self.lengths, 1) // BLOCK)
            first = np.concatenate([[0], np.cumsum(counts)])
            out = np.zeros(first[-1], np.uint64)
            weights = _odd(np.arange(BLOCK))
            state, done = np.full(len(self.ids), 1, np.uint64), 0
            while (live := np.flatnonzero(counts > done)).size:
                at = done * BLOCK + np.arange(BLOCK)
                block = self.residues(live[:, None], at[None, :], 255).astype(np.uint64) + np.uint64(1)
                state[live] = state[live] * np.uint64(0x9E3779B97F4A7C15) + (block * weights).sum(1, dtype=np.uint64)
                state[live] ^= state[live] >> np.uint64(29)
                done += 1
                out[first[live] + done - 1] = state[live]
                end = live[counts[live] == done]
                out[first[end] + done - 1] = end.astype(np.uint64)
            self._prefixes = out, first[:-1]
        return self._prefixes


def _odd(x: np.ndarray) -> np.ndarray:
    """Random odd numbers, the same each time."""
    y = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return (y ^ (y >> np.uint64(32))) * np.uint64(0xA24BAED4963EE407) | np.uint64(1)


BAND, MARGIN = 16, 12
#: Residues of a target that are aligned before pairs of one prefix part, and hopeless ones are dropped.
BLOCK = 16


#: Strands that are looked up together, and about the most postings that are sorted at once.
STRANDS, POSTINGS = 2048, 1 << 22


def candidates(index: Index, reads: list[np.ndarray], most: int, least_seeds: int = 1) -> tuple[np.ndarray, ...]:
    """Of coded reads: arrays of read, target, lowest and highest diagonal and seeds of the best targets, by read and
    target. What counts are the seeds of all patterns that are shared in the densest band of diagonals and the two on either
    side of it. The `most` targets with the most go on, with all that equal the last of them."""
    out: list[tuple] = []
    other = len(LETTERS[index.scoring.alphabet])
    gap = np.full(max((len(p) for p in index.scoring.seeds), default=0), other, np.uint8)  # no seed reaches over it
    for begin in range(0, len(reads) if index.postings else 0, STRANDS):
        some = reads[begin : begin + STRANDS]
        lengths = np.array([len(c) for c in some], np.int64)
        start = np.cumsum(lengths + len(gap)) - lengths - len(gap)
        flat = np.concatenate([x for c in some for x in (c, gap)])
        found = [p.found(flat) for p in index.postings]
        at, first, count = (np.concatenate(c) for c in zip(*((x, y + k, z) for (x, y, z), k in zip(found, index.sets.start))))
        owner = np.searchsorted(start, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        at, first, count, owner = (x[order] for x in (at, first, count, owner))
        below = np.concatenate([[0], np.cumsum(np.bincount(owner, count, len(some)).astype(np.int64))])
        a = 0
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(below, below[a] + POSTINGS, "right")) - 1)
            part = slice(*np.searchsorted(owner, [a, b]))
            out.append(_densest(index, owner[part] + begin, at[part] - start[owner[part]], first[part], count[part], -(-int(lengths[a:b].max()) // BAND) * BAND, most, max(least_seeds, 1)))
            a = b
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def _densest(index: Index, read: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray, zero: int, most: int, least: int) -> tuple[np.ndarray, ...]:
    """candidates() of seeds that are in the order of their reads. No diagonal is below minus zero."""
    total = int(count.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 5
    base, sets, low = int(read[0]), index.sets, (1 << 26) - 1
    key = np.repeat(((read - base) << 52) + zero - at, count)
    key += sets.place[_runs(first, count)]
    key.sort()
    # Seeds on one diagonal of a set are counted before the set becomes its targets.
    first = np.flatnonzero(np.diff(key, prepend=-1))
    seeds, key = np.diff(first, append=total), key[first]
    which = key >> 26 & low
    n = sets.count[which]
    target = sets.target[_runs(sets.first[which], n)].astype(np.int64)
    key = np.repeat(key - (which << 26) - sets.by_end[which] * index.longest, n)
    key += (target << 26) + np.repeat(sets.by_end[which], n) * index.lengths[target]
    order = np.argsort(key)
    key, below = key[order], np.concatenate([[0], np.cumsum(np.repeat(seeds, n)[order])])
    cell = key // BAND
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    size, owner = np.diff(below[np.append(first, len(key))]), key[first] >> 26
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    # Most targets share one cell or two with a read by chance; those that cannot have enough seeds are left out early.
    enough = np.add.reduceat(size, start) >= least
    start, length = start[enough], np.diff(start, append=len(owner))[enough]
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    cells = _runs(start, length)
    ahead = np.cumsum(length) - length
    full = np.flatnonzero(size[cells] == np.repeat(np.maximum.reduceat(size[cells], ahead), length))
    dense = cell[first[cells[full[np.searchsorted(full, ahead)]]]]
    left, right = np.searchsorted(cell, dense - 2), np.searchsorted(cell, dense + 3)
    near, name = below[right] - below[left], owner[start]
    whose = name >> 26
    order = np.lexsort((-near, whose))
    rank = np.arange(len(order)) - np.searchsorted(whose[order], whose[order])
    bar = np.full(int(whose[-1]) + 1, least)
    last = order[rank == most - 1]
    bar[whose[last]] = np.maximum(near[last], least)
    keep = near >= bar[whose]
    lowest, highest = ((key[x] & low) - zero for x in (left[keep], right[keep] - 1))
    return whose[keep] + base, name[keep] & low, lowest, highest, near[keep]


def every_pair(index: Index, reads: list[np.ndarray], found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Like candidates(), which gave `found`, of all reads with all targets, over all diagonals."""
    n, m = len(reads), len(index.ids)
    read, target = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    near = np.zeros(n * m, np.int64)
    near[found[0] * m + found[1]] = found[4]
    return read, target, -np.array([len(r) for r in reads], np.int64)[read], index.lengths[target], near


def widths(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Diagonals that each pair is aligned over, in steps, so that pairs of one width can go together."""
    return -(-(high - low + 2 * MARGIN + 1) // BAND) * BAND


def chunks(reads: list[np.ndarray], read: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int, pairs: int = 2048) -> Iterator[np.ndarray]:
    """Numbers of pairs that have one width and similar lengths, at most so many pairs or cells at once."""
    lengths, wide = np.array([len(reads[r]) for r in read], np.int64), widths(low, high)
    order = np.lexsort((lengths, wide))
    for part in np.split(order, np.flatnonzero(np.diff(wide[order])) + 1) if len(order) else []:
        done = len(part)
        while done:
            n = min(pairs, done, max(1, cells // max(1, int(lengths[part[done - 1]] * wide[part[0]]))))
            yield part[done - n : done]
            done -= n


def scores(index: Index, reads: list[np.ndarray], read: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray | None = None, group: np.ndarray | None = None, bar: np.ndarray | None = None) -> np.ndarray:
    """The scores of align(), without paths. Outside a target or read nothing matches, so scores only fall there.

    group: of pairs that compete. Of each group the one with the most seeds (near) is scored first; what cannot reach its
    score any more, however the rest of the target goes, is dropped, and gets a score that is too small. The best ones of
    each group are always exact. bar: for each group a score that has to be exceeded; what cannot is dropped, too."""
    out = np.zeros(len(read), np.int32)
    least = np.zeros(len(read), np.int32) if bar is None else bar[group] + 1
    todo, bar = np.ones(len(read), bool), least
    if group is not None and len(read):
        order = np.lexsort((-near, group))
        first = order[np.diff(group[order], prepend=-1) > 0]
        _score(index, reads, read, target, low, high, first, bar, out)
        todo[first] = False
        reached = np.zeros(int(group.max()) + 1, np.int32)
        reached[group[first]] = out[first]
        bar = np.maximum(reached[group], least)
    _score(index, reads, read, target, low, high, np.flatnonzero(todo), bar, out)
    return out


def _score(index: Index, reads: list[np.ndarray], read: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray, some: np.ndarray, bar: np.ndarray, out: np.ndarray) -> None:
    """Scores of some of the pairs, into out."""
    wide = widths(low[some], high[some])
    order = some[np.lexsort((target[some], read[some], wide))]
    wide = widths(low[order], high[order])
    cuts = np.flatnonzero(np.diff(wide)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        width = int(widths(low[part[:1]], high[part[:1]])[0])
        step = max(1, min(8192, (1 << 18) // width))
        for k in range(0, len(part), step):
            p = part[k : k + step]
            out[p] = _prefix_scores(index, reads, read[p], target[p], low[p] - MARGIN, width, bar[p])


def _prefix_scores(index: Index, reads: list[np.ndarray], read: np.ndarray, target: np.ndarray, base: np.ndarray, width: int, bar: np.ndarray) -> np.ndarray:
    """Row by row of the targets, in blocks. Pairs of one read, band and prefix of the target are one node until their
    targets part. h, e, f hold a node's last row over its diagonals; these run backwards, so that read positions rise."""
    s, other = index.scoring, len(LETTERS[index.scoring.alphabet])
    hashes, start = index.prefixes()
    names, which = np.unique(read, return_inverse=True)
    lengths = np.array([len(reads[r]) for r in names], np.int64)
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([*(reads[r] for r in names), np.zeros(1, np.uint8)])
    flat = np.where(flat < other, flat, other + 1).astype(np.uint8)  # letters that are no residue match nothing
    sizes = index.lengths[target]
    kind = np.int16 if (int(min(lengths.max(), sizes.max(initial=0))) + width) * max(s.match, s.gap_extend) < 14_000 else np.int32
    more, opening, extend = kind(s.match - s.mismatch), kind(s.gap_open), kind(s.gap_extend)
    table = None
    if s.table is not None:  # letters that are no residue score as the worst do
        table = np.full((other + 1, other + 2), s.mismatch, kind)
        table[: other + 1, : other + 1] = s.matrix()
        table = table.ravel()
    ext = (np.arange(width) * s.gap_extend).astype(kind)[:, None]
    back = -(base + width - 1)  # a node's read position is the row plus this plus the number of its diagonal
    out = np.zeros(len(read), np.int32)
    live = np.arange(len(read))
    node = np.zeros(len(read), np.int64)  # of each live pair, in the states
    h, f, best = np.zeros((width, 1), kind), np.full((width + 1, 1), -14_000, kind), np.zeros(1, np.int64)
    for level in range(int(-(-sizes.max(initial=0) // BLOCK))):
        key = hashes[start[target[live]] + level]
        order = np.lexsort((key, base[live], which[live]))
        a, b = order[1:], order[:-1]
        new = np.concatenate([[True], (key[a] != key[b]) | (base[live[a]] != base[live[b]]) | (which[live[a]] != which[live[b]])])
        own = np.empty(len(live), np.int64)
        own[order] = np.cumsum(new) - 1
        head = order[new]  # a pair for each node
        h, f, best = h[:, node[head]], f[:, node[head]], best[node[head]]
        node = own
        lead = live[head]
        rows = min(BLOCK, int(sizes[lead].max()) - level * BLOCK)
        at = level * BLOCK + np.arange(rows)
        t = index.residues(target[lead], at[:, None], other)
        q_at = level * BLOCK + np.arange(rows + width)[:, None] + back[lead]
        n = lengths[which[lead]]
        q = np.where((q_at >= 0) & (q_at < n), flat[offset[which[lead]] + np.clip(q_at, 0, np.maximum(n - 1, 0))], other + 1)
        rows_of = t.astype(np.int32) * (other + 2) if table is not None else None
        top = np.zeros(h.shape, kind)
        above = np.zeros((width + 1, len(lead)), kind)
        for i in range(rows):
            if table is None:
                step = (q[i : i + width] == t[i]) * more
                step += kind(s.mismatch)
            else:
                step = table[rows_of[i] + q[i : i + width]]
            step += h
            above[:-1] = h
            np.maximum(above[1:] - opening, f[1:] - extend, out=f[:-1])
            np.maximum(step, f[:-1], out=step)
            np.maximum(step, 0, out=step)
            run = step + ext
            by = 1
            while by < width:  # running maximum over the diagonals
                run[by:] = np.maximum(run[by:], run[:-by])
                by *= 2
            h = step
            np.maximum(h[1:], run[:-1] - (ext[:-1] + opening), out=h[1:])
            np.maximum(top, h, out=top)
        best = np.maximum(best, top.max(0))
        # What a pair can reach: the best so far, or its last row and a match for each residue that is left and can match.
        left, end = sizes[live] - (level + 1) * BLOCK, index.start[target[live]] + sizes[live]
        rest = index.most[end] - index.most[end - np.maximum(left, 0)]
        reach = np.maximum(best[node], h.max(0).astype(np.int64)[node] + rest)
        done = (left <= 0) | (reach < bar[live])
        out[live[done]] = best[node[done]]
        live, node = live[~done], node[~done]
        if not len(live):
            break
    return out


@dataclass
class Alignments:
    """Arrays over pairs. ops: 1 aligned, 2 gap in the target, 3 gap in the query, from the last column to the first."""

    score: np.ndarray
    qstart: np.ndarray
    qend: np.ndarray
    tstart: np.ndarray
    tend: np.ndarray
    ops: np.ndarray
    n_ops: np.ndarray


def align(index: Index, reads: list[np.ndarray], read: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray, junction: tuple[np.ndarray, np.ndarray] | None = None) -> Alignments:
    """Best local alignment of each pair within its band of diagonals. Of equal ones a gap goes as far to the left as it can;
    junction: for each pair the last residue of V and of what lies between V and J in its target (0-based), where a gap goes
    rather than into V or J."""
    s = index.scoring
    matrix, other = s.matrix(), len(LETTERS[s.alphabet])
    pairs = len(read)
    lengths = np.array([len(reads[r]) for r in read], np.int64)
    rows = int(lengths.max(initial=0))
    width = int(widths(low, high).max(initial=BAND))
    base = low - MARGIN
    q = np.full((pairs, rows), other, np.uint8)
    for i, r in enumerate(read):
        q[i, : lengths[i]] = reads[r]
    t_len = index.lengths[target]
    minus = np.int32(-(1 << 28))
    cols = np.arange(width)
    ext = (cols * s.gap_extend).astype(np.int32)
    h = np.zeros((pairs, width), np.int32)
    f = np.full((pairs, width), minus, np.int32)
    how = np.zeros((rows, pairs, width), np.uint8)
    best, at_row, at_col = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    shift = lambda x, fill: np.concatenate([x[:, 1:], np.full((pairs, 1), fill, np.int32)], 1)
    every = np.arange(pairs)
    for i in range(rows):
        j = base[:, None] + i + cols
        inside = (j >= 0) & (j < t_len[:, None]) & (i < lengths)[:, None]
        t = index.residues(target[:, None], j, other)
        step = h + matrix[q[:, i][:, None], t]
        opened, longer = shift(h, 0) - s.gap_open, shift(f, minus) - s.gap_extend
        f = np.maximum(opened, longer)
        h0 = np.maximum(np.maximum(step, f), 0)
        h0 = np.where(inside, h0, 0)
        run = np.maximum.accumulate(h0 + ext, 1)
        e = np.full((pairs, width), minus, np.int32)
        e[:, 1:] = run[:, :-1] - s.gap_open - ext[:-1]
        h = np.where(inside, np.maximum(h0, e), 0)
        kind = np.where(h <= 0, 0, np.where(h == step, 1, np.where(h == f, 2, 3))).astype(np.uint8)
        if junction is not None:
            between = (j >= junction[0][:, None]) & (j <= junction[1][:, None]) & (kind == 1)
            kind[between & (h == e) & (j > junction[0][:, None])] = 3
            kind[between & (h == f)] = 2
        how[i] = kind | ((f == longer) << 2).astype(np.uint8)
        # A gap in the query goes on if the cell before it was not where the best run began.
        how[i, :, 1:] |= ((e[:, 1:] == e[:, :-1] - s.gap_extend) << 3).astype(np.uint8)
        f = np.where(inside, f, minus)
        top = h.argmax(1)
        value = h[every, top]
        more = value > best
        best[more], at_row[more], at_col[more] = value[more], i, top[more]
    # Traceback, all pairs at once.
    row, col, state = at_row.copy(), at_col.copy(), np.zeros(pairs, np.int64)
    ops, n_ops = np.zeros((rows + width + rows, pairs), np.uint8), np.zeros(pairs, np.int64)
    live = best > 0
    while live.any():
        p = np.flatnonzero(live)
        cell = how[row[p], p, col[p]]
        kind = np.where(state[p] > 0, state[p], cell & 3)
        done = kind == 0
        p, cell, kind = p[~done], cell[~done], kind[~done]
        live[:] = False
        live[p] = True
        ops[n_ops[p], p] = kind
        n_ops[p] += 1
        state[p] = np.where((kind == 2) & (cell & 4 > 0), 2, np.where((kind == 3) & (cell & 8 > 0), 3, 0))
        row[p] -= kind != 3
        col[p] += np.where(kind == 2, 1, np.where(kind == 3, -1, 0))
        out = (row[p] < 0) | (col[p] < 0) | (col[p] >= width)
        live[p[out]] = False
    steps = ops[: int(n_ops.max(initial=0))]
    q_used, t_used = (steps == 1).sum(0) + (steps == 2).sum(0), (steps == 1).sum(0) + (steps == 3).sum(0)
    qend, tend = at_row + 1, base + at_row + at_col + 1
    return Alignments(best, qend - q_used + 1, qend, tend - t_used + 1, tend, steps.T, n_ops)


def strings(a: Alignments, i: int, query: str, target: str) -> tuple[str, str, str]:
    """qaln, taln and CIGAR of pair i."""
    ops = a.ops[i, : a.n_ops[i]][::-1]
    q, t, qp, tp = [], [], int(a.qstart[i]) - 1, int(a.tstart[i]) - 1
    cigar, cuts = "", np.flatnonzero(np.diff(ops)) + 1
    for part in np.split(ops, cuts) if len(ops) else []:
        n, op = len(part), int(part[0])
        q.append(query[qp : qp + n] if op != 3 else "-" * n)
        t.append(target[tp : tp + n] if op != 2 else "-" * n)
        qp, tp = qp + n * (op != 3), tp + n * (op != 2)
        cigar += f"{n}{'MID'[op - 1]}"
    return "".join(q), "".join(t), cigar


def positions(a: Alignments, i: int) -> tuple[np.ndarray, np.ndarray]:
    """1-based query and target positions of the aligned columns of pair i."""
    ops = a.ops[i, : a.n_ops[i]][::-1]
    qp, tp = a.qstart[i] - 1 + np.cumsum(ops != 3), a.tstart[i] - 1 + np.cumsum(ops != 2)
    return qp[ops == 1], tp[ops == 1]
