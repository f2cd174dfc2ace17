"""What fuzzy hashing by the Golay code can do for sets: the figures behind the choice of another method for p5."""

import golay
import numpy as np
import pytest


def draws(sets, count, seed):
    """Min-hash draws of each set (rows of element numbers, -1: none)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        rank = rng.permutation(sets.max() + 1)
        out.append(np.where(sets >= 0, rank[sets], 1 << 30).min(1))
    return np.stack(out, 1)


def words(sets, segments, draws_each, seed=0):
    """23-bit segments, each out of so many draws of 23 // draws_each bits."""
    bits = 23 // draws_each
    d = draws(sets, segments * draws_each, seed).astype(np.uint64).reshape(len(sets), segments, draws_each)
    low = (d * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.uint32)
    return sum(low[..., k] << np.uint32(bits * k) for k in range(draws_each))


def pairs(similarity, n, union=60, seed=1):
    """Two arrays of sets; row i of one has the similarity to row i of the other (None: nothing in common)."""
    rng = np.random.default_rng(seed)
    common = round(similarity * union) if similarity else 0
    left = (union - common) // 2
    a, b = [], []
    for _ in range(n):
        x = rng.permutation(20000)[: 2 * union]
        a.append(np.concatenate([x[: common + left], np.full(union - common - left, -1)]))
        b.append(np.concatenate([x[:common], x[common + left : union]]))
    width = max(map(len, a + b))
    pad = lambda rows: np.stack([np.concatenate([r, np.full(width - len(r), -1, np.int64)]) for r in rows])
    return pad(a), pad(b)


def meet(x, y, decoded):
    """Share of the segments in which two sets meet."""
    if not decoded:
        return float((x == y).mean())
    k, m = golay.nearby(x.ravel()), golay.nearby(y.ravel())
    return float(((k[:, :, None] == m[:, None, :]) & (k[:, :, None] >= 0)).any((1, 2)).mean())


@pytest.mark.parametrize("draws_each", [2, 3, 5, 7])
def test_decoding_gains_less_than_it_costs(draws_each):
    figures = {}
    for similarity in (0.5, 0.6, 0.8, None):
        a, b = pairs(similarity, 150)
        both = words(np.concatenate([a, b]), 12, draws_each)
        x, y = both[:150], both[150:]
        figures[similarity] = (meet(x, y, False), meet(x, y, True))
    print(draws_each, {k: tuple(round(v, 4) for v in f) for k, f in figures.items()})
    plain, decoded = figures[0.5]
    assert decoded > plain  # the code mends some segments at the threshold,
    assert figures[None][1] > 0.002  # but unrelated sets meet by chance, 12 bits being all that is left of 23,
    assert decoded < 0.5  # while a single draw, compared as it is, meets with 0.5 and hardly ever by chance
