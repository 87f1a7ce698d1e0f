"""Bin completion against the lower bound, a piece-by-piece best fit and the optimum of small cases."""

import random
from collections import Counter

import pytest

from tablemill.llm import packing

RNG = random.Random(5)
HISTOGRAMS = {
    "1,000 of 100": {100: 1000},
    "100,000 of 20": {20: 100_000},
    "5,000 of 1": {1: 5000},
    "1,000 of 500 and 3,000 of 40": {500: 1000, 40: 3000},
    "5,000 of 1 to 40": Counter(RNG.randint(1, 40) for _ in range(5000)),
    "3,000 of 300 to 1,100": Counter(RNG.randint(300, 1100) for _ in range(3000)),
}


def pieces_of(plan, capacity):
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= capacity and times > 0
        used.update({k: times * n for k, n in Counter(pattern).items()})
    return used


def best_fit_by_piece(counts, capacity):
    """Free space of each sequence, pieces put one by one into the fullest that holds them."""
    free = []
    for piece in sorted(Counter(counts).elements(), reverse=True):
        at = min((k for k, f in enumerate(free) if f >= piece), key=free.__getitem__, default=None)
        if at is None:
            free.append(capacity - piece)
        else:
            free[at] -= piece
    return free


def optimum(pieces, capacity):
    best = len(pieces)

    def put(at, free):
        nonlocal best
        if len(free) >= best:
            return
        if at == len(pieces):
            best = len(free)
            return
        for f in {f for f in free if f >= pieces[at]}:
            rest = list(free)
            rest.remove(f)
            put(at + 1, [*rest, f - pieces[at]])
        put(at + 1, [*free, capacity - pieces[at]])

    put(0, [])
    return best


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_short_pieces_share_sequences(name):
    counts = HISTOGRAMS[name]
    plan = packing.bin_completion(counts, 2048)
    assert pieces_of(plan, 2048) == Counter(counts)
    bound = max(-(-sum(k * n for k, n in counts.items()) // 2048), *(-(-n // (2048 // k)) if len(counts) == 1 else 0 for k, n in counts.items()), 1)
    assert bound <= sum(n for _, n in plan) <= 1.01 * bound


def test_best_fit_is_piece_by_piece():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.choice([10, 60, 200])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 90)))
        plan = packing.best_fit(counts, capacity)
        assert pieces_of(plan, capacity) == counts
        assert sorted(best_fit_by_piece(counts, capacity)) == sorted(capacity - sum(p) for p, n in plan for _ in range(n))


def test_small_cases_reach_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        pieces = sorted((rng.randint(8, 60) for _ in range(rng.randint(1, 10))), reverse=True)
        assert sum(n for _, n in packing.bin_completion(Counter(pieces), 100)) == optimum(pieces, 100)


def test_fullest_has_the_least_waste():
    rng = random.Random(2)
    for _ in range(80):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
        space, lengths = rng.randint(1, 70), list(counts)
        sums = {0}
        for piece in counts.elements():
            sums |= {s + piece for s in sums if s + piece <= space}
        got = packing.fullest(lengths, counts, space)
        assert sum(got) == max(sums) and not Counter(got) - counts


def test_places_of_a_plan():
    plan = [((5, 3, 3), 2), ((3,), 1), ((1,) * 11, 3)]
    places = packing.Places(plan)
    got = Counter((places.find(n, k), n) for n, many in {5: 2, 3: 5, 1: 33}.items() for k in range(many))
    want = Counter()
    for s, pattern in enumerate(p for p, n in plan for _ in range(n)):
        at = 0
        for n in pattern:
            want[(s, at), n] += 1
            at += n
    assert got == want
