"""The near-dedup stage's pivot distance tables: what they discard, and that no pair within the band is lost."""

import numpy as np
import pytest

from tablemill.llm import near_copies


def some_units(rng):
    """Units of unrelated fingerprints and of ones 0 to 60 bits off some of them, in any order."""
    unit, wide = [], []
    for u, n in enumerate([2, 3, 7, 40, 200]):
        bits = rng.integers(0, 2, (n, 256), np.uint8)
        for k in range(n // 3, n):
            bits[k] = bits[rng.integers(0, max(1, n // 3))]
            bits[k, rng.choice(256, rng.integers(0, 61), replace=False)] ^= 1
        wide.append(np.packbits(bits, axis=1).view(np.uint64))
        unit += [u] * n
    order = rng.permutation(len(unit))
    return np.array(unit)[order], np.concatenate(wide)[order]


def test_tables_discard_and_lose_no_pair():
    unit, wide = some_units(np.random.default_rng(4))
    order = np.argsort(unit, kind="stable")
    unit, wide = unit[order], wide[order]
    table = np.array(near_copies.distance_table(unit, wide))
    assert table.shape == (near_copies.N_PIVOTS, len(unit))
    a, b = np.triu_indices(len(unit), 1)
    a, b = a[unit[a] == unit[b]], b[unit[a] == unit[b]]
    near = np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= near_copies.BAND
    stays = (np.abs(table[:, a] - table[:, b]) <= near_copies.BAND).all(0)
    assert near.any() and stays[near].all()
    assert (~stays).sum() > 0.1 * (~near).sum()
    assert near_copies.distance_table(unit[:0], wide[:0]) == []


def test_links_pass_the_tables_first(monkeypatch):
    """What a table tells apart isn't compared: with one that tells all rows apart no link is left."""
    unit, wide = some_units(np.random.default_rng(5))
    size, part, whole = np.full(len(unit), 50), np.zeros(len(unit), int), np.ones(len(unit), bool)
    assert len(near_copies.links_in_units(unit, size, wide, part, whole)[0])
    monkeypatch.setattr(near_copies, "distance_table", lambda unit, wide: [np.arange(len(unit)) * 1000])
    assert not len(near_copies.links_in_units(unit, size, wide, part, whole)[0])


@pytest.mark.parametrize("pieces", [1, 3])
def test_links_join_every_near_pair(pieces):
    unit, wide = some_units(np.random.default_rng(6))
    n = len(unit)
    part = np.arange(n) % pieces
    i, j = near_copies.links_in_units(unit, np.full(n, 50), wide, part, np.full(n, pieces == 1))
    a, b = np.triu_indices(n, 1)
    near = (unit[a] == unit[b]) & ((pieces == 1) | (part[a] != part[b])) & (np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= near_copies.BAND)

    def labels(pairs):
        label = np.arange(n)
        for x, y in pairs:
            label[label == label[x]] = label[y]
        return [int(np.flatnonzero(label == k)[0]) for k in label]

    assert labels(zip(a[near], b[near], strict=True)) == labels(zip(i, j, strict=True))
