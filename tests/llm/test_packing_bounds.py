"""Packings of lengths of which few fit, against bounds and brute force."""

import itertools
import random
from collections import Counter

import pytest

from quadloom.llm import packing


@pytest.mark.parametrize(("n", "low", "high", "most"), [(3000, 1300, 1450, 1.012), (900, 1340, 1420, 1.012), (300, 1300, 1450, 1.02), (3000, 900, 1100, 1.0)])
def test_three_or_four_that_just_fit(n, low, high, most):
    rng = random.Random(1)
    counts = Counter(rng.randrange(low, high + 1) for _ in range(n))
    bins = packing.pack_histogram(dict(counts), 4096)
    got = Counter()
    for filling, times in bins:
        assert sum(filling) <= 4096
        for x in filling:
            got[x] += times
    assert got == counts
    assert sum(t for _, t in bins) <= most * packing.least_by_number(counts, 4096)


def fewest(lengths, capacity):
    """The least number of bins, by trying every way."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            left = list(rooms)
            left.remove(r)
            place(i + 1, [*left, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_bounds_are_below_the_least_and_packings_meet_it():
    rng = random.Random(3)
    for low, high in itertools.product((1, 5, 12), (14, 20, 40)):
        for _ in range(20):
            lengths = sorted((rng.randrange(low, high) for _ in range(rng.randrange(1, 9))), reverse=True)
            counts, least = Counter(lengths), fewest(lengths, 40)
            assert packing.least_by_number(counts, 40) <= least and packing.least_bins(counts, 40) <= least
            assert sum(t for _, t in packing.pack_histogram(dict(counts), 40)) == least


def test_bound_of_nothing():
    assert packing.least_by_number({}, 10) == 0 and packing.pack_histogram({}, 10) == [] and packing.pack_histogram({3: 0}, 10) == []
