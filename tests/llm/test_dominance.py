"""Dominating sets against all ways to pack small instances."""

import random
from functools import lru_cache

from marram.llm import packing


def fewest(sizes: tuple[int, ...], capacity: int) -> int:
    """The least number of bins, by trying every bin for every size."""

    @lru_cache(maxsize=None)
    def place(left: tuple[int, ...], rooms: tuple[int, ...]) -> int:
        if not left:
            return 0
        size, rest = left[0], left[1:]
        best = 1 + place(rest, tuple(sorted((*rooms, capacity - size))))
        for k, room in enumerate(rooms):
            if room >= size and (k == 0 or rooms[k - 1] != room):
                best = min(best, place(rest, tuple(sorted((*rooms[:k], room - size, *rooms[k + 1 :])))))
        return best

    return place(tuple(sorted(sizes, reverse=True)), ())


def test_fixed_sets_lose_nothing():
    """Whatever is fixed, the rest can still be packed into as few bins as the whole."""
    rng, fixed_some = random.Random(6), 0
    for _ in range(400):
        capacity = rng.randrange(5, 14)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.dominating_sets(counts, capacity)
        used = [s for times, own in fixed for s in own * times]
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sorted(used + left) == sorted(sizes) and all(sum(own) <= capacity for _, own in fixed)
        bins = sum(times for times, _ in fixed)
        assert bins + fewest(tuple(left), capacity) == fewest(tuple(sizes), capacity), (capacity, sizes, fixed)
        fixed_some += bool(fixed)
        planned = packing.plan(counts, capacity)[1]
        assert fewest(tuple(sizes), capacity) <= planned <= fewest(tuple(sizes), capacity) + 1
    assert fixed_some > 300


def test_equal_sizes_in_great_numbers():
    """Counts, not pieces, are planned: a million pieces take no longer than a few."""
    rows, sequences = packing.plan({2048: 10**6, 1500: 10**6, 548: 10**6, 1: 5}, 2048)
    assert sequences == 2 * 10**6 + 1 and len(rows) < 20
