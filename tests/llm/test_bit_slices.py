"""Bit-sliced comparison of fingerprints against plain counting."""

import random

import numpy as np
import pytest

from marram.llm import simhash


def clusters(draw: random.Random, n: int) -> list[int]:
    out: set[int] = set()
    while len(out) < n:
        x = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 9)):
            out.add(x)
            for _ in range(draw.randrange(0, 5)):
                x ^= 1 << draw.randrange(64)
    return sorted(out)[:n]


def components(values: list[int], links) -> dict[int, int]:
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 11, 20])
def test_distances(radius):
    draw = random.Random(radius)
    values = np.array(clusters(draw, 200), dtype=np.uint64)
    filled = np.concatenate([values, np.zeros(56, np.uint64)])
    queries = np.repeat(np.arange(200), 4)
    words = np.tile(np.arange(4), 200)
    hits = simhash.near(simhash.planes_of(filled), values[queries], words, radius)
    got = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(200, 256)[:, :200]
    assert (got == (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)).all()


@pytest.mark.parametrize("sizes", [[2, 3, 1, 64, 65, 130, 2], [700]])
def test_units_one_and_two_sided(sizes):
    draw = random.Random(len(sizes))
    values = np.array([v for n in sizes for v in clusters(draw, n)], dtype=np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for two in (False, True):
        lefts = starts + np.array(sizes) // 2 if two else ends
        use = lefts > starts
        got = simhash.unit_links(values, starts[use], lefts[use], ends[use], 4).tolist()
        for a, m, b in zip(starts[use], lefts[use], ends[use], strict=True):
            own = values[a:b].tolist()
            want = [(x, y) for i, x in enumerate(own) for j, y in enumerate(own) if i < j and (x ^ y).bit_count() <= 4 and (not two or i < m - a <= j)]
            assert components(own, want) == components(own, [x for x in got if x[0] in own and x[1] in own])


def test_keys_beyond_a_part(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 40)
    draw = random.Random(7)
    base = draw.getrandbits(64)
    values = sorted({base ^ (draw.getrandbits(64) & 0xFFF) for _ in range(400)} | set(clusters(draw, 300)))
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(table).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    want = [(x, y) for i, x in enumerate(values) for y in values[:i] if (x ^ y).bit_count() <= 4]
    assert components(values, links) == components(values, want) and len(want) > 5000


def test_hot_fingerprints_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 5)
    texts = [(k, "the same words in every copy of this one") for k in range(50)] + [(100 + k, f"other words {k} " * 3) for k in range(20)] + [(None, None)] * 8
    got = simhash.label_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == 78 and {r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 50} == {0}
