"""Vector codes: trees against all distances, and awkward tables against plain Python."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from marram.llm import codes


@pytest.mark.parametrize("width", [1, 2, 8])
@pytest.mark.parametrize("spread", [2, 50, 1 << 20])
def test_tree_equals_all_distances(width, spread):
    """With few different values most distances tie."""
    rng = np.random.default_rng(width * spread)
    for n in (1, 2, 3, 16):
        entries = rng.integers(-spread, spread, (n, width))
        parts = np.concatenate([rng.integers(-spread, spread, (500, width)), entries])
        best, least = codes.Tree(entries).assign(parts)
        whole = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert best.tolist() == whole.argmin(axis=1).tolist() and least.tolist() == whole.min(axis=1).tolist()


def test_tree_skips_far_sides(monkeypatch):
    seen = []
    offer = codes.Tree.offer
    monkeypatch.setattr(codes.Tree, "offer", lambda self, e, parts, rows, *more: seen.append(len(rows)) or offer(self, e, parts, rows, *more))
    entries = np.arange(16)[:, None] * 1000
    codes.Tree(entries).assign(np.repeat(entries, 100, axis=0) + 3)
    assert sum(seen) < 0.7 * 16 * 1600


def brute(rows):
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, v, l in rows if v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: v[2 * p : 2 * p + 2]
    books = [[cut(v, p) for _, _, v in kept[:16]] for p in range(8)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        groups = defaultdict(list)
        for _, _, v in kept:
            for p in range(8):
                groups[p, nearest(p, cut(v, p))[1]].append(cut(v, p))
        books = [[[sum(c) // len(c) for c in zip(*groups[p, k], strict=True)] if groups[p, k] else e for k, e in enumerate(books[p])] for p in range(8)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, l, [nearest(p, cut(v, p)) for p in range(8)]) for i, l, v in kept]
    totals = defaultdict(int)
    for _, l, own in found:
        totals[l] += sum(d for d, _ in own)
    return sorted(repr((i, "".join(f"{k:02x}" for _, k in own), sum(d for d, _ in own), totals[l], digest)) for i, l, own in found)


@pytest.mark.parametrize("n", [3, 16, 90])
def test_awkward_vectors(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [(int(rng.integers(0, 2 * n)), np.round(rng.normal(size=16), 2).astype(np.float32).tolist(), [None, 1, 2][k % 3]) for k in range(n)]
    rows += [rows[0], (None, rows[0][1], None), (-5, None, 1), (-4, [*rows[0][1][:15], None], 1), (-3, [*rows[0][1][:15], float("nan")], 1), (-2, [*rows[0][1][:15], float("inf")], 1), (-1, [-0.5] * 16, 2), (-6, rows[0][1][:8], 2), (-7, [], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    frame.withColumnsRenamed({"label": "label"}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.op13_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)


def test_uneven_and_huge(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 9, 0)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(Exception, match="beyond 64 bits"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 8, 0)], "vec_id long, embedding array<double>, label int"))
