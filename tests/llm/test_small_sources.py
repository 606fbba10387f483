"""Interleaving of sources of one row each."""

import hashlib
import re

from marram.llm import shard


def test_equal_fractions_are_cut_by_draw(spark):
    rows = [(k, f"text {k}", f"host{k}" if k < 900 else "big") for k in range(1000)]
    out = shard.stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    draw = lambda k: hashlib.md5(f"{shard.SEED}:{k}".encode()).hexdigest()
    big = sorted(range(900, 1000), key=draw)
    fraction = {k: 0.5 for k in range(900)} | {k: (r + 0.5) / 100 for r, k in enumerate(big)}
    want = sorted(range(1000), key=lambda k: (fraction[k], draw(k)))
    assert [r["doc_id"] for r in out.orderBy("shard", "slot").collect()] == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    last = re.search(r"Window \[row_number\(\).*?\], \[([^\]]*)\]", plan).group(1)
    assert "fraction" in last and "draw_bin" in last
