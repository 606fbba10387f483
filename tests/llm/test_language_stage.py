"""The language stage rejects what no label has taught, and keeps texts where nothing was learned."""

import random

from pyspark.sql import functions as F

from marram.llm import langid


def test_unlearned_language_is_rejected(spark, small):
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet").filter(F.col("text").rlike(r"\p{L}"))
    held = langid.held_out()
    draw = random.Random(2)
    junk = [" ".join("".join(draw.choices("bcdfghjklmnpqrstvwxz", k=draw.randrange(2, 12))) for _ in range(60)) for _ in range(50)]
    for out in [r["lang"] for r in docs.filter("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()]:
        # The left-out language stands only in rows that teach nothing.
        table = docs.filter((F.col("lang") != out) | held)
        extra = spark.createDataFrame([(None, t, None, "junk", len(t)) for t in junk], docs.schema)
        rows = langid.stage_language(spark, table.unionByName(extra), "").groupBy("lang", held.alias("held")).count().collect()
        had = {(r["lang"], r["held"]): r["count"] for r in table.groupBy("lang", held.alias("held")).count().collect()}
        kept = {(r["lang"], r["held"]): r["count"] for r in rows}
        learned = [k for k in had if k[0] != out]
        print(out, "unlearned", kept.get((out, True), 0), had[out, True], "learned", sum(kept.get(k, 0) for k in learned), sum(had[k] for k in learned), "junk", kept.get((None, False), 0))
        assert kept.get((out, True), 0) <= 0.05 * had[out, True]
        assert sum(kept.get(k, 0) for k in learned) >= 0.99 * sum(had[k] for k in learned)
        assert kept.get((None, False), 0) == 0


def test_nothing_learned_keeps_letters(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.stage_language(spark, docs, "").collect()] == [1]
