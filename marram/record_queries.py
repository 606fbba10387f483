"""Queries over records, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import records
from marram.queries import label_centers, query, table

NOW = "2024-02-01 12:00:00"


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def key_membership(spark, sf):
    keys = table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return records.by_keys(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def key_lookup(spark, sf):
    return records.by_key(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 7)


@query("SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts) > 15 * 86400000000")
def stale_by_age(spark, sf):
    return records.stale(table(spark, sf, "events"), "ts", F.lit(NOW).cast("timestamp_ntz"), 15).select("event_id")


@query("""SELECT COALESCE(c_custkey, s_suppkey) AS k, COALESCE(s_name, c_name) AS name FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 60) FULL JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 5) ON c_custkey = s_suppkey""")
def merge_listed(spark, sf):
    known = table(spark, sf, "customer").filter("c_custkey <= 60").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return records.merge_listed(known, table(spark, sf, "supplier").filter("s_suppkey > 5").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k", ["name"])


@query("""WITH w AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS pos, unnest(string_split(p_name, ' ')) AS x FROM part), v AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(x) ELSE x END AS atom FROM w)
    SELECT arg_min(atom, p_partkey * 10 + pos) AS atom, count(*) AS cnt FROM v GROUP BY lower(atom)""")
def distinct_atoms(spark, sf):
    words = F.split(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), " ")
    return records.atoms(table(spark, sf, "part"), words, "p_partkey")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderpriority = min(o_orderpriority) OVER (PARTITION BY o_custkey)""")
def least_priority(spark, sf):
    return records.least_priority(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT p_brand AS value FROM part WHERE lower(p_brand) NOT IN ('brand#11', 'brand#12')")
def replacement_proposals(spark, sf):
    same = spark.createDataFrame([("p_brand", "BRAND#11"), ("p_brand", "brand#12"), ("other", "Brand#13")], "property string, possible_value string")
    return records.proposals(table(spark, sf, "part"), "p_brand", same, "p_brand")


@query("""WITH last AS (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS key, event_type AS book_title, 'v2' AS matcher_version FROM last UNION ALL SELECT 'kept', 'old', 'v1'""")
def overlay_upsert(spark, sf):
    """Matches over a store whose own rows are replaced by key and kept otherwise."""
    store = spark.createDataFrame([("1", "old", "v1"), ("kept", "old", "v1")], "key string, book_title string, matcher_version string").withColumn("matched_utc", F.lit(NOW).cast("timestamp"))
    matches = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("book_title"), F.col("event_id").alias("seq"))
    matches = matches.unionByName(spark.createDataFrame([("", "no", 1), (None, "no", 2)], "key string, book_title string, seq long"))
    return records.overlay(store, matches, "v2", F.lit(NOW).cast("timestamp")).select("key", "book_title", "matcher_version")


@query("""SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey ORDER BY cnt DESC, o_custkey LIMIT 30""")
def top_by_frequency(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "o_custkey").limit(30)


@query("""SELECT l_partkey, cnt FROM (SELECT l_partkey, count(*) AS cnt, sum(l_linenumber) AS score FROM lineitem GROUP BY l_partkey) WHERE cnt >= 3 ORDER BY score * 1000000 + l_partkey LIMIT 20""")
def least_sure(spark, sf):
    grouped = table(spark, sf, "lineitem").groupBy("l_partkey").agg((F.sum("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("score"), F.count("*").alias("cnt"))
    return records.least_sure(grouped, "score", "cnt").select("l_partkey", "cnt")


@query("""WITH c AS (SELECT label, list(x ORDER BY d) AS center FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label),
    s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], center) AS score FROM embeddings, c),
    t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS place FROM s QUALIFY place <= 6)
    SELECT vec_id, label, round(score, 5) AS score FROM t QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score + 0.15 * CASE WHEN label = vec_id % 10 THEN 1 ELSE 1 - 1 / 7.0 END DESC, place) = 1""")
def hybrid_rerank(spark, sf):
    """Six nearest labels, blended with how well ``label N`` fits the text."""
    labels = label_centers(spark, sf).withColumn("descr", F.concat(F.lit("label "), "label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", F.concat(F.lit("Label "), F.col("vec_id") % 10).alias("words"))
    return records.hybrid_rerank(vectors, labels, "vec_id", "embedding", "words").select("vec_id", "label", F.round("score", 5).alias("score"))


@query("""WITH m AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE vec_id % 3 > 0) GROUP BY label, d)
    SELECT label, d - 1 AS d, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m""")
def mean_pooling(spark, sf):
    tokens = table(spark, sf, "embeddings").select("label", "embedding", (F.col("vec_id") % 3).alias("mask"))
    pooled = records.mean_pooled(tokens, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("v").alias("d", "x")).select("label", F.col("d").cast("long").alias("d"), F.round("x", 5).alias("x"))


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 4) AND c_acctbal > 0")
def drill_down(spark, sf):
    customers = table(spark, sf, "customer")
    members = customers.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("string").alias("group"), "c_custkey")
    return records.drill_down(customers, members, "4", "c_custkey", F.col("c_acctbal") > 0).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_type FROM part WHERE trim(p_type) <> '' AND length(p_type) > 5")
def not_blank_long(spark, sf):
    return table(spark, sf, "part").filter(records.not_blank(F.col("p_type")) & (F.length("p_type") > 5)).select("p_partkey", "p_type")
