"""Queries over the driver's tables, one for each operator or family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import fuzzy, pages, parse, text
from marram.operators import genres, matching, relational
from marram.plans import reports

NOW = "2024-02-01 00:00:00"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT source, lang, count(*) AS cnt FROM documents d
    WHERE n_chars >= 100 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)
    GROUP BY source, lang""")
def catalogue_facets(spark, sf):
    """Visible documents by source and language: an anti-join, a filter and a count."""
    hidden = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf, "documents").join(hidden, "doc_id", "left_anti").filter("n_chars >= 100").groupBy("source", "lang").agg(F.count("*").alias("cnt"))


@query("SELECT value, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value")
def facet_part_words(spark, sf):
    return relational.facet(table(spark, sf, "part"), fuzzy.tokens(F.col("p_name")))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def facet_distinct_segment(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment").distinct()


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') AND contains(lower(p_brand), 'brand#1') AND p_size < 20")
def filter_conjunction(spark, sf):
    wanted = relational.all_present({"p_name": "RE", "p_brand": "Brand#1", "p_type": None}) & relational.duration_predicate(F.col("p_size"), "<", 20)
    return table(spark, sf, "part").filter(wanted).select("p_partkey", "p_name")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 1 AND l.doc_id = d.doc_id)")
def filter_exclusions(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return relational.exclude(relational.exclude(docs, labels.filter("toxic = 1"), ["doc_id"]), labels.filter("quality = 1"), ["doc_id"]).select("doc_id", "source")


@query("""SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') OR lower(p_type) IN ('promo', 'standard') OR contains(p_name, 'red') OR contains(p_name, 'blue')""")
def hidden_values_theta(spark, sf):
    hidden = spark.createDataFrame([("p_brand", "Brand#11", False, True), ("p_type", "PROMO", True, True), ("p_name", "red", False, False), ("p_name", "large", False, False)], "property string, value string, ignore_case boolean, whole_word boolean")
    alike = spark.createDataFrame([("p_brand", "Brand#11", "Brand#12"), ("p_type", "PROMO", "Standard"), ("p_name", "red", "blue")], "property string, replace_value string, possible_value string")
    return relational.hidden_by_values(table(spark, sf, "part"), hidden, alike, ["p_brand", "p_type", "p_name"], "p_partkey")


@query("""SELECT o_orderkey, c_custkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_regionkey = 1 AND o_orderdate <= TIMESTAMP '1995-06-30 00:00:00'""")
def stale_records(spark, sf):
    sites = table(spark, sf, "region").filter("r_regionkey = 1").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    records = table(spark, sf, "customer").join(sites, F.col("c_nationkey") == F.col("n_nationkey"))
    old = table(spark, sf, "orders").filter(F.col("o_orderdate") <= F.lit("1995-06-30 00:00:00").cast("timestamp_ntz"))
    return old.join(records, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "r_name")


@query("""SELECT p_partkey, CASE lower(p_brand) WHEN 'brand#11' THEN 'First' WHEN 'brand#12' THEN 'Second' ELSE p_brand END AS p_brand FROM part""")
def replacement_dictionary(spark, sf):
    rows = [(2, "p_brand", "BRAND#11", "Late"), (1, "p_brand", "brand#11", "First"), (3, "p_brand", "Brand#12", "Second")]
    dictionary = spark.createDataFrame(rows, "id int, property string, possible_value string, replace_value string")
    return relational.replace_values(table(spark, sf, "part").select("p_partkey", "p_brand"), dictionary, ["p_brand"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def incremental_import(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    old, new = orders.filter("o_orderkey % 2 = 0").withColumn("origin", F.lit("old")), orders.filter("o_orderkey % 3 = 0").withColumn("origin", F.lit("new"))
    return relational.import_new(old, new, ["o_orderkey"])


@query("""WITH r AS (SELECT *, event_id > (SELECT max(event_id) FROM events) * 3 // 4 AS changed FROM events)
    SELECT user_id, event_id, event_type FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY changed DESC, ts DESC, event_id DESC) = 1""")
def upsert_latest(spark, sf):
    """The last quarter of the events over the latest of each user's others: changed rows replace a target's, whatever their time."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    at = F.broadcast(events.agg(F.floor(F.max("event_id") * 3 / 4).alias("at")))
    order = [F.desc("ts"), F.desc("event_id")]
    target = relational.first_by(events.join(at).filter("event_id <= at").drop("at"), ["user_id"], order)
    return relational.upsert(target, events.join(at).filter("event_id > at").drop("at"), ["user_id"], order).drop("ts")


@query("SELECT l_partkey, count(*) AS votes, round(avg(l_quantity), 6) AS avg_rate FROM lineitem WHERE l_quantity BETWEEN 1 AND 5 GROUP BY l_partkey")
def rating_aggregate(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity BETWEEN 1 AND 5").groupBy("l_partkey").agg(F.count("*").alias("votes"), F.round(F.avg("l_quantity"), 6).alias("avg_rate"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS cnt, CAST(3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment) AS INTEGER) AS level
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rollup_site_forum_author(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return relational.levels(joined, ["r_name", "n_name", "c_mktsegment"])


@query("""WITH w AS (SELECT p_partkey, lower(unnest(string_split(p_name, ' '))) AS value FROM part)
    SELECT upper(value[1]) AS letter, value, count(DISTINCT p_partkey) AS cnt FROM w GROUP BY GROUPING SETS ((letter, value), (letter))""")
def alphabet_groups(spark, sf):
    return relational.alphabet(table(spark, sf, "part"), fuzzy.tokens(F.col("p_name")), "p_partkey")


@query("SELECT CAST(least(greatest(floor(l_discount * 10), 0), 10) AS INTEGER) AS bucket, count(*) AS cnt FROM lineitem GROUP BY bucket")
def confidence_histogram(spark, sf):
    return reports.histogram(table(spark, sf, "lineitem"), "l_discount")


@query("SELECT round(sum(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS coverage FROM lineitem")
def weighted_coverage(spark, sf):
    return reports.weighted_coverage(table(spark, sf, "lineitem"), "l_discount", "l_quantity", 0.05).select(F.round("coverage", 9).alias("coverage"))


@query("""WITH x AS (SELECT CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events) SELECT count(*) AS n, count(v) AS matched, count(CASE WHEN v >= 80 THEN 1 END) AS high,
    round(100.0 * count(v) / count(*), 1)::DOUBLE AS matched_pct, round(100.0 * count(CASE WHEN v >= 80 THEN 1 END) / count(*), 1)::DOUBLE AS high_pct FROM x""")
def match_report(spark, sf):
    return reports.match_report(table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 3 > 0, F.col("value"))), "v", 80)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 4")
def topk_per_group(spark, sf):
    return relational.first_by(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4)


AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6"


@query(f"SELECT event_id, CASE WHEN {AGE} > 30 THEN 'stale' WHEN {AGE} < 1 THEN 'today' WHEN {AGE} < 7 THEN 'week' ELSE 'older' END AS bucket FROM events")
def recency_bucket(spark, sf):
    return table(spark, sf, "events").select("event_id", relational.recency(F.col("ts"), F.col("ts"), F.lit(NOW).cast("timestamp_ntz")).alias("bucket"))


WORDS_SQL = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"


def part_words(spark, sf):
    return table(spark, sf, "part").select(F.explode(fuzzy.tokens(F.col("p_name"))).alias("w")).distinct()


@query(f"WITH {WORDS_SQL} SELECT x.w AS a, y.w AS b, CAST(levenshtein(x.w, y.w) AS INTEGER) AS dist FROM w x, w y WHERE levenshtein(x.w, y.w) <= 2")
def fuzzy_band_join(spark, sf):
    words = part_words(spark, sf)
    return matching.fuzzy_band_join(words, words, "w", "w")


@query("""WITH p AS (SELECT DISTINCT p_name AS n FROM part), k AS (SELECT n, string_split(n, ' ')[2] || ' ' || string_split(n, ' ')[1] AS m FROM p),
    s AS (SELECT n, m, array_to_string(list_sort(string_split(n, ' ')), ' ') AS a, array_to_string(list_sort(string_split(m, ' ')), ' ') AS b FROM k)
    SELECT n, m, round(1 - levenshtein(n, m)::DOUBLE / greatest(length(n), length(m)), 9) AS plain, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 9) AS sorted_ratio FROM s""")
def token_sort_ratio(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("n")).distinct()
    names = names.withColumn("m", F.concat_ws(" ", F.get(F.split("n", " "), F.lit(1)), F.get(F.split("n", " "), F.lit(0))))
    return names.select("n", "m", F.round(fuzzy.ratio(F.col("n"), F.col("m")), 9).alias("plain"), F.round(fuzzy.token_sort_ratio(F.col("n"), F.col("m")), 9).alias("sorted_ratio"))


@query("""WITH p AS (SELECT DISTINCT p_name AS n FROM part), k AS (SELECT a.n AS n, b.n AS m, list_sort(list_distinct(string_split(a.n, ' '))) AS x, list_sort(list_distinct(string_split(b.n, ' '))) AS y FROM p a JOIN p b ON a.n[1] = b.n[1]),
    s AS (SELECT n, m, array_to_string(list_filter(x, lambda v: list_contains(y, v)), ' ') AS joint, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ' ') AS l, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ' ') AS r FROM k),
    t AS (SELECT n, m, joint AS a, trim(joint || ' ' || l) AS b, trim(joint || ' ' || r) AS c FROM s)
    SELECT n, m, round(greatest(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 1 - levenshtein(a, c)::DOUBLE / greatest(length(a), length(c)), 1 - levenshtein(b, c)::DOUBLE / greatest(length(b), length(c))), 9) AS score FROM t""")
def token_set_ratio(spark, sf):
    """Pairs of names with the same initial."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("n"), F.substring("p_name", 1, 1).alias("f")).distinct()
    pairs = names.join(names.select(F.col("n").alias("m"), "f"), "f")
    return pairs.select("n", "m", F.round(fuzzy.token_set_ratio(F.col("n"), F.col("m")), 9).alias("score"))


@query(f"""WITH {WORDS_SQL}, q AS (SELECT x.w AS a, y.w AS b, jaro_similarity(x.w, y.w) AS j FROM w x, w y WHERE x.w[1] = y.w[1]),
    r AS (SELECT *, CASE WHEN a[1:4] = b[1:4] AND least(length(a), length(b)) >= 4 THEN 4 WHEN a[1:3] = b[1:3] AND least(length(a), length(b)) >= 3 THEN 3 WHEN a[1:2] = b[1:2] THEN 2 ELSE 1 END AS p FROM q)
    SELECT a, b, round(j + p * 0.1 * (1 - j), 6) AS score FROM r""")
def jaro_winkler_pairs(spark, sf):
    words = part_words(spark, sf).withColumn("f", F.substring("w", 1, 1))
    pairs = words.select(F.col("w").alias("a"), "f").join(words.select(F.col("w").alias("b"), "f"), "f")
    return pairs.select("a", "b", F.round(fuzzy.jaro_winkler(F.col("a"), F.col("b")), 6).alias("score"))


@query("""WITH k AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS w FROM part), b AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS v FROM part)
    SELECT DISTINCT p_partkey, v FROM k, b WHERE substr(w, 1, 3) = substr(v, 1, 3) OR w = v""")
def blocking_candidates(spark, sf):
    words = F.split("p_name", " ")
    parts = table(spark, sf, "part").select("p_partkey", F.get(words, F.lit(0)).alias("w"))
    return matching.blocking_candidates(parts, table(spark, sf, "part").select(F.get(words, F.lit(0)).alias("v")).distinct(), "p_partkey", "w", "v", "v")


@query("""WITH x AS (SELECT *, floor(l_extendedprice * 1000 / (l_quantity * 128)) AS c, l_orderkey % 4000 * 5 AS stated FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN stated > 0 AND stated / c > 0.8 AND stated / c < 1.2 THEN stated ELSE c END AS BIGINT) AS seconds FROM x""")
def effective_duration(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", parse.effective_seconds(F.col("l_extendedprice") * 1000, F.col("l_quantity"), F.col("l_orderkey") % 4000 * 5).alias("seconds"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS INTEGER) AS n_links FROM pages""")
def html_title_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.page_title(F.col("html")).alias("title"), F.size(text.links(F.col("html"))).alias("n_links"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.inner_text(F.col("html")).alias("text"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def key_value_pivot(spark, sf):
    pair = text.key_value(F.translate("props", '{}"', ""))
    return table(spark, sf, "events").select("event_id", pair["key"].alias("key"), F.trim(pair["value"]).alias("value"))


def label_centers(spark, sf):
    """A center for each label: the mean of its vectors, by dimension."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = cells.groupBy("label", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("center"))


@query("""WITH c AS (SELECT label, list(x ORDER BY d) AS center FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label),
    s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], center) AS score FROM embeddings, c)
    SELECT vec_id, label, round(score, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""")
def nearest_label(spark, sf):
    found = matching.nearest_labels(table(spark, sf, "embeddings").select("vec_id", "embedding"), label_centers(spark, sf), "vec_id", "embedding")
    return found.select("vec_id", "label", F.round("score", 5).alias("score"))


@query("SELECT p_partkey, 'canon ' || p_type AS canonical FROM part")
def genre_canonicalise(spark, sf):
    """Types with a planted typo, mapped back by edit distance."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat("p_type", F.lit("x")).alias("typo"))
    types = table(spark, sf, "part").select("p_type").distinct()
    dictionary = types.select(F.hash("p_type").alias("ord"), F.col("p_type").alias("variant"), F.concat(F.lit("canon "), "p_type").alias("canonical"), F.lit(False).alias("part"))
    return matching.canonicalise(parts, dictionary, "typo").select("p_partkey", "canonical")


@query()
def genre_parts(spark, sf):
    """Types with all parts of the least priority that they contain."""
    entries = [("pro", 1), ("mo", 1), ("eco", 1), ("no", 2), ("all", 2), ("stand", 2), ("dard", None), ("med", None), ("ium", None)]
    dictionary = spark.createDataFrame([(k, w, f"part {w}", True, p) for k, (w, p) in enumerate(entries)], "ord int, variant string, canonical string, part boolean, priority int")
    return matching.canonicalise(table(spark, sf, "part").select("p_partkey", "p_type"), dictionary, "p_type").select("p_partkey", "canonicals")


@query("""WITH d(w, p) AS (VALUES ('pro', 1), ('mo', 1), ('eco', 1), ('no', 2), ('all', 2), ('stand', 2), ('dard', NULL), ('med', NULL), ('ium', NULL)), h AS (SELECT p_type, p, list(DISTINCT 'part ' || w) AS l FROM (SELECT DISTINCT p_type FROM part), d WHERE contains(lower(p_type), w) GROUP BY p_type, p),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p NULLS LAST) = 1) SELECT p_partkey, CASE WHEN l IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_append(l, p_type))), ',') END AS canonicals FROM part LEFT JOIN b USING (p_type)""")
def genre_parts_joined(spark, sf):
    """``genre_parts`` with the names of each type joined by commas."""
    return genre_parts(spark, sf).select("p_partkey", F.array_join("canonicals", ",").alias("canonicals"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT unnest(['a', 're', '', 'zzz'])) SELECT d.doc_id, w.w FROM documents d, w WHERE contains(d.text, w.w) AND d.doc_id % 2 = 0 AND length(d.text) > 0
    UNION ALL SELECT doc_id, w FROM documents, w WHERE contains(text, w) AND doc_id % 2 = 1 AND length(text) > 0""")
def contained_words(spark, sf):
    """Every word of a part's name, and some short ones, in every document that they stand in."""
    words = part_words(spark, sf).unionByName(spark.createDataFrame([("a",), ("re",), ("",), ("zzz",)], "w string")).distinct()
    docs = table(spark, sf, "documents").select("doc_id", "text").filter("text <> ''")
    return matching.rows_containing(docs, words, "text", "w").select("doc_id", "w")


@query("""WITH s AS (SELECT a.vec_id, b.vec_id AS label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS score FROM embeddings a, embeddings b)
    SELECT vec_id, label, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) - 1 AS INTEGER) AS place FROM s QUALIFY place < 3""")
def nearest_vectors(spark, sf):
    """Each embedding's three nearest of all, which are labels of themselves, a block of them at a time."""
    vectors = table(spark, sf, "embeddings")
    near = matching.nearest_labels(vectors, vectors.select(F.col("vec_id").alias("label"), F.col("embedding").alias("center")), "vec_id", "embedding", 3, 512, 10)
    return near.select("vec_id", "label", F.round("score", 5).alias("score"), "place")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500")
def random_orders(spark, sf):
    return relational.random_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 7)


@query("SELECT l_orderkey * 10 + l_linenumber AS line, l_discount FROM lineitem WHERE l_discount >= 0.04 AND l_discount < 0.06 ORDER BY md5('3:' || (l_orderkey * 10 + l_linenumber)), line LIMIT 200")
def sampled_band(spark, sf):
    return relational.sampled_band(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_discount"), "l_discount", 0.04, 0.06, "line", 200, 3)


@query(r"""WITH v AS (SELECT p_partkey AS k, unnest(CASE WHEN p_partkey % 7 = 0 THEN ['', '  '] WHEN p_partkey % 7 = 1 THEN NULL WHEN p_partkey % 2 = 0 THEN [upper(p_name), '1' || p_brand] ELSE [p_name, 'X' || p_brand] END) AS value, unnest([0, 1]) AS pos FROM part),
    s AS (SELECT * FROM v WHERE trim(coalesce(value, '')) <> ''), f AS (SELECT lower(value) AS l, arg_min(value, k * 10 + pos) AS value FROM s GROUP BY lower(value)),
    n AS (SELECT k, f.value, CASE WHEN regexp_matches(f.value[1], '\p{L}') THEN upper(f.value[1]) ELSE '<other>' END AS letter FROM s JOIN f ON lower(s.value) = f.l),
    t AS (SELECT letter, value, count(DISTINCT k) AS cnt FROM n GROUP BY GROUPING SETS ((letter, value), (letter)) UNION ALL SELECT '<not set>', NULL, (SELECT count(*) FROM part WHERE p_partkey % 7 < 2)),
    c AS (SELECT *, CASE WHEN value IS NULL THEN letter ELSE list_aggregate(list_transform(string_split(lower(value), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END || ' [' || cnt || ']' AS caption FROM t),
    p AS (SELECT letter, row_number() OVER (ORDER BY letter) AS letter_place FROM (SELECT DISTINCT letter FROM t))
    SELECT letter, value, caption, cnt, CAST(letter_place AS INTEGER) AS letter_place, CAST(row_number() OVER (PARTITION BY letter ORDER BY value IS NOT NULL, caption) - 1 AS INTEGER) AS place FROM c JOIN p USING (letter)""")
def group_tree(spark, sf):
    """Names and brands by letter: mixed case, values that aren't letters, blanks and nulls."""
    k = F.col("p_partkey")
    blank = F.array(F.lit(""), F.lit("  "))
    values = F.when(k % 7 == 0, blank).when(k % 7 == 1, F.lit(None).cast("array<string>")).when(k % 2 == 0, F.array(F.upper("p_name"), F.concat(F.lit("1"), "p_brand"))).otherwise(F.array("p_name", F.concat(F.lit("X"), "p_brand")))
    return relational.group_tree(table(spark, sf, "part"), values, "p_partkey", lambda x: pages.change_case(text.trim_to_length(x, 40), "words", False, False))


@query("""WITH x AS (SELECT p_partkey AS k, p_partkey % 6 AS f, p_type AS t, p_brand AS b FROM part),
    n AS (SELECT k, f, t, CASE f WHEN 0 THEN ['Ref ' || t] WHEN 1 THEN ['Ref ' || t] WHEN 2 THEN ['Ref ' || t] WHEN 3 THEN list_append(CASE WHEN b LIKE 'Brand#1%' OR contains(b, '2') THEN list_filter([CASE WHEN b LIKE 'Brand#1%' THEN 'Ones' END, CASE WHEN b LIKE 'Brand#2%' THEN 'Twos' END, CASE WHEN contains(b, '2') THEN 'Low' END], lambda x: x IS NOT NULL) ELSE ['Any'] END, b || ' novel')
            WHEN 4 THEN ['Книга ' || t] ELSE [] END AS own,
        CASE f WHEN 0 THEN 'Ref ' || t WHEN 1 THEN lower('re-f ' || t) WHEN 2 THEN 'Ref ' || t || 'xx' WHEN 3 THEN b || ' novel' WHEN 4 THEN 'Kнига ' || t ELSE 'unheard of ' || t END AS raw FROM x)
    SELECT k, CASE WHEN len(own) > 0 OR k % 4 = 0 THEN array_to_string(list_sort(list_distinct(CASE WHEN k % 4 = 0 THEN list_append(own, 'Ref ' || t) ELSE own END)), ', ') ELSE raw || ', abc' END AS genre FROM n""")
def genre_cascade(spark, sf):
    """Genres that each step settles: names, variants, near ones, parts by priority, look-alikes, and none."""
    part = table(spark, sf, "part")
    types = part.select("p_type").distinct()
    whole = types.select((F.hash("p_type").cast("long")).alias("ord"), F.concat(F.lit("Ref "), "p_type").alias("variant"), F.concat(F.lit("Ref "), "p_type").alias("canonical"), F.lit(False).alias("part"), F.lit(None).cast("int").alias("priority"))
    entries = [("brand#1", "Ones", 1), ("brand", "Any", None), ("brand#2", "Twos", 1), ("2", "Low", 1), ("novel", "Any", None)]
    dictionary = whole.unionByName(spark.createDataFrame([(k, w, c, True, p) for k, (w, c, p) in enumerate(entries)], whole.schema))
    k, ref = F.col("p_partkey"), F.concat(F.lit("Ref "), "p_type")
    raw = F.element_at(F.array(ref, F.lower(F.concat(F.lit("re-f "), "p_type")), F.concat(ref, F.lit("xx")), F.concat("p_brand", F.lit(" novel")), F.concat(F.lit("Kнига "), "p_type"), F.concat(F.lit("unheard of "), "p_type")), (k % 6).cast("int") + 1)
    rows = part.select(k.alias("k"), F.concat(raw, F.lit(", abc"), F.when(k % 4 == 0, F.concat(F.lit("; "), ref)).otherwise("")).alias("genre"))
    return genres.normalise_genres(rows, dictionary, "k", "genre")


@query(f"""WITH x AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS w FROM part), a AS (SELECT w, min(p_partkey) AS id FROM x GROUP BY w), b AS (SELECT p_name, min(p_partkey) AS book FROM x GROUP BY p_name)
    SELECT p_partkey AS key, a.id AS author_ref, CAST({max(fuzzy.NO_GIVEN, fuzzy.WHOLE_NAME)} AS DOUBLE) AS author_conf, b.book AS book_ref, CAST(1 AS DOUBLE) AS book_conf, a.id AS book_author_ref FROM x JOIN a USING (w) JOIN b USING (p_name)""")
def resolve_author_book(spark, sf):
    """Part names as books of the authors that their first words name."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("w"))
    authors = parts.groupBy(F.get("w", F.lit(0)).alias("surname")).agg(F.min("p_partkey").alias("author_id")).select("author_id", "surname", F.lit("").alias("given"))
    books = parts.groupBy("p_name", "w").agg(F.min("p_partkey").alias("book_id")).join(authors, F.get("w", F.lit(0)) == F.col("surname")).select("author_id", "book_id", F.col("p_name").alias("title"))
    records = parts.select(F.col("p_partkey").alias("key"), F.get("w", F.lit(0)).alias("author"), F.concat_ws(" - ", F.get("w", F.lit(0)), "p_name").alias("title"))
    return matching.resolve(records, authors, books)
