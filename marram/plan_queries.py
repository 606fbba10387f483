"""Queries of whole runs and of the sources that they read, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.functions import pages, pieces
from marram.operators import genres, matching, relational
from marram.plans import catalogue
from marram.queries import label_centers, query, table
from marram.source_queries import filled_store, scratch
from marram.sources import cache
from marram.sources.store import Store

#: What the cache's encoding holds beyond ASCII.
ENCODED = bytes(range(128, 256)).decode(cache.ENCODING, "ignore")


def page_cache(spark, sf) -> Store:
    """Every page but each fifth, of which each third is stored as it is and each seventh is empty."""
    found = table(spark, sf, "pages").filter("page_id % 5 > 0").select("page_id", F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("html")).alias("html"))
    store = Store.create(cache.blobs(found.filter("page_id % 3 > 0"), "page_id", "html"), scratch(spark, "cache"), ["key"], 8)
    store.merge(cache.blobs(found.filter("page_id % 3 = 0"), "page_id", "html", False))
    return store


@query(rf"""WITH x AS (SELECT page_id, regexp_replace(html, '[^\x00-\x7F{ENCODED}]', '?', 'g') AS old, html FROM pages), m AS (SELECT *, page_id % 5 > 0 AND page_id % 7 > 0 AS held FROM x)
    SELECT 'cache only' AS mode, page_id AS key, old AS html, false AS is_fresh FROM m WHERE held UNION ALL SELECT 'fresh only', page_id, 'new ' || html, true FROM m WHERE page_id % 2 = 0
    UNION ALL SELECT 'cache or fresh', page_id, CASE WHEN held THEN old ELSE 'new ' || html END, NOT held FROM m WHERE held OR page_id % 2 = 0""")
def cached_pages(spark, sf):
    """All pages in each mode, with half of them to be had anew."""
    store, fresh = page_cache(spark, sf).read(), table(spark, sf, "pages").filter("page_id % 2 = 0").select(F.col("page_id").alias("key"), F.concat(F.lit("new "), "html").alias("html"))
    keys, out = table(spark, sf, "pages").select(F.col("page_id").alias("key")), None
    for mode in (cache.CACHE_ONLY, cache.FRESH_ONLY, cache.CACHE_OR_FRESH):
        found = cache.read_pages(store, fresh, keys, mode).withColumn("mode", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


@query("""SELECT page_id AS key, CAST(CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS INTEGER) AS web_site_id, 'Name' || page_id AS author, CASE WHEN n_regionkey = 2 THEN CAST((page_id % 50 + 0.5) * 1048576 AS BIGINT) END AS size_bytes
    FROM pages JOIN nation ON page_id % 30 = n_nationkey WHERE n_regionkey IN (1, 2)""")
def reparse_by_site(spark, sf):
    """Pages of two sites, each read by its own rules; pages of other groups are left out."""
    n = F.col("page_id")
    post = F.concat(F.lit('<div class="post_body"><span class="post-b">Автор</span>: name'), n, F.lit("</div>"))
    news = F.concat(F.lit("<div id='news-id-1'>t<br>Автор: name"), n, F.lit("<br>Общий размер: "), n % 50, F.lit(",5 Мб</div>"))
    records = table(spark, sf, "pages").select(n.alias("key"), (n % 30).cast("int").alias("group_key"))
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("web_site_id"))
    html = table(spark, sf, "pages").join(groups.withColumnRenamed("key", "g"), n % 30 == F.col("g")).select("page_id", F.when(F.col("web_site_id") == 1, post).otherwise(news).alias("html"))
    store = Store.create(cache.blobs(html, "page_id", "html"), scratch(spark, "cache"), ["key"], 8)
    first = lambda *a: F.get(pages.elements(F.col("html"), *a), F.lit(0))
    parsers = {1: lambda df: pages.parsed_records(df, "key", "html", first("div", "class", "post_body")), 2: lambda df: pages.parsed_records(df, "key", "html", first("div", "id", "news-id-", "prefix"), "table")}
    out = scratch(spark, "reparsed")
    catalogue.reparsed(records, groups, store.read(), parsers).select("key", "web_site_id", "author", "size_bytes").write.partitionBy("web_site_id").parquet(out)
    return spark.read.parquet(out).select("key", "web_site_id", "author", "size_bytes")


@query("""SELECT upper(n_name) AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE upper(n_name) END AS title, CAST(1 AS INTEGER) AS web_site_id FROM nation UNION ALL SELECT r_name || '!', r_name || '!', 1 FROM region""")
def groups_for_site(spark, sf):
    """Groups of every nation, half of which are known, some under another site, and new ones."""
    nations = table(spark, sf, "nation")
    groups = nations.filter("n_nationkey % 2 = 0").select(F.upper("n_name").alias("key"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("web_site_id"))
    keys = nations.select(F.upper("n_name").alias("key")).unionByName(table(spark, sf, "region").select(F.concat("r_name", F.lit("!")).alias("key")))
    known = catalogue.groups_of_site(catalogue.groups_for(groups, keys, 1), 1)
    return catalogue.groups_for(groups, known, 1)


@query("""SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_hidden FROM documents""")
def hidden_marks(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("other").alias("property"))
    return catalogue.is_hidden(table(spark, sf, "documents").select("doc_id", "source"), catalogue.hidden_values_of(labels, "toxic"), ["doc_id"])


@query("SELECT c_custkey, c_nationkey + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS open_counter FROM customer")
def open_counters(spark, sf):
    records = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("open_counter"))
    return catalogue.opened(records, table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "open_counter")


@query("""SELECT user_id, event_id FROM events WHERE event_id <= (SELECT max(event_id) FROM events) // 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def store_snapshot(spark, sf):
    """A version that is read as it was after later batches have been merged."""
    store = filled_store(spark, sf)
    store.merge(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), [F.desc("ts")])
    return store.read(0).select("user_id", "event_id")


@query("""WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS id, p_name, -CAST(p_size AS FLOAT) / 2 AS score FROM part), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY id) = 1)
    SELECT p_brand, count(*) AS pieces, CAST(sum(id) AS BIGINT) AS ids, CAST(max(length(p_name)) AS INTEGER) AS longest, min(score)::DOUBLE AS least FROM f GROUP BY p_brand""")
def vocabulary_json(spark, sf):
    """Each brand's names as a tokenizer's vocabulary in JSON, read again: pieces by place, the first of equal ones."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))), lambda x: F.concat(F.lit('["'), x["p_name"], F.lit('", '), (-x["p_size"] / 2).cast("string"), F.lit("]")))
    described = table(spark, sf, "part").groupBy("p_brand").agg(F.concat(F.lit('{"version": "1", "model": {"type": "Unigram", "vocab": ['), F.array_join(rows, ", "), F.lit("]}}")).alias("json"))
    out = None
    for brand in [r[0] for r in described.select("p_brand").orderBy("p_brand").collect()]:  # some dozen brands
        own = pieces.vocabulary(described.filter(F.col("p_brand") == brand), "json")
        found = own.agg(F.count("*").alias("pieces"), F.sum("id").cast("long").alias("ids")).join(F.broadcast(pieces.vocabulary_bounds(own))).select(F.lit(brand).alias("p_brand"), "pieces", "ids", "longest", F.col("least").cast("double").alias("least"))
        out = found if out is None else out.unionByName(found)
    return out


@query()
def unigram_pieces(spark, sf):
    """Texts of the benchmark as pieces of a vocabulary that is counted from all documents: words, their endings and their letters."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).filter("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    parts = words.select("n", F.explode(F.concat(F.array(F.concat(F.lit(pieces.BLANK), "w"), F.concat(F.lit(pieces.BLANK), F.substring("w", 1, 3)), F.substring("w", -3, 3), F.substring("w", -2, 2)), F.filter(F.split("w", ""), lambda c: c != ""))).alias("piece"))
    counted = parts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(20_000)  # the vocabulary's size
    vocabulary = counted.select((F.row_number().over(matching.Window.orderBy(F.desc("n"), "piece")) + pieces.UNKNOWN).alias("id"), "piece", F.log(F.col("n") / 1e9).cast("float").alias("score"))
    found = pieces.piece_ids(table(spark, sf, "benchmark"), "item_id", F.concat(F.lit("query: "), F.lower("text")), vocabulary)
    return found.select("item_id", F.array_join("ids", " ").alias("ids"))


@query("""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS atom FROM part), a AS (SELECT atom, count(*) AS cnt FROM w GROUP BY atom),
    c AS (SELECT label, list(x ORDER BY d) AS center FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label),
    s AS (SELECT atom, cnt, max(list_cosine_similarity(embedding::DOUBLE[], center)) AS score FROM a JOIN embeddings ON (ascii(atom) * 31 + length(atom)) % 100 = vec_id, c GROUP BY atom, cnt)
    SELECT 'all' AS part, CAST(count(*) AS VARCHAR) AS atom, sum(cnt)::BIGINT AS cnt, round(sum(CASE WHEN score >= 0.5 THEN cnt ELSE 0 END) / sum(cnt), 6) AS score FROM s
    UNION ALL SELECT 'least sure', atom, cnt, round(score, 6) FROM (SELECT * FROM s WHERE cnt >= 3 ORDER BY score, cnt DESC LIMIT 5)""")
def mapping_report(spark, sf):
    """Words of names as genres, mapped to the nearest label by an embedding: coverage by uses, and the least sure."""
    atoms = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("atom")).groupBy("atom").agg(F.count("*").alias("cnt"))
    vectors = atoms.withColumn("vec_id", (F.ascii("atom") * 31 + F.length("atom")).cast("long") % 100).join(table(spark, sf, "embeddings").drop("label"), "vec_id")
    mapped = matching.nearest_labels(vectors, label_centers(spark, sf), "atom", "embedding").join(atoms, "atom")
    total, unsure = genres.mapping_report(mapped, 0.5, 5)
    out = total.select(F.lit("all").alias("part"), F.col("atoms").cast("string").alias("atom"), F.col("uses").alias("cnt"), F.round("use_share", 6).alias("score"))
    return out.unionByName(unsure.select(F.lit("least sure").alias("part"), "atom", "cnt", F.round("score", 6).alias("score")))


@query("""WITH x AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS w, p_name FROM part), b AS (SELECT p_name, min(p_partkey) AS book_id FROM part GROUP BY p_name)
    SELECT CAST(k AS VARCHAR) AS key, w || ', ' || 'ann' AS author, w || ', Ann' AS author_canonical, 1.0::DOUBLE AS author_conf, CASE WHEN k % 4 > 0 THEN b.p_name END AS book_title, CASE WHEN k % 4 > 0 THEN 1.0::DOUBLE END AS book_conf, 'v3' AS matcher_version FROM x JOIN b USING (p_name)
    UNION ALL SELECT 'kept', NULL, 'old', 0.5, 'old', 0.5, 'v1'""")
def normalised_and_matched(spark, sf):
    """Parts as records of authors that their first words name, composed or recovered from the title, with books and a store that has older matches."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", F.get(F.split("p_name", " "), F.lit(0)).alias("w"))
    even = F.col("k") % 2 == 0
    title = F.when(F.col("k") % 4 == 0, "zzzzzz qqqqqq xxxxxx").when(even, F.col("p_name")).otherwise(F.concat(F.upper("w"), F.lit(", ANN - "), "p_name"))
    records = part.select(F.col("k").cast("string").alias("key"), F.when(~even, "").alias("author"), F.when(even, F.col("w")).alias("author_surname"), F.when(even, "ann").alias("author_name"), title.alias("title"), *(F.lit("x").alias(c) for c in ("genre", "bitrate", "publisher", "reader")))
    known = part.select(F.concat("w", F.lit(", ann")).alias("author")).distinct()
    authors = part.select("w").distinct().select(F.hash("w").cast("long").alias("author_id"), F.col("w").alias("surname"), F.lit("ann").alias("given"), F.col("w").alias("last_name"), F.lit("Ann").alias("first_name"))
    books = part.groupBy("p_name", "w").agg(F.min("k").alias("book_id")).select(F.hash("w").cast("long").alias("author_id"), "book_id", F.col("p_name").alias("title"))
    none = spark.createDataFrame([], "id int, property string, possible_value string, replace_value string")
    store = spark.createDataFrame([("kept", None, 0.5, "old", None, 0.5, "old", "v1"), ("4", None, 0.5, "old", None, 0.5, "old", "v1")], "key string, author_ref long, author_conf double, author_canonical string, book_ref long, book_conf double, book_title string, matcher_version string").withColumn("matched_utc", F.lit("2024-01-01").cast("timestamp"))
    out, matched = catalogue.normalised_and_matched(records, none, known, authors, books, store, "v3", F.lit("2024-02-01").cast("timestamp"))
    return matched.join(out.select("key", "author"), "key", "left").select("key", "author", "author_canonical", "author_conf", "book_title", "book_conf", "matcher_version")


@query("""SELECT value, upper(value[1]) || value[2:] AS caption, count(*) AS cnt FROM (SELECT unnest([p_brand, lower(p_type), string_split(p_name, ' ')[1]]) AS value FROM part) GROUP BY value""")
def captioned_facet(spark, sf):
    values = F.array("p_brand", F.lower("p_type"), F.get(F.split("p_name", " "), F.lit(0)))
    return relational.captioned_facet(table(spark, sf, "part"), values, lambda x: pages.change_case(x, "first", True, False))


@query("SELECT DISTINCT CASE WHEN p_size > 5 THEN p_brand END AS brand FROM part")
def sorted_brands(spark, sf):
    return relational.sorted_values(table(spark, sf, "part").select(F.when(F.col("p_size") > 5, F.col("p_brand")).alias("brand")), "brand")


@query("""SELECT n_name, r_name IS NOT NULL AS found, count(*) AS cnt FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 > 0) ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 0) ON n_regionkey = r_regionkey GROUP BY ALL""")
def lookups_with_gaps(spark, sf):
    """Customers with the names of their nation and region, counted with those whose keys are unknown."""
    named = relational.looked_up(table(spark, sf, "customer"), table(spark, sf, "nation").filter("n_nationkey % 4 > 0"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"]).drop("found")
    return relational.looked_up(named, table(spark, sf, "region").filter("r_regionkey > 0"), "n_regionkey", "r_regionkey", ["r_name"]).groupBy("n_name", "found").agg(F.count("*").alias("cnt"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3")
def records_of_site(spark, sf):
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("web_site_id"))
    return catalogue.records_of_site(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("group_key")), groups, 3).select("c_custkey")


@query("""SELECT DISTINCT l_suppkey AS author_id, p_partkey AS book_id, p_name AS title FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 3 = 0""")
def books_of_authors(spark, sf):
    books = table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), (F.col("p_size") % 3).alias("deleted"))
    return matching.books_of(books, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("book_id"), F.col("l_suppkey").alias("author_id")))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_brand), 'brand#2') AND p_size * 60 > 600")
def filter_fields(spark, sf):
    """Fields as a user fills them in, one of them cleared again."""
    fields = relational.FilterFields().with_value("p_type", "x").with_value("p_name", "A").with_value("p_brand", "BRAND#2").with_value("length", "> 10 минут").with_value("p_type", "")
    return table(spark, sf, "part").withColumn("length", F.col("p_size") * 60).filter(fields.condition(("length",))).select("p_partkey")


@query("SELECT 'before' AS kind, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_id <= (SELECT max(event_id) FROM events) // 2) UNION ALL SELECT 'after', count(DISTINCT user_id) FROM events")
def store_cached(spark, sf):
    """A version in memory, renewed when a merge makes another."""
    store = filled_store(spark, sf)
    before = store.cached().agg(F.count("*").alias("n")).first()["n"]
    store.merge(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), [F.desc("ts"), F.desc("event_id")])
    after = store.cached().agg(F.count("*").alias("n")).first()["n"]
    store.release()
    return spark.createDataFrame([("before", before), ("after", after)], "kind string, n long")
