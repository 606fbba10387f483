"""Queries over what the library writes and reads back: dumps and stores, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marram.queries import query, table
from marram.session import shared_dir
from marram.sources import dump
from marram.sources.store import Store


def scratch(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def dumped(spark, sf) -> dict[str, str]:
    """A dump of the given tables: parts as books, suppliers as authors, lines as their links, orders as ratings and annotations."""
    part, supplier, lines, orders = (table(spark, sf, t) for t in ("part", "supplier", "lineitem", "orders"))
    text = F.concat(F.col("p_name"), F.lit(" 'it''s' \\ ;\n("), F.col("p_brand"), F.lit(");"))
    rows = {
        "libbook": part.select(dump.dump_line("libbook", [F.col("p_partkey"), F.col("p_size"), F.lit(0), text, F.lit(""), F.lit("ru"), F.lit(0), F.lit(0), F.lit("fb2"), F.lit(0), F.when(F.col("p_partkey") % 3 > 0, 2000 + F.col("p_size")), F.when(F.col("p_partkey") % 5 == 0, "1").otherwise("0")]).alias("value")),
        "libavtorname": supplier.select(dump.dump_line("libavtorname", [F.col("s_suppkey"), F.col("s_name"), F.lit(None), F.concat(F.lit("O'"), "s_name"), F.lit("")]).alias("value")),
        "libavtor": lines.select(dump.dump_line("libavtor", [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")]).alias("value")),
        "librate": orders.select(dump.dump_line("librate", [F.col("o_orderkey"), F.col("o_custkey"), F.lit(1), F.col("o_orderkey") % 8]).alias("value")),
        "libbannotations": orders.select(dump.dump_line("libbannotations", [F.col("o_custkey"), F.col("o_orderkey"), F.lit(None), F.col("o_orderpriority")]).alias("value")),
    }
    folder = scratch(spark, "dump")
    for name, df in rows.items():
        df.write.option("compression", "gzip" if name == "libavtorname" else "none").text(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in rows}


@query("""SELECT p_partkey AS book_id, p_name || ' ''it''''s'' \\ ;' || chr(10) || '(' || p_brand || ');' AS title, CAST(NULL AS VARCHAR) AS title_alt, 'ru' AS lang, CAST(CASE WHEN p_partkey % 3 > 0 THEN 2000 + p_size ELSE 0 END AS BIGINT) AS year,
    'fb2' AS file_type, CAST(p_size AS BIGINT) AS file_size, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS deleted FROM part""".replace("\\\\", "\\"))
def dump_books(spark, sf):
    """Books written as INSERT statements and read back, with quotes, backslashes, brackets and line feeds in their titles."""
    return dump.typed_rows(dump.read_dump(spark, dumped(spark, sf)["libbook"], "libbook"), "libbook")


@query("""WITH r AS (SELECT o_custkey AS book_id, o_orderkey % 8 AS rate FROM orders WHERE o_orderkey % 8 BETWEEN 1 AND 5) SELECT 'rating' AS kind, book_id, count(*) AS n, round(sum(rate) / count(*), 9) AS x FROM r GROUP BY book_id
    UNION ALL SELECT 'link', book_id, count(*), CAST(sum(author_id) AS DOUBLE) FROM (SELECT DISTINCT l_partkey AS book_id, l_suppkey AS author_id FROM lineitem) GROUP BY book_id
    UNION ALL SELECT 'author', s_suppkey, 1, CAST(length('O''' || s_name) AS DOUBLE) FROM supplier
    UNION ALL SELECT 'annotation', o_custkey, count(*), CAST(sum(o_orderkey) AS DOUBLE) FROM orders GROUP BY o_custkey""")
def dump_relations(spark, sf):
    """Authors from a compressed file, links of which the first of each pair counts, ratings by book, annotations."""
    paths = dumped(spark, sf)
    rows = {name: dump.typed_rows(dump.read_dump(spark, paths[name], name), name) for name in paths if name != "libbook"}
    out = rows["librate"].select(F.lit("rating").alias("kind"), "book_id", F.col("votes").cast("long").alias("n"), F.round("avg_rate", 9).alias("x"))
    out = out.unionByName(rows["libavtor"].groupBy("book_id").agg(F.lit("link").alias("kind"), F.count("*").alias("n"), F.sum("author_id").cast("double").alias("x")))
    out = out.unionByName(rows["libavtorname"].select(F.lit("author").alias("kind"), F.col("author_id").alias("book_id"), F.lit(1).cast("long").alias("n"), F.length("last_name").cast("double").alias("x")))
    return out.unionByName(rows["libbannotations"].groupBy("book_id").agg(F.lit("annotation").alias("kind"), F.count("*").alias("n"), F.sum("nid").cast("double").alias("x")))


@query("""SELECT 'source' AS key, 'SQL dump' AS value UNION ALL SELECT 'imported_utc', '2024-02-01T12:00:00' UNION ALL SELECT 'rows_book', CAST(count(*) AS VARCHAR) FROM part UNION ALL SELECT 'rows_author', CAST(count(*) AS VARCHAR) FROM supplier
    UNION ALL SELECT 'rows_book_author', CAST(count(*) AS VARCHAR) FROM lineitem UNION ALL SELECT 'rows_book_rating', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders WHERE o_orderkey % 8 BETWEEN 1 AND 5
    UNION ALL SELECT 'rows_book_annotation', CAST(count(*) AS VARCHAR) FROM orders UNION ALL SELECT unnest(['rows_genre', 'rows_book_genre', 'rows_sequence', 'rows_book_sequence', 'rows_joined_book', 'rows_author_annotation']), '0'""")
def dump_import_meta(spark, sf):
    """A whole import: every table rebuilt, and what import_meta says of it."""
    return dump.import_dump(spark, dumped(spark, sf), scratch(spark, "reference"), F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))


def filled_store(spark, sf) -> Store:
    """Each user's latest event of the first half of them all."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    half = events.join(F.broadcast(events.agg(F.floor(F.max("event_id") / 2).alias("half")))).filter("event_id <= half").drop("half")
    return Store.create(half.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*"), scratch(spark, "store"), ["user_id"], 16)


@query("""WITH m AS (SELECT max(event_id) AS m FROM events), e AS (SELECT *, CASE WHEN event_id <= m // 2 THEN 0 WHEN event_id <= m * 3 // 4 THEN 1 ELSE 2 END AS batch FROM events, m)
    SELECT user_id, event_id, event_type FROM e WHERE batch <> 1 OR user_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, ts DESC, event_id DESC) = 1""")
def store_merges(spark, sf):
    """Two batches of changed rows merged into a filled store, the first of them twice."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    most = F.broadcast(events.agg(F.max("event_id").alias("m")))
    one = events.join(most).filter("event_id > floor(m / 2) AND event_id <= floor(m * 3 / 4) AND user_id % 3 = 0").drop("m")
    two = events.join(most).filter("event_id > floor(m * 3 / 4)").drop("m")
    store, order = filled_store(spark, sf), [F.desc("ts"), F.desc("event_id")]
    for batch, rows in ((0, one), (0, one), (1, two), (0, one)):
        store.merge(rows, order, batch)
    return store.read().select("user_id", "event_id", "event_type")


@query("""SELECT 'hidden' AS kind, doc_id, CAST(toxic AS BIGINT) AS value FROM labels WHERE toxic = 1 UNION ALL SELECT 'hidden', doc_id, 2 FROM labels WHERE quality = 1
    UNION ALL SELECT 'group', c_nationkey, c_custkey FROM customer WHERE c_nationkey % 2 = 1 AND c_custkey % 10 > 0 UNION ALL SELECT 'group', c_nationkey, c_custkey FROM customer WHERE c_nationkey % 2 = 0""")
def store_sinks(spark, sf):
    """Marks that are only ever appended; groups whose changed rows replace all of a key's, equal keys kept."""
    labels, customers = table(spark, sf, "labels"), table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").alias("value"))
    marks = Store.create(labels.filter("toxic = 1").select("doc_id", F.col("toxic").cast("long").alias("value")), scratch(spark, "marks"), ["doc_id"], 8)
    marks.append(labels.filter("quality = 1").select("doc_id", F.lit(2).cast("long").alias("value")))
    groups = Store.create(customers, scratch(spark, "groups"), ["doc_id"], 8)
    groups.merge(customers.filter("doc_id % 2 = 1 AND value % 10 > 0"))
    return marks.read().withColumn("kind", F.lit("hidden")).unionByName(groups.read().withColumn("kind", F.lit("group"))).select("kind", "doc_id", "value")
