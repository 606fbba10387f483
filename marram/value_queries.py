"""Queries of value functions over strings made of the given tables' numbers and names, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions import fuzzy, pages, parse, text
from marram.operators import records, relational
from marram.queries import query, table


def said(pattern: str, *values: Column | str) -> Column:
    return F.format_string(pattern, *(F.col(v) if isinstance(v, str) else v for v in values))


def chosen(key: str, *forms: Column) -> Column:
    """The form whose place is the key's remainder."""
    return F.element_at(F.array(*forms), F.pmod(F.col(key), F.lit(len(forms))).cast("int") + 1)


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 8 AS f, 1 + o_orderkey % 9 AS h, 10 + o_orderkey % 50 AS m, 10 + o_orderkey % 40 AS s FROM orders)
    SELECT o_orderkey, CAST(CASE f WHEN 0 THEN 3600 * h + 60 * m + s WHEN 1 THEN 60 * m + s WHEN 2 THEN 3600 * h + 60 * m WHEN 3 THEN 60 * m WHEN 4 THEN 60 * m + s
        WHEN 5 THEN 3600 * h + 60 * m WHEN 6 THEN 3600 * h + 60 * m ELSE 0 END AS BIGINT) AS seconds FROM x""")
def parse_duration(spark, sf):
    """Clock times, words and sums of both."""
    x = table(spark, sf, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 9).alias("h"), (10 + F.col("o_orderkey") % 50).alias("m"), (10 + F.col("o_orderkey") % 40).alias("s"))
    value = chosen("o_orderkey", said("%02d:%02d:%02d", "h", "m", "s"), said("%02d:%02d", "m", "s"), said("%d ч. %d мин.", "h", "m"), said("%d минут", "m"), said("%d мин %d сек", "m", "s"), said("%dh %dmin", "h", "m"), said("%d ч + %d мин", "h", "m"), F.lit(None).cast("string"))
    return x.select("o_orderkey", parse.duration_seconds(value).cast("long").alias("seconds"))


@query("""WITH x AS (SELECT c_custkey, c_custkey % 6 AS f, 32 + 2 * (c_custkey % 100) AS n FROM customer)
    SELECT c_custkey, CAST(CASE f WHEN 2 THEN 3 * n // 2 WHEN 5 THEN 0 ELSE n END AS BIGINT) AS kbps FROM x""")
def parse_bitrate(spark, sf):
    x = table(spark, sf, "customer").select("c_custkey", (32 + 2 * (F.col("c_custkey") % 100)).alias("n"))
    value = chosen("c_custkey", said("%d kbps", "n"), said("MP3, %d kbps", "n"), said("%d-%d kbps VBR", "n", 2 * F.col("n")), said("%d Кбит/с", "n"), said("~%d kbps", "n"), F.lit("unknown"))
    return x.select("c_custkey", parse.bitrate_kbps(value).cast("long").alias("kbps"))


@query("""SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN (p_size + 0.5) * 1048576 WHEN 1 THEN (p_size + 0.25) * 1073741824 WHEN 3 THEN p_size * 1024 ELSE 0 END AS BIGINT) AS bytes FROM part""")
def parse_size(spark, sf):
    value = chosen("p_partkey", said("%d,5 Мб", "p_size"), said("%d.25 GB", "p_size"), said("%d gb", "p_size"), said("%d Кб", "p_size"), F.lit(None).cast("string"))
    return table(spark, sf, "part").select("p_partkey", parse.size_bytes(value).alias("bytes"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS plain FROM documents""")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize(F.col("text")).alias("plain"))


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопярстувшхйз"


@query(f"""WITH x AS (SELECT p_partkey, string_split(translate(translate(p_name, '{LATIN}', '{CYRILLIC}'), '{fuzzy.METAPHONE_FROM}ьъ ', '{fuzzy.METAPHONE_TO}'), '') AS l FROM part)
    SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: i = 1 OR l[i] <> l[i - 1]), lambda i: l[i]), '') AS sound FROM x""")
def metaphone_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fuzzy.metaphone(F.translate("p_name", LATIN, CYRILLIC)).alias("sound"))


@query("SELECT p_partkey, p_name AS title FROM part")
def clean_title(spark, sf):
    """Titles with their author before them, or groups of brackets of any depth behind them."""
    depth = (F.col("p_size") % 40 + 1).cast("int")
    wrapped = F.concat("p_name", F.lit(" "), F.repeat(F.lit("("), depth), F.lit("x"), F.repeat(F.lit(")"), depth), F.repeat(F.lit(" [y]."), depth))
    title = chosen("p_partkey", F.concat_ws(" - ", "p_brand", "p_name"), wrapped, F.concat("p_brand", F.lit(" — "), wrapped), F.concat(F.lit("«"), "p_name", F.lit("» {z}")))
    return table(spark, sf, "part").select("p_partkey", text.clean_title(title, F.col("p_brand")).alias("title"))


@query("""WITH x AS (SELECT c_custkey, lower(c_mktsegment) AS seg, 'n' || c_custkey AS num FROM customer)
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN seg || '/' || num WHEN 1 THEN num || '/' || seg || ',' || seg || '/' || num WHEN 2 THEN seg || '/|' || num || '/' ELSE '' END AS slots FROM x""")
def author_slots(spark, sf):
    """Names with a comma, in free form, and several at once: people joined by bars, their readings by commas."""
    number = F.concat(F.lit("N"), "c_custkey")
    raw = chosen("c_custkey", F.concat_ws(", ", "c_mktsegment", number), F.concat_ws(" ", "c_mktsegment", number), F.concat_ws("; ", "c_mktsegment", number), F.lit(None).cast("string"))
    readings = F.transform(text.author_slots(raw), lambda s: F.array_join(F.transform(s, lambda r: F.concat_ws("/", r["surname"], r["given"])), ","))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(readings, "|").alias("slots"))


@query("SELECT p_partkey, substr('АКСТОРНХМЕВ', CAST(p_partkey % 11 + 1 AS INTEGER), 1) || 'инг' || p_size || ' King ' || p_name AS repaired FROM part")
def homoglyph_repair(spark, sf):
    mixed = F.concat(F.substring(F.lit("AKCTOPHXMEB"), (F.col("p_partkey") % 11 + 1).cast("int"), F.lit(1)), F.lit("инг"), "p_size", F.lit(" King "), "p_name")
    return table(spark, sf, "part").select("p_partkey", text.repair_homoglyphs(mixed).alias("repaired"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '+' || p_brand || ' x' ELSE '' END AS people, p_brand || '+' || p_type || '+' || p_name AS genres, p_brand || '+' || p_type AS atoms FROM part""")
def split_values(spark, sf):
    """Values of people (two words stay whole), of genres and of mapped genres, joined by plus signs."""
    people = chosen("p_partkey", F.col("p_name"), F.concat("p_name", F.lit(", "), "p_brand", F.lit(" x")), F.lit(None).cast("string"))
    genres = F.concat(F.lit('"'), "p_brand", F.lit('" / ='), "p_type", F.lit(" |; "), "p_name")
    atoms = F.concat("p_brand", F.lit(" ,, "), "p_type")
    return table(spark, sf, "part").select("p_partkey", *(F.array_join(x, "+").alias(name) for name, x in (("people", text.people(people)), ("genres", text.genres(genres)), ("atoms", text.genre_atoms(atoms)))))


WORDS = "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]"


@query(f"""SELECT p_partkey, {WORDS} AS words, upper(p_name[1]) || p_name[2:] || ', ' || upper(p_type[1]) || lower(p_type[2:]) AS splitter, upper(p_name[1]) || p_name[2:] AS first FROM part""")
def change_case(spark, sf):
    words = pages.change_case(F.concat(F.lit(". "), F.col("p_name"), F.lit(",")), "words", True, True)
    splitter = pages.change_case(F.concat(F.upper("p_name"), F.lit(","), F.lower("p_type")), "splitter", False, True)
    first = pages.change_case(F.concat(F.lit("«"), F.upper("p_name"), F.lit("»")), "first", False, True)
    return table(spark, sf, "part").select("p_partkey", words.alias("words"), splitter.alias("splitter"), first.alias("first"))


@query("SELECT s_suppkey, s_name || ' & co' AS value, s_name[1:9] || '…' AS short, 'John ' || s_name AS name FROM supplier")
def clean_values(spark, sf):
    raw = F.concat(F.lit(": - "), "s_name", F.lit(" &amp; co =\r\nsecond"))
    return table(spark, sf, "supplier").select("s_suppkey", pages.clean_value(raw, False, 100).alias("value"), pages.clean_value(raw, False, 10).alias("short"), pages.clean_name(F.concat(F.lit(" © … john "), "s_name"), 250).alias("name"))


@query("SELECT o_orderkey, o_orderpriority || ' - ' || o_orderkey AS title FROM orders")
def forum_title(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pages.forum_title(F.concat("o_orderpriority", F.lit("&nbsp; - "), "o_orderkey", F.lit(" &#8212;[MP3, 128]"))).alias("title"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ', ' || c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN 'a' ELSE c_name END AS author,
    CASE WHEN c_custkey % 4 IN (0, 3) THEN c_mktsegment || ', ' || c_name ELSE c_mktsegment END AS canonical FROM customer""")
def composed_authors(spark, sf):
    key = F.col("c_custkey") % 4
    author, surname, given = F.when(key == 2, "a").when(key == 1, ""), F.when(key < 2, F.col("c_mktsegment")), F.when(key.isin(0, 3), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.compose_author(author, surname, given).alias("author"), records.canonical_name(F.col("c_mktsegment"), given).alias("canonical"))


@query("SELECT event_id, CAST((epoch_us(ts) + 450000000) // 900000000 * 900 AS BIGINT) AS second FROM events")
def rounded_times(spark, sf):
    return table(spark, sf, "events").select("event_id", F.unix_seconds(records.rounded_time(F.col("ts"), 900)).alias("second"))


@query("SELECT p_partkey, p_brand || '_' || p_name || '_' || p_size || '_' AS name FROM part")
def safe_file_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.safe_file_name(F.concat("p_brand", F.lit(":"), "p_name", F.lit("/"), "p_size", F.lit("?"))).alias("name"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) < 0.0005 AND l_quantity > 10")
def nearly_equal_rate(spark, sf):
    return records.filtered(table(spark, sf, "lineitem").filter(records.nearly(F.col("l_discount"), F.lit(0.05))), F.col("l_quantity") > 10).select("l_orderkey", "l_linenumber")


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 3600 * (1 + p_size % 9) + 60 * (10 + p_size) WHEN 1 THEN 60 * (10 + p_size) ELSE 0 END AS stated, CASE WHEN p_partkey % 2 = 0 THEN 64 + p_size ELSE 0 END AS kbps, p_partkey % 500 * 300000 AS size FROM part)
    SELECT p_partkey, CAST(stated AS INTEGER) AS parsed_seconds, CAST(kbps AS INTEGER) AS parsed_kbps, CAST(CASE WHEN size <= 0 THEN 0 WHEN kbps <= 0 THEN stated
        WHEN stated > 0 AND stated / floor(size / (kbps * 128)) > 0.8 AND stated / floor(size / (kbps * 128)) < 1.2 THEN stated ELSE floor(size / (kbps * 128)) END AS BIGINT) AS effective_seconds FROM x""")
def computed_record_columns(spark, sf):
    length = chosen("p_partkey", said("%d ч. %d мин.", 1 + F.col("p_size") % 9, 10 + F.col("p_size")), said("%d минут", 10 + F.col("p_size")), F.lit(None).cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 500 * 300_000).alias("size_bytes"), length.alias("length"), F.when(F.col("p_partkey") % 2 == 0, said("%d kbps", 64 + F.col("p_size"))).alias("bitrate"))
    out = records.computed_columns(rows)
    return out.select("p_partkey", F.col("parsed_seconds").cast("int").alias("parsed_seconds"), F.col("parsed_kbps").cast("int").alias("parsed_kbps"), "effective_seconds")


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(NULL AS VARCHAR) AS o_orderpriority, CAST(0 AS DOUBLE) AS o_totalprice FROM orders")
def cleared_columns(spark, sf):
    return records.cleared(table(spark, sf, "orders").drop("o_orderdate"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")


@query("""WITH x AS (SELECT c_custkey AS k, c_custkey // 2 AS f FROM customer)
    SELECT k AS key, CASE WHEN k % 2 = 0 AND f % 5 = 0 THEN 'Known ' || f WHEN k % 2 = 0 THEN 'Fam' || f || ', G' || f WHEN k - 1 IN (SELECT c_custkey FROM customer) THEN 'Fam' || f || ', G' || f ELSE '' END AS author,
        CASE WHEN k % 7 = 0 THEN 'Fantasy' WHEN k % 7 = 1 THEN '' ELSE 'prose' END AS genre, CASE WHEN k % 3 = 0 THEN '320' ELSE 'y' END AS bitrate FROM x""")
def normalise_rules(spark, sf):
    """Replacements, composed authors, and authors recovered from titles by what other rows were called before replacement."""
    k, f = F.col("c_custkey"), F.floor(F.col("c_custkey") / 2)
    even = k % 2 == 0
    rows = table(spark, sf, "customer").select(
        k.alias("key"), F.when(~even, "").alias("author"), F.when(even, F.concat(F.lit("Fam"), f)).alias("author_surname"), F.when(even, F.concat(F.lit("G"), f)).alias("author_name"),
        F.when(even, "t").otherwise(F.concat(F.lit("FAM"), f, F.lit(", g"), f, F.lit(" - It"))).alias("title"),
        F.when(k % 7 == 0, "фэнтези").when(k % 7 > 1, "prose").alias("genre"), F.when(k % 3 == 0, "X").otherwise("y").alias("bitrate"), F.lit("p").alias("publisher"), F.lit("r").alias("reader"),
    )
    known = table(spark, sf, "customer").filter((k % 10 == 0)).select((k * 10).alias("id"), F.lit("author").alias("property"), F.concat(F.lit("fam"), f, F.lit(", G"), f).alias("possible_value"), F.concat(F.lit("Known "), f).alias("replace_value"))
    same = known.unionByName(spark.createDataFrame([(1, "genre", "ФЭНТЕЗИ", "Fantasy"), (2, "bitrate", "x", "320")], known.schema))
    return records.normalise_records(rows, same).select("key", "author", "genre", "bitrate")


@query("""WITH k AS (SELECT lower(r_name) AS k, r_regionkey AS id FROM region WHERE r_regionkey < 3), n AS (SELECT upper(r_name) AS name FROM region UNION ALL SELECT n_name FROM nation),
    f AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT DISTINCT lower(name) AS k FROM n WHERE lower(name) NOT IN (SELECT k FROM k)))
    SELECT name, CAST(coalesce(k.id, (SELECT max(id) FROM k) + f.n) AS INTEGER) AS id FROM n LEFT JOIN k ON lower(name) = k.k LEFT JOIN f ON lower(name) = f.k""")
def site_ids(spark, sf):
    """Known sites keep their ids whatever their names' case; new ones are numbered after them."""
    sites = table(spark, sf, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("id"), F.lower("r_name").alias("plugin_name"))
    names = table(spark, sf, "region").select(F.upper("r_name").alias("plugin_name")).unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("plugin_name")))
    return records.site_id(sites, names).withColumn("id", F.col("id").cast("int"))


@query("""WITH t AS (SELECT 'p_type' AS property, p_type AS replace_value, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS possible FROM part GROUP BY p_type)
    SELECT *, replace_value IN (SELECT p_type FROM part WHERE p_size = 50 AND p_partkey % 2 = 0) AS hidden FROM t""")
def replacement_tree(spark, sf):
    part = table(spark, sf, "part")
    same = part.select(F.lit("p_type").alias("property"), F.col("p_type").alias("replace_value"), F.col("p_brand").alias("possible_value"))
    hidden = part.filter("p_size = 50 AND p_partkey % 2 = 0").select(F.lit("p_type").alias("property"), F.col("p_type").alias("value"))
    return records.replacement_tree(same, hidden).withColumn("possible", F.array_join("possible", ","))


@query("SELECT p_partkey AS id, p_type AS value FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey = 7)")
def delete_replacements(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("value"))
    return records.delete_replacements(part, part.filter("id = 7"), ["value"])


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey FROM lineitem QUALIFY NOT (l_suppkey % 5 = 0 AND row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) = 1)""")
def delete_first_match(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_suppkey")
    wanted = rows.filter(F.coalesce(F.col("l_suppkey") % 5, F.lit(0)) == 0)  # QUALIFY drops rows whose condition is null: the first without a supplier goes too
    return records.delete_first(rows, wanted, ["l_suppkey"], [F.col("id").asc_nulls_last()])


@query("""SELECT doc_id, source FROM documents d WHERE lang = 'en' AND (source = 'src1' OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id))""")
def hidden_switch(spark, sf):
    """English documents without the hidden ones, and those of one source with them: the same filter, hidden rows excluded or included."""
    docs, marks = table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", "source"), table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    with_hidden = relational.visible(docs.filter("source = 'src1'"), marks, ["doc_id"], include_hidden=True)
    return with_hidden.unionByName(relational.visible(docs.filter("source <> 'src1'"), marks, ["doc_id"]))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 3000 END AS s FROM orders) SELECT 'more' AS wish, o_orderkey FROM x WHERE s > 2700 UNION ALL SELECT 'less', o_orderkey FROM x WHERE s < 330
    UNION ALL SELECT 'same', o_orderkey FROM x WHERE s = 1800 UNION ALL SELECT 'any', o_orderkey FROM x WHERE o_orderkey % 100 = 0""")
def duration_wishes(spark, sf):
    """Durations that meet wishes as a user types them."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 3000).alias("s"))
    out = rows.filter("o_orderkey % 100 = 0").filter(relational.duration_filter(F.col("s"), None)).select(F.lit("any").alias("wish"), "o_orderkey")
    for wish, typed in (("more", "> 45:00"), ("less", "<5 мин 30 сек"), ("same", "30 минут")):
        out = out.unionByName(rows.filter(relational.duration_filter(F.col("s"), typed)).select(F.lit(wish).alias("wish"), "o_orderkey"))
    return out
