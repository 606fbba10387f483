"""Dumps over splits, and stores with versions."""

import gzip

import pytest
from pyspark.sql import functions as F

from marram.sources import dump
from marram.sources.store import Store
from marram.streaming.flush import flush_into

INSERT = "INSERT INTO `libbook` VALUES "
LINES = [
    "DROP TABLE x;", INSERT + "(1,9,0,'It\\'s; a", ") title','t1','ru',0,0,'fb2',0,2001,'1'),(1,9,0,'Later','','',0,0,'',0,1,'0');\r", "INSERT INTO `other` VALUES ('9','z'); ", "(3,0);",
    INSERT + "(2,x,0,NULL,'',''); \t", INSERT + "(4,1,0,'a", INSERT + "still within", *(f"line {k} of a long text" for k in range(40)), "end;", "(5);", INSERT + "(6,1,0,'open to the end", "of the file",
]


def brute(lines):
    rows, held = [], None
    for line in lines:
        if held is None and not line.startswith(INSERT):
            continue
        held = [*(held or []), line]
        if line.rstrip(" \t\r").endswith(";"):
            rows += dump.parse_values("\n".join(held)[len(INSERT) :])
            held = None
    return rows + (dump.parse_values("\n".join(held)[len(INSERT) :]) if held else [])


@pytest.mark.parametrize(("split", "zipped"), [(60, False), (333, False), (1 << 20, False), (333, True)])
def test_statements_over_splits(spark, tmp_path, split, zipped):
    """However small the splits are, statements come whole and in order; the files don't mix."""
    data = "\n".join(LINES).encode()
    for name in ("a", "b"):
        (tmp_path / (f"{name}.sql.gz" if zipped else f"{name}.sql")).write_bytes(gzip.compress(data) if zipped else data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = dump.read_dump(spark, str(tmp_path), "libbook").orderBy("file", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = brute([line.removesuffix("\r") for line in LINES])
    assert [r.r for r in got] == want + want and len({r.file for r in got}) == 2
    typed = dump.typed_rows(dump.read_dump(spark, str(tmp_path), "libbook"), "libbook")
    assert {r.book_id: (r.title[:8], r.year, r.deleted) for r in typed.filter("book_id < 3").collect()} == {1: ("It's; a\n", 2001, 1), 2: ("", 0, 0)}


def test_missing_files_and_meta(spark, tmp_path):
    (tmp_path / "genres.sql").write_text("INSERT INTO `libgenrelist` VALUES (1,'sf','Fiction',''),(1,'no','x',''),(2,'det',NULL,'m');\n")
    meta = dump.import_dump(spark, {"libgenrelist": str(tmp_path / "genres.sql")}, f"{tmp_path}/out", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    found = {r.key: r.value for r in meta.collect()}
    assert found["rows_genre"] == "3" and found["rows_book"] == "0" and len(found) == 13 and found["imported_utc"] == "2024-01-01T00:00:00"
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/genre").orderBy("genre_id").collect()] == [(1, "sf", "Fiction", None), (2, "det", None, "m")]


def rows_of(store, version=None):
    return sorted((r.k, r.t, r.v) for r in store.read(version).collect())


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "k int, t int, v string"
    store = Store.create(spark.createDataFrame([(k, 0, "old") for k in range(40)], schema), f"{tmp_path}/s", ["k"], 8)
    changed = spark.createDataFrame([(3, 1, "a"), (3, 2, "b"), (99, 1, "n")], schema)
    before = {r["bucket"]: r["path"] for r in store.listing()[1]}
    assert store.merge(changed, [F.desc("t")], 0) == 1
    touched = {r.b for r in changed.select(Store.bucket_of(["k"], 8).alias("b")).collect()}
    after = {r["bucket"]: r["path"] for r in store.listing()[1]}
    assert {b for b in after if b >= 0 and after[b] != before.get(b)} == touched
    want = sorted([(k, 0, "old") for k in range(40) if k != 3] + [(3, 2, "b"), (99, 1, "n")])
    assert rows_of(store) == want and rows_of(store, 0) == [(k, 0, "old") for k in range(40)]
    assert store.merge(changed.limit(0).unionByName(spark.createDataFrame([(1, 1, "x")], schema)), [F.desc("t")], 0) == 1  # a batch that is run again
    assert rows_of(store) == want
    assert store.append(spark.createDataFrame([(1, 5, "more")], schema)) == 2
    assert rows_of(store) == sorted([*want, (1, 5, "more")])
    assert store.merge(spark.createDataFrame([(1, 0, ""), (3, 0, "")], schema), delete=True) == 3
    assert rows_of(store) == [x for x in want if x[0] not in (1, 3)]
    store.forget_before(3)
    assert store.versions() == [3] and rows_of(store) == [x for x in want if x[0] not in (1, 3)]


def test_failed_write_leaves_the_last_version(spark, tmp_path):
    store = Store.create(spark.createDataFrame([(1, "a")], "k int, v string"), f"{tmp_path}/s", ["k"], 4)
    bad = spark.createDataFrame([(1, "b")], "k int, v string").withColumn("v", F.when(F.col("k") > 0, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        store.merge(bad)
    assert store.versions() == [0] and [r.v for r in store.read().collect()] == ["a"]
    (tmp_path / "s/versions/v=1").mkdir()
    with pytest.raises(Exception, match="(?i)exists"):
        store.merge(spark.createDataFrame([(1, "c")], "k int, v string"))  # another writer has begun this version
    assert [r.v for r in store.read().collect()] == ["a"]


def test_null_keys_and_empty_stores(spark, tmp_path):
    schema = "k int, v string"
    store = Store.create(spark.createDataFrame([], schema), f"{tmp_path}/s", ["k"], 4)
    assert store.read() is None
    store.merge(spark.createDataFrame([(None, "a"), (1, "b")], schema), [F.col("v")])
    store.merge(spark.createDataFrame([(None, "c")], schema), [F.col("v")])
    assert sorted((r.k is None, r.v) for r in store.read().collect()) == [(False, "b"), (True, "c")]


def test_flush(spark, tmp_path):
    schema = "k int, t int, v string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], schema).write.parquet(f"{tmp_path}/in")
    store = Store.create(spark.createDataFrame([(2, 9, "old"), (3, 9, "kept")], schema), f"{tmp_path}/out", ["k"], 4)
    for more in (False, True):
        if more:
            spark.createDataFrame([(3, 1, "d")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        flush_into(stream, store, f"{tmp_path}/check", [F.desc("t")], once=True).awaitTermination(60)
    assert sorted((r.k, r.v) for r in store.read().collect()) == [(1, "b"), (2, "c"), (3, "d")]
