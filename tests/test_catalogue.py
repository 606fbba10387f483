"""Queries against their SQL, and functions against golden values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marram import page_queries, plan_queries, queries, record_queries, source_queries, value_queries  # noqa: F401
from marram.functions import fuzzy, parse, text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert got
    if name in queries.ORACLE_SQL:
        rel = duck.sql(queries.ORACLE_SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        order = [rel.columns.index(c) for c in sorted(rel.columns)]
        assert got == sorted(map(repr, (tuple(r[k] for k in order) for r in rel.fetchall())))


def test_delete_first_match_of_equal_rows(spark, tmp_path):
    """Ids that repeat within a supplier and across suppliers, whole copies, nulls, and a supplier that no table lists: one row of each goes."""
    lines = [(1, 1, 5), (1, 1, 5), (1, 1, 5), (0, 11, 10), (1, 1, 10), (2, 1, 5), (1, 1, 3), (1, 1, 3), (1, 1, 15), (0, 11, None), (1, 1, None), (None, 1, None), (None, 1, 20), (3, 1, 20), (None, 1, 25), (-4, 2, -5), (-4, 2, -5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5,), (10,), (20,), (25,), (-5,), (3,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = [(11, 3), (11, 3), (11, 5), (11, 5), (21, 5), (11, 10), (None, 20), (-38, -5), (11, None), (None, None)]
    got = queries.QUERIES["delete_first_match"](spark, str(tmp_path)).select("id", "l_suppkey").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) == sorted(map(repr, con.sql(queries.ORACLE_SQL["delete_first_match"]).fetchall()))


def value_of(spark, column, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"a{k} string" for k in range(len(args))))
    return row.select(column(*(F.col(f"a{k}") for k in range(len(args)))).alias("x")).first()[0]


DURATIONS = {"05:30:15": 19815, "45:30": 2730, "5 ч": 18000, "5 ч. 30 мин.": 19800, "5 часов": 300, "2 часа": 120, "12 часов 30 минут": 45000, "30 минут": 1800,
             "30 мин 15 сек": 1815, "45 сек": 2700, "10. 20. 30": 37230, "10. 20": 620, "42": 42, "1 ч + 30 мин": 5400, "~ 01:00:00": 3600, "3h 20min": 12000, "100:00:00": 360000, "": 0, None: 0}
BITRATES = {"128 kbps": 128, "128 Кбит/с": 128, "128 Кбит / с": 128, "MP3, 192 kbps": 192, "64-128 kbps VBR": 96, "~96 kbps": 96, "VBR 128": 128, "320": 320, "44100 Hz, 128 кбит / сек": 128, None: 0, "x": 0}
SIZES = {"1.5 GB": 1610612736, "2,5 Мб": 2621440, "7 Bytes": 0, None: 0, "": 0}
GOLDEN = [
    *((parse.duration_seconds, (k,), v) for k, v in DURATIONS.items()), *((parse.bitrate_kbps, (k,), v) for k, v in BITRATES.items()), *((parse.size_bytes, (k,), v) for k, v in SIZES.items()),
    *((fuzzy.metaphone, (k,), v) for k, v in {"кинг": "кинк", "кинк": "кинк", "толкин": "талкин", "толкиен": "талкин", "стивен": "стифин", "стивн": "стифн", "гоголь": "какал", "аннапа": "анапа", "жжшов": "шаф"}.items()),
    (fuzzy.ratio, ("kitten", "sitting"), 0.571429), (fuzzy.ratio, ("", ""), 1.0), (fuzzy.ratio, ("", "a"), 0.0), (fuzzy.ratio, (None, "a"), None),
    (fuzzy.token_set_ratio, ("the great ring", "ring"), 1.0), (fuzzy.token_set_ratio, ("red ring", "blue rod"), 0.125),
    (fuzzy.jaro_winkler, ("толкин", "толкиен"), 0.971429), (fuzzy.jaro_winkler, ("abcd", "azzz"), 0.55), (fuzzy.jaro_winkler, ("martha", "marhta"), 0.961111), (fuzzy.jaro_winkler, ("кинг", "кинк"), 0.883333),
    (fuzzy.jaro, ("red widget", "large gear"), 0.566667), (fuzzy.jaro, ("new widget", "red widget"), 0.804167), (fuzzy.jaro, ("", ""), 1.0), (fuzzy.jaro, ("", "a"), 0.0),
    (text.normalize, ("Ёжик  в тумане!! — 2",), "ежик в тумане 2"), (text.normalize, (None,), ""),
    (text.repair_homoglyphs, ("Kинг",), "Кинг"), (text.repair_homoglyphs, ("King",), "King"), (text.repair_homoglyphs, ("",), ""),
    (text.people, ("Кинг, Стивен",), ["Кинг, Стивен"]), (text.people, ("Кинг Стивен, Страуб Питер",), ["Кинг Стивен", "Страуб Питер"]), (text.people, (None,), []),
    (text.genres, ('Роман, "Проза" / =Драма',), ["Роман", "Проза", "Драма"]), (text.clean_title, ("Кинг Стивен - Мобильник (2006) [MP3]", "Стивен Кинг"), "Мобильник"), (text.clean_title, ("(x)", ""), "(x)"),
    (fuzzy.prefix_key, ("стивн",), "сти"),
]


def test_golden(spark):
    for f, args, want in GOLDEN:
        got = value_of(spark, f, *args)
        assert (abs(got - want) < 1e-6 if isinstance(want, float) else got == want), (f.__name__, args, got, want)


@pytest.mark.parametrize(("raw", "slots"), [("Кинг, Стивен", [1]), ("Стивен Кинг", [2]), ("Иванов Иван, Петров Пётр", [2, 2]), ("А; Б / В & Г", [1, 1, 1, 1]), ("", []), (None, [])])
def test_author_slots(spark, raw, slots):
    assert [len(x) for x in value_of(spark, text.author_slots, raw)] == slots


def test_dump_roundtrip(spark, tmp_path):
    from marram.sources import dump

    (tmp_path / "d.sql").write_text("DROP TABLE x;\nINSERT INTO `lib` VALUES (1,'a\\'b',NULL),(2,'it''s;\\n)','NULL');\nINSERT INTO `other` VALUES (9);\nINSERT INTO `lib` VALUES (x,'',3);\n")
    rows = dump.read_dump(spark, str(tmp_path / "d.sql"), "lib").orderBy("pos")
    assert [r["r"] for r in rows.collect()] == [["1", "a'b", None], ["2", "it's;\n)", "NULL"], ["x", "", "3"]]
    typed = rows.select(dump.lenient_int(F.col("r"), 0).alias("i"), dump.text_or_null(F.col("r"), 1).alias("s"), dump.text_or_empty(F.col("r"), 7).alias("e"))
    assert [tuple(r) for r in typed.collect()] == [(1, "a'b", ""), (2, "it's;\n)", ""), (0, None, "")]
