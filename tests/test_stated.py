"""Functions against stated values."""

import json

import pytest
from pyspark.sql import functions as F

from marram.functions import fuzzy, pages, parse, text
from marram.operators import records, relational

NOW = "2024-02-01 12:00:00"
STATED = {}


def stated(name, f, cases, kind="string"):
    STATED[name] = f, cases, kind


stated("parse_duration", parse.duration_seconds, [
    ("05:30:15", 19815), ("45:30", 2730), ("5 ч", 18000), ("5 ч. 30 мин.", 19800), ("5 часов", 300), ("2 часа", 120), ("12 часов 30 минут", 45000), ("30 минут", 1800), ("30 мин 15 сек", 1815),
    ("45 сек", 2700), ("10. 20. 30", 37230), ("10. 20", 620), ("42", 42), ("1 ч + 30 мин", 5400), ("~ 01:00:00", 3600), ("3h 20min", 12000), ("100:00:00", 360000), ("", 0), (None, 0),
], "long")
stated("parse_bitrate", parse.bitrate_kbps, [
    ("128 kbps", 128), ("128 Кбит/с", 128), ("128 Кбит / с", 128), ("MP3, 192 kbps", 192), ("64-128 kbps VBR", 96), ("~96 kbps", 96), ("VBR 128", 128), ("320", 320), ("44100 Hz, 128 кбит / сек", 128), (None, 0), ("x", 0),
], "long")
stated("parse_size", parse.size_bytes, [
    ("1.5 GB", 1610612736), ("2,5 Мб", 2621440), ("2,5 мб", 0), ("1 gb", 0), ("-1 GB", 0), ("1e3 KB", 0), ("3 Кб", 3072), ("7 Bytes", 0), ("GB", 0), (None, 0), ("", 0),
], "long")
stated("effective_length", parse.effective_seconds, [
    (128 * 128 * 100, 128, 81, 81), (128 * 128 * 100, 128, 80, 100), (128 * 128 * 100, 128, 119, 119), (128 * 128 * 100, 128, 122, 100), (128 * 128 * 100, 128, 0, 100), (0, 128, 50, 0), (5000, 0, 50, 50),
], "long")
stated("normalize_text", text.normalize, [("Ёжик  в тумане!! — 2", "ежик в тумане 2"), ("", ""), (None, ""), ("A_b-C", "a b c")])
stated("metaphone_key", fuzzy.metaphone, [("кинг", "кинк"), ("кинк", "кинк"), ("толкин", "талкин"), ("толкиен", "талкин"), ("стивен", "стифин"), ("стивн", "стифн"), ("гоголь", "какал"), ("аннапа", "анапа"), ("жжшов", "шаф")])
stated("clean_title", text.clean_title, [
    ("Кинг Стивен - Мобильник (2006) [MP3]", "Стивен Кинг", "Мобильник"), ("…Title…", "", "Title"), ("“Title”", "", "“Title”"), ("«Title»", "", "Title"), ("(x)", "", "(x)"), (None, "a", ""),
    ("Title (1) (2) (3) (4) (5) (6) (7) (8)", "", "Title"), ("Title" + " (x)" * 50 + " [y].", "", "Title"), ("T " + "(" * 9 + "x" + ")" * 9 + " {z}", "", "T"), ("T (a", "", "T (a"), ("T a)", "", "T a)"), ("T (a]b) [c", "", "T (a]b) [c"), ("(all) of (it)", "", "(all) of"), ("a \U0001f600 (b)", "", "a \U0001f600"),
])
stated("author_slots", lambda x: F.transform(text.author_slots(x), lambda s: F.transform(s, lambda r: F.concat_ws("/", r["surname"], r["given"]))), [
    ("Кинг, Стивен", [["кинг/стивен"]]), ("Ivanov , Ivan", [["ivanov/ivan"]]), ("Стивен Кинг", [["кинг/стивен", "стивен/кинг"]]), ("Иванов Иван, Петров Пётр", [["иван/иванов", "иванов/иван"], ["петр/петров", "петров/петр"]]),
    ("А; Б / В", [["а/"], ["б/"], ["в/"]]), ("", []), (None, []),
], "json")
stated("homoglyph_repair", text.repair_homoglyphs, [("Kинг", "Кинг"), ("King", "King"), ("", ""), (None, None)])
stated("people_values", text.people, [("Кинг, Стивен", ["Кинг, Стивен"]), ("Кинг Стивен, Страуб Питер", ["Кинг Стивен", "Страуб Питер"]), (None, [])], "json")
stated("genre_values", text.genres, [('Роман, "Проза" / =Драма', ["Роман", "Проза", "Драма"]), (None, []), (" , ;", [])], "json")
stated("ratio_pairs", lambda a, b: F.round(fuzzy.ratio(a, b), 6), [("kitten", "sitting", 0.571429), ("", "", 1.0), ("", "a", 0.0), (None, "a", None)], "double")
stated("token_set_pairs", lambda a, b: F.round(fuzzy.token_set_ratio(a, b), 6), [("the great ring", "ring", 1.0), ("red ring", "blue rod", 0.125)], "double")
stated("jaro_winkler_stated", lambda a, b: F.round(fuzzy.jaro_winkler(a, b), 6), [("толкин", "толкиен", 0.971429), ("abcd", "azzz", 0.55), ("martha", "marhta", 0.961111), ("кинг", "кинк", 0.883333)], "double")
stated("change_case_words", lambda x: pages.change_case(x, "words", True, True), [
    ("иван  петров", "Иван Петров"), ("\"стивен кинг\".", "Стивен Кинг"), ("a|b[c]", "A / B (c)"), ("x,y", "X, Y"), ("mcDonald", "McDonald"), ("", ""), (None, None),
])
stated("change_case_splitter", lambda x: pages.change_case(x, "splitter", False, True), [("РОМАН,проза", "Роман, Проза"), ("fantasy/sci fi", "Fantasy / Sci fi"), ("a.b", "A. B"), ("", "")])
stated("change_case_first", lambda x: pages.change_case(x, "first", False, True), [("МР3 128", "Мр3 128"), ("«x»", "X")])
stated("clean_value", lambda x: pages.clean_value(x, False, 10), [(": - value =\r\nsecond", "value"), ("a &amp; b", "a & b"), ("0123456789abc", "012345678…"), ("", ""), ("\r\nsecond", "second")])
stated("clean_name", lambda x: pages.clean_name(x, 250), [(" — иван иванов", "Иван Иванов"), ("© john smith", "John Smith")])
stated("forum_title", pages.forum_title, [("King - It [2001, MP3]", "King - It"), ("A&nbsp;B &#8212; C", "AB  C")])
stated("page_count", text.page_count, [("<a href='x'>1</a> <a>12</a> <a>next</a>", 12), ("none", 1)], "long")
stated("magnet_link", text.magnet, [("<a href='magnet:?xt=1'>m</a><a href=\"y\">y</a>", "magnet:?xt=1"), ("<a href='y'>y</a>", None)])
stated("last_segment", text.last_segment, [("http://x/y/topic-12?p=3#a", "topic-12"), ("t", "t"), ("a/", "")])
stated("clean_page", pages.clean_page, [
    ("<p>a</p> <script>x</script>\n<p>b</p><!-- c --><div class='x hide-for-print y'>d</div>", "<p>a</p><p>b</p>"), ("plain", "plain"), (None, None),
])
stated("nested_page", lambda x: pages.clean_page(x, ("menu", "gone")), [
    ("<div class='hide-for-print'>a<div>b</div>c</div><p>d</p>", "<p>d</p>"), ("<div id=menu><div>x</div><ul><li>1<li>2</ul></div> <b>y</b><i id='menu'>z</i>", "<b>y</b><i id='menu'>z</i>"),
    ("<table><tr><td class='x hide-for-print'>a<td>b</table>", "<table><tr><td>b</table>"), ("<div>open <span class=\"hide-for-print\">never <b>shut", "<div>open "), ("  <p>a</p>\n</div> <p>b</p> ", "<p>a</p></div><p>b</p>"), ("a <!-- x", "a "), ("", ""), (None, None),
])
stated("nested_elements", lambda x: pages.elements(x, "div", "class", "post"), [
    ("<div class='post'>a<div>b</div>c</div>", ["a<div>b</div>c"]), ("<div class=post>1<div class='post'>2</div></div>", ["1<div class='post'>2</div>", "2"]), ("<td><div class='post'>x</td><div class='post'>y</div>", ["x", "y"]),
    ("<div class='post'><script>'</div>'</script>z</div>", ["<script>'</div>'</script>z"]), ("<div class='post x'>n</div><div title='a>b' class='post'>q<br/>r</div>", ["q<br/>r"]), ("<div class='post'>never shut", ["never shut"]), (None, None),
], "json")
stated("elements_by_word_and_prefix", lambda x: F.concat(pages.elements(x, "div", "class", "main", "word"), pages.elements(x, "div", "id", "news-id-", "prefix"), pages.elements(x, "li")), [
    ("<div class='a main b'>1</div><div class='mainly'>2</div><div id='news-id-77'>3</div><ul><li>x<ul><li>y</ul><li>z</ul>", ["1", "3", "x<ul><li>y</ul>", "y", "z"]),
], "json")
stated("key_values", text.key_value, [
    ("-Key: v ", {"key": "key", "value": " v "}), ("..-\n Genre:x", {"key": "genre", "value": "x"}), ("a;b:c:d", {"key": "b", "value": "c:d"}), (";b:c", {"key": ";b", "value": "c"}), (":x", None), ("x:", None), ("--:x", None), ("plain", None), (None, None),
], "json")
stated("select_elements", lambda x: pages.elements(x, "div", "class", "post"), [("<div class='post'>a <b>b</b></div><div class=\"post\">c</div><div id='post'>d</div>", ["a <b>b</b>", "c"]), ("", [])], "json")
stated("compose_author", text.compose_author, [("a", "Кинг", "Стивен", "Кинг, Стивен"), ("", "Кинг", "", "Кинг"), (None, None, "Стивен", "Стивен"), ("a", "Кинг", None, "a")])
stated("canonical_name", records.canonical_name, [("Кинг", "Стивен", "Кинг, Стивен"), ("Кинг", "", "Кинг"), ("Кинг", None, "Кинг")])
stated("recency_rules", lambda u, c: relational.recency(u.cast("timestamp_ntz"), c.cast("timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz")), [
    ("2024-01-02 12:00:00", "2024-01-31 12:00:01", "today"), ("2024-01-02 11:59:59", "2024-02-01 00:00:00", "stale"), ("2024-02-01 00:00:00", "2024-01-31 12:00:00", "week"), ("2024-02-01 00:00:00", "2024-01-25 12:00:00", "older"),
])
stated("rounded_times", lambda x: F.date_format(records.rounded_time(x.cast("timestamp"), 900), "yyyy-MM-dd HH:mm:ss"), [("2024-01-01 10:07:29", "2024-01-01 10:00:00"), ("2024-01-01 10:07:30", "2024-01-01 10:15:00")])


@pytest.mark.parametrize("name", sorted(STATED))
def test_stated(spark, name):
    f, cases, kind = STATED[name]
    width = len(cases[0]) - 1
    schema = ", ".join(["k int", *(f"a{i} {'string' if all(c[i] is None or isinstance(c[i], str) for c in cases) else 'long'}" for i in range(width))])
    made = f(*(F.col(f"a{i}") for i in range(width)))
    rows = spark.createDataFrame([(k, *c[:-1]) for k, c in enumerate(cases)], schema).select("k", (F.to_json(made) if kind == "json" else made.cast(kind)).alias("x")).orderBy("k").collect()
    assert [json.loads(r.x) if kind == "json" and r.x is not None else r.x for r in rows] == [c[-1] for c in cases]
