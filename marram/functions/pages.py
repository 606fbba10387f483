"""Record pages: cleaning, key and value rows, and their columns, as native expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import markup
from .fuzzy import bind
from .parse import size_bytes
from .text import key_value, trim_to_length

#: Characters trimmed around values, and before people's names.
EDGES, NAME_EDGES = ",. »«\"", "©…— ๖ۣۜ"
#: Keys of a page by the column that they fill.
SYNONYMS = {
    "author": ("автор", "авторы", "фамилия, имя автора", "фамилии авторов", "авторы произведений"),
    "author_surname": ("фамилия автора",),
    "author_name": ("имя автора",),
    "publisher": ("издательство",),
    "reader": ("исполнитель", "исполнители", "запись и обработка"),
    "genre": ("жанр",),
    "bitrate": ("битрейт", "битрейт аудио"),
    "length": (
        "длительность", "прдолжительность", "продолжительность", "продолжительность звучания", "продолжительность книги", "общее время звучания", "общее время воспроизведения",
        "bремя звучания", "время звучания", "время воспроизведения", "время чтения", "общая продолжительность", "продолжительность аудиокниги", "продолжительность (время звучания)",
        "время", "длина записи",
    ),
    "description": ("описание", "аннотация"),
}
#: The key whose value is a key and a value itself.
NESTED = "доп. информация"
#: The longest value of a column.
LENGTHS = {"author": 500, "author_surname": 250, "author_name": 250, "publisher": 500, "reader": 500, "genre": 200, "bitrate": 100, "length": 500, "description": 1000}


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def decode_entities(x: Column) -> Column:
    """HTML entities as characters; only values with an ampersand leave the JVM."""
    return F.when(F.contains(x, F.lit("&")), unescaped(x)).otherwise(x)


def insert_space(x: Column, sign: str, before: bool, after: bool) -> Column:
    """Blanks around a sign removed, then put back on the wanted sides."""
    bare = F.regexp_replace(x, rf" *\{sign} *", sign)
    return F.replace(bare, F.lit(sign), F.lit(" " * before + sign + " " * after))


def raised(x: Column) -> Column:
    """The first character in upper case."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))


def change_case(x: Column, mode: str, only_target: bool, trim: bool) -> Column:
    """Upper case for the first letter (``first``), of each word (``words``) or after each splitter (``splitter``).

    Unless ``only_target``, all else is lowered first. ``trim`` also strips the
    edges, merges blanks, turns bars and backslashes into slashes and square
    brackets into round ones, and puts blanks around signs. Null stays null.
    """
    x = x if only_target else F.lower(x)
    if trim:
        x = F.regexp_replace(F.trim(x, F.lit(EDGES)), " +", " ")
        x = F.translate(x, "|\\[]", "//()")
        for sign, before, after in ((",", False, True), ("/", True, True), (".", False, True), ("(", True, False), (")", False, True)):
            x = insert_space(x, sign, before, after)
        x = F.regexp_replace(x, "^ | $", "")
    if mode == "words":
        return F.array_join(F.transform(F.split(raised(x), " "), raised), " ")
    if mode == "splitter":
        # A part is a splitter's rest: its first non-blank character is raised.
        parts = F.regexp_extract_all(raised(x), F.lit(r"[.,/\\*|]* *[^.,/\\*|]*"), F.lit(0))
        up = F.transform(parts, lambda p: bind(F.length(F.regexp_extract(p, r"^[.,/\\*|]+ *", 0)), lambda n: F.concat(F.substring(p, F.lit(1), n), raised(F.substring(p, n + 1, F.length(p))))))
        return F.array_join(up, "")
    return raised(x)


def clean_value(x: Column, lines: bool, longest: int) -> Column:
    """The first line (or all, with ``lines``) without blanks and ``: - =`` around it, at most ``longest`` characters, entities decoded."""
    first = x if lines else F.when(x.isNotNull(), F.coalesce(F.get(F.filter(F.split(x, "\r\n"), lambda v: v != ""), F.lit(0)), F.lit("")))
    return decode_entities(trim_to_length(F.regexp_replace(first, r"^[\s:=-]+|[\s:=-]+$", ""), longest))


def clean_name(x: Column, longest: int) -> Column:
    """A person's name: a clean value with each word's first letter raised."""
    return change_case(F.ltrim(clean_value(x, False, longest), F.lit(NAME_EDGES)), "words", True, True)


def forum_title(x: Column) -> Column:
    """A topic's title up to the first square bracket, entities removed."""
    return F.trim(F.regexp_replace(F.substring_index(x, "[", 1), "&[a-zA-Z]+;|&#[0-9]+;", ""))


def clean_page(page: Column, ids: tuple[str, ...] = (), classes: tuple[str, ...] = ("hide-for-print",)) -> Column:
    """The page without scripts, comments, blank text, the first element of each id and all elements of the classes, with what is nested in them."""

    @F.pandas_udf(StringType())
    def cleaned(x: pd.Series) -> pd.Series:
        return x.map(lambda v: markup.without(v, ids, classes), na_action="ignore")

    return cleaned(page)


def elements(page: Column, tag: str, attribute: str | None = None, value: str | None = None, match: str = "equal") -> Column:
    """Inner HTML of the elements of this tag, nested ones too, whose attribute equals the value, begins with it (``prefix``) or has it as a word (``word``)."""

    @F.pandas_udf(ArrayType(StringType()))
    def found(x: pd.Series) -> pd.Series:
        return x.map(lambda v: markup.inner(v, tag, attribute, value, match), na_action="ignore")

    return found(page)


OUTLINE = "array<struct<tag:string,depth:int,id:string,class:string,start:int,inner_start:int,inner_end:int,end:int>>"


def outline(page: Column) -> Column:
    """All elements and comments of a page by start, with depth and the places where they and their content begin and end."""

    @F.pandas_udf(OUTLINE)
    def outlined(x: pd.Series) -> pd.Series:
        return x.map(described, na_action="ignore")

    return outlined(page)


def described(page: str) -> list[dict]:
    return [{"tag": n.tag, "depth": n.depth, "id": n.value("id"), "class": n.value("class"), "start": n.start, "inner_start": n.inner_start, "inner_end": n.inner_end, "end": n.end} for n in markup.nodes(page)]


def page_nodes(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, place, tag, depth, id_attribute, class_attribute, start, inner_start, inner_end, end)``: a row for each element and comment of each page."""
    found = df.select(F.col(id_col), F.posexplode(outline(F.col(html_col))).alias("place", "n"))
    return found.select(id_col, "place", "n.tag", "n.depth", F.col("n.id").alias("id_attribute"), F.col("n.class").alias("class_attribute"), "n.start", "n.inner_start", "n.inner_end", "n.end")


def row_text(fragment: Column) -> Column:
    """A fragment without comments and tags, all else as it stands."""
    return F.regexp_replace(fragment, r"(?s)<!--.*?-->|<[^>]*>", "")


def post_rows(body: Column) -> Column:
    """Texts of a post's rows: bold spans before a colon begin one, as line breaks and rules do."""
    marked = F.regexp_replace(body, r"(?is)<span class=\"post-b\">((?:(?!</span>).)*)</span>\s*:", "\u0001$1:")
    rows = F.filter(F.split(marked, "\u0001|<br>|<hr class=\"post-hr\">"), lambda r: r != "")
    return F.transform(rows, lambda r: F.ltrim(row_text(F.regexp_replace(r, r"(?is)^.*</var>", "")), F.lit("\n\"")))


def table_rows(body: Column) -> Column:
    """Texts of a table's rows after the first."""
    rows = F.filter(F.split(body, "<br>|<tr class='row1'>"), lambda r: r != "")
    return F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.regexp_replace(row_text(F.replace(F.replace(r, F.lit("&nbsp;"), F.lit("")), F.lit("\n"), F.lit(""))), r"^\s+|\s+$", ""))


def page_values(df: DataFrame, id_col: str, rows: Column, trimmed: bool = False) -> DataFrame:
    """``(id, key, value, first)`` of each row with a colon; of equal keys the last row's value, and the place of the first."""
    found = df.select(F.col(id_col), F.posexplode(rows).alias("pos", "row")).select(id_col, "pos", key_value(F.col("row")).alias("x")).filter("x IS NOT NULL")
    value = F.regexp_replace("x.value", r"^\s+|\s+$", "") if trimmed else F.col("x.value")
    return found.groupBy(id_col, F.col("x.key").alias("key")).agg(F.max_by(value, "pos").alias("value"), F.min("pos").alias("first"))


def record_columns(values: DataFrame, id_col: str) -> DataFrame:
    """One row for each id with the columns that its keys fill; a nested value's own key counts too.

    Of several keys for a column the one that begins last on the page counts.
    """
    inner = key_value(F.col("value"))
    both = values.withColumn("x", F.when(F.col("key") == NESTED, inner).otherwise(F.struct("key", "value"))).filter("x IS NOT NULL").select(id_col, "x.key", "x.value", "first")
    key = F.lower(F.trim(F.col("key"), F.lit(" []<>;\n\t.,\"(")))
    column = F.lit(None).cast("string")
    for name, keys in SYNONYMS.items():
        column = F.when(key.isin(*keys), name).otherwise(column)
    wide = both.withColumn("column", column).groupBy(id_col).agg(*(F.max_by("value", F.when(F.col("column") == name, F.col("first"))).alias(name) for name in SYNONYMS))

    def cleaned(name: str) -> Column:
        x, n = F.col(name), LENGTHS[name]
        if name in ("author", "author_surname", "author_name", "reader"):
            return clean_name(x, n)
        modes = {"publisher": ("first", True), "bitrate": ("first", True), "genre": ("splitter", False)}
        value = clean_value(x, name == "description", n)
        return change_case(value, *modes[name], True) if name in modes else value

    return wide.select(id_col, *(cleaned(name).alias(name) for name in SYNONYMS))


#: Fixed value: the key of a catalogue page's size.
SIZE_KEY = "общий размер"


def parsed_records(df: DataFrame, id_col: str, html_col: str, body: Column, rows: str = "post") -> DataFrame:
    """Whole pages as records: one row for each page that has a body, with the columns that its keys fill and, by ``table`` rows, its size.

    ``body`` picks the body's HTML, as ``elements`` gives it; ``post`` and
    ``table`` name how it is cut into rows.
    """
    bodies = df.select(F.col(id_col).alias("__id"), body.alias("body")).filter("body IS NOT NULL")
    values = page_values(bodies, "__id", {"post": post_rows, "table": table_rows}[rows](F.col("body")), rows == "table")
    keys = values.withColumn("key", F.rtrim(F.col("key"), F.lit(":")))
    sizes = values.filter(F.col("key") == SIZE_KEY).select("__id", size_bytes(F.col("value")).alias("size_bytes"))
    out = bodies.select("__id").join(record_columns(keys, "__id"), "__id", "left")
    out = out.join(sizes, "__id", "left") if rows == "table" else out
    return out.withColumnRenamed("__id", id_col)
