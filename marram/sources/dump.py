"""Reading INSERT statements of database dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.session import materialize

#: Escapes within quoted strings.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def parse_values(line: str | None) -> list[list[str | None]]:
    """Tuples of a VALUES list: quoted strings with backslashes and doubled quotes, NULL, bare literals."""
    rows: list[list[str | None]] = []
    at, n = 0, len(line or "")
    while line and (at := line.find("(", at)) >= 0:
        row: list[str | None] = []
        at += 1
        while at < n and line[at] != ")":
            if line[at] in ", ":
                at += 1
            elif line[at] == "'":
                at, out = at + 1, []
                while at < n:
                    if line[at] == "\\" and at + 1 < n:
                        out.append(ESCAPES.get(line[at + 1], line[at + 1]))
                        at += 2
                    elif line[at] == "'" and line[at + 1 : at + 2] == "'":
                        out.append("'")
                        at += 2
                    elif line[at] == "'":
                        break
                    else:
                        out.append(line[at])
                        at += 1
                row.append("".join(out))
                at += 1
            else:
                end = at
                while end < n and line[end] not in ",)":
                    end += 1
                word = line[at:end].strip()
                row.append(None if word.upper() == "NULL" else word)
                at = end
        rows.append(row)
        at += 1
    return rows


#: Whether a reader stands between statements or within one.
IDLE, HELD = 0, 1


def runs_of_splits(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple]:
    """(file, block, other columns, lines) of the batches (value, file, block, ...), which hold a split's lines one after the other; a split may come in several parts."""
    for batch in batches:
        lines, places = batch.column(0).to_pylist(), list(zip(*(batch.column(k).to_pylist() for k in range(1, 3 + extra)), strict=True))
        start = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or places[k] != places[start]:
                yield (*places[start], lines[start:k])
                start = k


def ends_statement(line: str) -> bool:
    return line.rstrip(" \t\r\n").endswith(";")


def split_states(lines: DataFrame, prefix: str) -> DataFrame:
    """``(file, block, state)``: whether each split of the files begins within a statement.

    A statement may reach over splits, so each tells how it would be left if it
    were entered in either state; taken one after the other by file, these give
    the states that they are entered in. A row for each split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[tuple, list[int]] = {}
        for file, block, own in runs_of_splits(batches):
            states = left.setdefault((file, block), [IDLE, HELD])
            for line in own:
                begins, ends = line.startswith(prefix), ends_statement(line)
                for k, state in enumerate(states):
                    states[k] = HELD if (state == HELD or begins) and not ends else IDLE
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in left], pa.string()), pa.array([x[1] for x in left], pa.int64()), *(pa.array([x[k] for x in left.values()], pa.int32()) for k in (0, 1))], ["file", "block", "idle", "held"])

    told = lines.mapInArrow(run, "file string, block long, idle int, held int")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A split is left as it is entered, or in one state whatever it was; never the other way round, as only a semicolon ends a statement.
    return told.select("file", "block", F.coalesce(F.last(F.when(F.col("idle") == F.col("held"), F.col("idle")), ignorenulls=True).over(before), F.lit(IDLE)).alias("state"))


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``(r, file, pos)``: each tuple of the table's INSERT statements as strings.

    A statement begins at a line that begins with INSERT INTO `table` VALUES and
    ends with a line whose last character, blanks apart, is a semicolon. Spark
    reads the files in splits, a compressed one in one; what a split holds of a
    statement that begins or ends in another is brought together by statement.
    """
    prefix = f"INSERT INTO `{table}` VALUES "
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    states = F.broadcast(split_states(lines, prefix))  # a row for each split
    entered = lines.join(states, ["file", "block"]).select("value", "file", "block", "state")
    kinds = {"r": pa.list_(pa.string()), "file": pa.string(), "block": pa.int64(), "at": pa.int64(), "k": pa.int32(), "part": pa.string(), "opens": pa.bool_()}

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at, held, lead = None, 0, None, None
        for file, block, state, own in runs_of_splits(batches, 1):
            found: list[tuple] = []
            if split != (file, block):
                found += unfinished(split, at, held, lead)
                split, at, held, lead = (file, block), 0, None, [] if state == HELD else None
            for line in own:
                at += 1
                if lead is not None:  # of a statement that began in a split before
                    lead.append(line)
                    if ends_statement(line):
                        found.append((None, file, block, 0, 0, "\n".join(lead), False))
                        lead = None
                elif held is not None or line.startswith(prefix):
                    held = [at] if held is None else held  # the place, then the lines
                    held.append(line)
                    if ends_statement(line):
                        found += [(r, file, block, held[0], k, None, None) for k, r in enumerate(parse_values("\n".join(held[1:])[len(prefix) :]))]
                        held = None
            yield made(found)
        yield made(unfinished(split, at, held, lead))

    def unfinished(split, at: int, held: list | None, lead: list | None) -> list[tuple]:
        if held is not None:
            return [(None, *split, held[0], 0, "\n".join(held[1:]), True)]
        return [(None, *split, 0, 0, "\n".join(lead), False)] if lead else []

    found = materialize(entered.mapInArrow(run, "r array<string>, file string, block long, at long, k int, part string, opens boolean"), "tuples")
    parts = found.filter("part IS NOT NULL").withColumn("owner", F.last(F.when(F.col("opens"), F.struct("block", "at")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "at")))
    whole = parts.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "part"))), lambda x: x["part"]), "\n").alias("text"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, file, block, at, k, None, None) for text, file, block, at in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True) for k, r in enumerate(parse_values(text[len(prefix) :]))]
            yield made(rows)

    split_rows = whole.select("text", "file", F.col("owner.block").alias("block"), F.col("owner.at").alias("at")).mapInArrow(joined, found.schema)
    return found.filter("part IS NULL").unionByName(split_rows).select("r", "file", F.struct("block", "at", "k").alias("pos"))


def lenient_int(row: Column, place: int) -> Column:
    """A number, 0 for anything else."""
    return F.coalesce(F.get(row, F.lit(place)).try_cast("bigint"), F.lit(0))


def text_or_empty(row: Column, place: int) -> Column:
    return F.coalesce(F.get(row, F.lit(place)), F.lit(""))


def text_or_null(row: Column, place: int) -> Column:
    return F.nullif(F.get(row, F.lit(place)), F.lit(""))


#: Tables of the dump with their columns as (name, kind, place) and keys; kind is a number, text or nullable text.
TABLES = {
    "libbook": ("book", [("book_id", "n", 0), ("title", "t", 3), ("title_alt", "o", 4), ("lang", "o", 5), ("year", "n", 10), ("file_type", "o", 8), ("file_size", "n", 1), ("deleted", "flag", 11)], ["book_id"]),
    "libavtorname": ("author", [("author_id", "n", 0), ("first_name", "o", 1), ("middle_name", "o", 2), ("last_name", "o", 3), ("nick_name", "o", 4), ("gender", "o", 8)], ["author_id"]),
    "libavtor": ("book_author", [("book_id", "n", 0), ("author_id", "n", 1), ("pos", "n", 2)], ["book_id", "author_id"]),
    "libgenrelist": ("genre", [("genre_id", "n", 0), ("code", "t", 1), ("descr", "o", 2), ("meta", "o", 3)], ["genre_id"]),
    "libgenre": ("book_genre", [("book_id", "n", 1), ("genre_id", "n", 2)], ["book_id", "genre_id"]),
    "libseqname": ("sequence", [("seq_id", "n", 0), ("name", "t", 1)], ["seq_id"]),
    "libseq": ("book_sequence", [("book_id", "n", 0), ("seq_id", "n", 1), ("seq_num", "n", 2)], ["book_id", "seq_id"]),
    "libjoinedbooks": ("joined_book", [("bad_id", "n", 2), ("good_id", "n", 3)], ["bad_id"]),
    "librate": ("book_rating", [("book_id", "n", 1), ("rate", "o", 3)], []),
    "libbannotations": ("book_annotation", [("book_id", "n", 0), ("nid", "n", 1), ("title", "o", 2), ("body", "o", 3)], []),
    "libaannotations": ("author_annotation", [("author_id", "n", 0), ("nid", "n", 1), ("title", "o", 2), ("body", "o", 3)], []),
}
RATINGS = "librate"
SOURCE = "SQL dump"


def typed_rows(rows: DataFrame, table: str) -> DataFrame:
    """The rows of ``read_dump`` with the table's columns: of equal keys the first row, all rows of tables without keys.

    Ratings become a row for each book with its votes and their mean: whole
    numbers from 1 to 5, of rows with all columns.
    """
    _, columns, keys = TABLES[table]
    r = F.col("r")
    kinds = {"n": lenient_int, "t": text_or_empty, "o": text_or_null, "flag": lambda x, k: F.coalesce(F.get(x, F.lit(k)) == "1", F.lit(False)).cast("int")}
    out = rows.select(*(kinds[kind](r, place).alias(name) for name, kind, place in columns), F.struct("file", "pos").alias("__place"))
    if table == RATINGS:
        rate = F.col("rate").try_cast("int")
        return out.filter(rate.between(1, 5)).groupBy("book_id").agg(F.count("*").cast("int").alias("votes"), (F.sum(rate) / F.count("*")).alias("avg_rate"))
    names = [name for name, _, _ in columns]
    if not keys:
        return out.select(*names)
    first = out.groupBy(*keys).agg(F.min_by(F.struct(*names), "__place").alias("x"))
    return first.select(*(F.col(f"x.{name}").alias(name) for name in names))


def import_dump(spark: SparkSession, paths: dict[str, str], target: str, now: Column) -> DataFrame:
    """Write every table of ``paths`` (dump table to path) anew below ``target``, and what was imported as ``import_meta``, which is returned.

    import_meta is (key, value): the source, the time, and ``rows_`` and the
    table's name with the rows read, of ratings the books rated; 0 for tables
    without a path.
    """
    counts = []
    for table, (name, _, _) in TABLES.items():
        read = 0
        if table in paths:
            rows = read_dump(spark, paths[table], table)
            typed_rows(rows, table).write.mode("overwrite").parquet(f"{target}/{name}")
            read = spark.read.parquet(f"{target}/{name}").count() if table == RATINGS else rows.count()
        counts.append((f"rows_{name}", str(read)))
    meta = spark.createDataFrame([("source", SOURCE), *counts], "key string, value string")
    meta = meta.unionByName(spark.range(1).select(F.lit("imported_utc").alias("key"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("value")))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{target}/import_meta")
    return spark.read.parquet(f"{target}/import_meta")


def dump_line(table: str, values: list[Column]) -> Column:
    """One INSERT statement of one row: text quoted with quotes, backslashes and line feeds escaped, numbers bare, null as NULL."""
    quoted = [F.coalesce(F.concat(F.lit("'"), F.replace(F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'")), F.lit("NULL")) for v in values]
    return F.concat(F.lit(f"INSERT INTO `{table}` VALUES ("), F.concat_ws(",", *quoted), F.lit(");"))
