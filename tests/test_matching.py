"""Resolution and canonicalisation on small planted tables."""

from marram import queries
from marram.operators import matching


def test_co_author_behind_namesakes(spark):
    """Five namesakes fit the first person; the second person's book is still found."""
    authors = [(k, "smith", "john") for k in range(1, 6)] + [(9, "brown", "anna")]
    authors = spark.createDataFrame(authors, "author_id long, surname string, given string")
    books = spark.createDataFrame([(9, 90, "harbour lights")], "author_id long, book_id long, title string")
    records = spark.createDataFrame([(1, "Smith, John; Brown, Ann", "Harbour Lights")], "key long, author string, title string")
    ranked = matching.rank_authors(records, authors).orderBy("place").collect()
    assert [(r["author_id"], r["place"]) for r in ranked] == [(1, 1), (9, 2)]
    assert matching.resolve(records, authors, books).first()["book_ref"] == 90


def test_all_parts_of_the_least_priority(spark, small):
    entries = [("pro", 1), ("mo", 1), ("eco", 1), ("no", 2), ("all", 2), ("stand", 2), ("dard", None), ("med", None), ("ium", None)]
    types = {r["p_partkey"]: r["p_type"] for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    want = {}
    for key, value in types.items():
        held = [(99 if p is None else p, f"part {w}") for w, p in entries if w in value.lower()]
        want[key] = sorted({value} | {c for p, c in held if p == min(held)[0]}) if held else None
    got = {r["p_partkey"]: r["canonicals"] for r in queries.QUERIES["genre_parts"](spark, small).collect()}
    assert got == want and any(x and len(x) > 2 for x in want.values())


def test_distance_goes_before_parts(spark):
    words = spark.createDataFrame([("novelx",), ("dark novel of love",), ("xyzzy",), (None,)], "g string")
    dictionary = spark.createDataFrame([(0, "novel", "Novel", False, None), (1, "novel", "Novel", True, 5), (2, "love", "Romance", True, 5), (3, "dark", "Horror", True, 7)], "ord int, variant string, canonical string, part boolean, priority int")
    got = {r["g"]: r["canonical"] for r in matching.canonicalise(words, dictionary, "g").collect()}
    assert got == {"novelx": "Novel", "dark novel of love": "Novel, Romance, dark novel of love", "xyzzy": None, None: None}
