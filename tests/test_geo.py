import pytest
from pyspark.sql import functions as F

from beatwire.dims import Place, gazetteer, gazetteer_table
from beatwire.operators import names as names_module
from beatwire.operators.geo import extract_location, geocode_articles, geocode_lookup
from beatwire.operators.names import find_names
from beatwire.operators.select import map_points

PLACES = gazetteer()


def test_gazetteer():
    assert len(PLACES) == len({p.name for p in PLACES}) == 126
    assert len({(p.lat, p.lon) for p in PLACES}) == 93


def test_rules(value):
    """Longest wins, then rank; a name is a word of its own, in any case."""
    by_length = sorted(PLACES, key=lambda p: (len(p.name), p.rank))
    short, long = by_length[0].name, by_length[-1].name
    equal = [p for p in PLACES if len(p.name) == 5 and p.name.isascii()]
    first, second = equal[0].name, equal[1].name
    inside = next((p.name, q.name) for p in PLACES for q in PLACES if f" {q.name}" in p.name)
    cases = {
        f"{short}, {long}": long, f"{long}, {short}": long,
        f"{second} or {first}": first, f"{first} or {second}": first,
        f"News of {inside[0].title()}.": inside[0], f"News of {inside[1].upper()}!": inside[1],
        f"{first}s {second}_x 1{short}": None, "no place at all": None, "": None, None: None,
    }
    assert value(lambda c: extract_location(c, PLACES), *cases) == list(cases.values())


def test_every_name_alone_and_glued(value):
    """parity against the definition of a boundary, character by character."""
    def is_word(ch):
        return ch.isalnum() or ch == "_"

    def found(name, text):
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            left = (at > 0 and is_word(text[at - 1])) != is_word(text[at])
            right = (end < len(text) and is_word(text[end])) != is_word(text[end - 1])
            if left and right:
                return True
            at = text.find(name, at + 1)
        return False

    texts = [t for p in PLACES for t in (p.name, f"x {p.name} y", f"{p.name}ನ", f"ನ{p.name}")]
    best = sorted(PLACES, key=lambda p: (-len(p.name), p.rank))
    want = [next((p.name for p in best if found(p.name, t)), None) for t in texts]
    assert value(lambda c: extract_location(c, PLACES), *texts) == want


def test_modes(value):
    texts = ["ಬೆಂಗಳೂರು ನಗರ", "ಹಾಸನ ನಗರ"]
    assert value(lambda c: extract_location(c, PLACES), *texts) == [None, "ಹಾಸನ"]
    assert value(lambda c: extract_location(c, PLACES, "unicode"), *texts) == ["ಬೆಂಗಳೂರು", "ಹಾಸನ"]
    with pytest.raises(ValueError):
        extract_location(F.lit("x"), PLACES, "other")


def test_overlapping_names(value):
    places = [Place("new york", 1.0, 1.0, 0), Place("york city hall", 2.0, 2.0, 1)]
    assert value(lambda c: extract_location(c, places), "in New York City Hall") == [
        "york city hall"]


def test_geocode(spark):
    df = spark.createDataFrame(
        [(1, "Fire in Pune", "from Thiruvananthapuram"), (2, "Fire", "in Kota"),
         (3, None, None)], "id int, title string, text string")
    got = {r.id: (r.location, r.lat, r.lon) for r in geocode_articles(df, PLACES).collect()}
    assert got == {1: ("pune", 18.5204, 73.8567), 2: ("kota", 25.2138, 75.8648),
                   3: (None, None, None)}


def test_lookup_and_map(spark):
    names = spark.createDataFrame(
        [("t", "s", "NAVI Mumbai"), ("t", "s", "nowhere"), ("t", "s", None)],
        "title string, source string, location string")
    placed = geocode_lookup(names, gazetteer_table(spark))
    assert placed.count() == 3
    assert [(r.lat, r.lon) for r in map_points(placed).collect()] == [(19.033, 73.0297)]
    assert map_points(placed, center=True).count() == 1
    empty = map_points(placed.where("location = 'nowhere'"), center=True).collect()
    assert [(r.lat, r.lon, r.title) for r in empty] == [(20.5937, 78.9629, None)]


def _both(spark, texts, places, mode):
    """The answers of the pattern and of the join, in the order of the texts."""
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    names = spark.createDataFrame([(p.name, p.rank, p.lat) for p in places],
                                  "name string, rank int, lat double")
    one = df.select("id", extract_location(F.col("text"), places, mode).alias("name"))
    two = find_names(df, "id", ["text"], names, mode).select("id", "name")
    return [[r.name for r in d.orderBy("id").collect()] for d in (one, two)]


@pytest.mark.parametrize("mode", ["parity", "unicode"])
def test_names_as_rows_equal_the_pattern(spark, mode):
    texts = [t for p in PLACES for t in (p.name, f"x {p.name.upper()} y", f"{p.name}ನ", f"ನ{p.name}",
                                         f"{p.name}-{PLACES[0].name}", f"{p.name}  ", f"_{p.name}")]
    texts += ["", None, "Navi  Mumbai", "navi mumbai mumbai", "pimpri-chinchwad.pune", "a\nDelhi\tb"]
    one, two = _both(spark, texts, PLACES, mode)
    assert one == two and len({n for n in two if n}) > 100


def test_names_as_rows_overlap_and_shuffle(spark, monkeypatch):
    places = [Place("new york", 1.0, 1.0, 0), Place("york city hall", 2.0, 2.0, 1),
              Place("hall", 3.0, 3.0, 2), Place("k2", 4.0, 4.0, 3)]
    texts = ["in New York City Hall", "New York", "new  york k2", "hall K2", "k22", None, "the new"]
    want = ["york city hall", "new york", "k2", "hall", None, None, None]
    for few in (names_module.BROADCAST_NAMES, 2, 0):
        monkeypatch.setattr(names_module, "BROADCAST_NAMES", few)
        assert _both(spark, texts, places, "parity") == [want, want]


def test_names_of_several_columns_and_doubles(spark):
    names = spark.createDataFrame([("Elm", 2, "b"), ("elm", 1, "a"), ("oak tree", 1, "c"), (None, 0, "x"),
                                   ("#tag", 0, "y")], "name string, rank int, info string")
    rows = spark.createDataFrame([(1, "an elm", "an oak tree"), (2, "", "oak Tree elm"), (None, None, "ELM"),
                                  (4, "#tag", None)], "id int, title string, text string")
    got = find_names(rows, "id", ["title", "text"], names)
    assert got.columns == ["id", "title", "text", "name", "info"]
    assert {r.id: (r.name, r.info) for r in got.collect()} == {
        1: ("elm", "a"), 2: ("oak tree", "c"), None: ("elm", "a"), 4: (None, None)}
    none = find_names(rows, "id", ["title", "text"], names.limit(0))
    assert [r.info for r in none.collect()] == [None] * 4
