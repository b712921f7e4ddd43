import random

import pytest

from newsweave.functions import names as N
from newsweave.functions.porter2 import stem

PAIRS = [
    ("Project Kuiper", "Projekt Kuiper", "PRODUCT", True), ("Blue Origin", "BlueOrigin", "ORGANIZATION", True), ("Jeff Bezos", "Jeffrey Bezos", "PERSON", True), ("Amazon", "Amazon.com", "ORGANIZATION", True),
    ("Blue Origin", "SpaceX", "ORGANIZATION", False), ("Jeff Bezos", "Elon Musk", "PERSON", False), ("SpaceX's Starlinks", "Starlink", "PRODUCT", True), ("McDonald's", "McDonalds", "ORGANIZATION", True),
    ("iPhone", "Apple iPhone 15", "PRODUCT", True), ("NASA", "NASA Goddard Space Flight Center", "ORGANIZATION", True), ("John", "John Doe Smith", "PERSON", False), ("New York", "New York City", "LOCATION", False),
    ("App", "Apple", "ORGANIZATION", False), ("Space", "SpaceX", "ORGANIZATION", False), ("Rockets", "Rocket", "PRODUCT", True), ("Satellites", "Satellite", "PRODUCT", True), ("Americans", "American", "PERSON", False),
    ("Microsoft 356", "Microsoft 365", "PRODUCT", True), ("MagSafe Chargr", "MagSafe Charger", "PRODUCT", True), ("Elon Muskk", "Elon Musk", "PERSON", True), ("Microsoft Windows", "Microsoft Office", "PRODUCT", False), ("Joe Biden", "Joe Smith", "PERSON", False),
]


@pytest.mark.parametrize(("a", "b", "kind", "expected"), PAIRS)
def test_pairs(a, b, kind, expected):
    assert N.names_match(a, b, kind) is expected


def test_basic_forms():
    assert N.basic_form("Blue-Origin") == "blue origin"
    assert N.basic_form(" BLUE  ORIGIN ") == "blue origin"
    assert N.basic_form("SpaceX's Starlinks") == "spacex starlinks"
    assert N.basic_form("James' Book") == "james book"
    assert N.basic_form("María") == "maria" and N.basic_form("María", strip_marks=False) == "mari a"


def test_stems():
    got = [stem(w) for w in "caresses ponies ties relational generously hopping hoping happily nationalization adjustable".split()]
    assert got == "caress poni tie relat generous hop hope happili nation adjust".split()


def test_blocked_join_finds_all_matches(spark):
    from newsweave.operators.matching import name_matches

    rows = sorted({(n, k) for a, b, k, _ in PAIRS for n in (a, b)})
    names = spark.createDataFrame(rows, "name string, type string")
    got = {tuple(r) for r in name_matches(names, names).collect()}
    pair = {"PRODUCT", "ORGANIZATION"}
    want = {(a, s, b, t) for a, s in rows for b, t in rows if (s == t or {s, t} <= pair) and N.names_match(a, b, s)}
    assert got <= want
    assert all(max(len(w[0]), len(w[2])) <= 4 for w in want - got)  # tiny names, where the edit limit allows almost anything


def test_join_finds_all_matches_by_edit_distance(spark):
    from newsweave.operators.matching import name_matches

    rng = random.Random(5)
    letters = "abcdefghijklmnoprstuv"
    rows = {("hansen", "PERSON"), ("henson", "PERSON"), ("marten", "PERSON"), ("morton", "PERSON")}
    for _ in range(60):
        word = [rng.choice(letters) for _ in range(rng.randrange(3, 14))]
        kind = rng.choice(["PERSON", "LOCATION", "PRODUCT", "ORGANIZATION"])
        rows.add(("".join(word), kind))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(word))
            word[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        rows.add(("".join(word) or "x", kind))
    rows = sorted(rows)
    names = spark.createDataFrame(rows, "name string, type string")
    got = {tuple(r) for r in name_matches(names, names).collect()}
    pair = {"PRODUCT", "ORGANIZATION"}
    every = [(a, s, b, t) for a, s in rows for b, t in rows if s == t or {s, t} <= pair]
    want = {w for w in every if N.names_match(w[0], w[2], w[1])}
    by_edits = {w for w in want if N._close_spelling(N.normal_form(w[0], w[1]), N.normal_form(w[2], w[3]), w[1])}
    assert ("hansen", "PERSON", "henson", "PERSON") in got and len(by_edits) > len(rows)
    assert got <= want and by_edits <= got
    print("links", len(want), "found", len(got))
