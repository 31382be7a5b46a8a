import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldmill.functions import jsonfix, text, values
from fieldmill.functions.similarity import choose_key, likeness, plain_key, plain_string
from fieldmill.operators import scoring

NUMBERS = [("5 944,05", 5944.05), ("1.234,56 €", 1234.56), ("$1,234.56", 1234.56), ("1,234", 1234.0), ("12,5", 12.5), ("1.234", 1.234), ("abc", None), ("", None), ("x12.5y", 12.5), ("-3,2", -3.2), ("1 000", 1000.0), ("12d", 12.0), ("1,2,3", 123.0), ("1_000", 1000.0), ("１２,５", 12.5), ("٣", 3.0), ("12\u202f000", 12.0)]
DATES = [("03/01/2025", (3, 1, 2025)), ("3-1-25", (3, 1, 2025)), ("15.05.99 noon", (15, 5, 1999)), ("03/01/1800", (3, 1, 2018)), ("31/02/2024", (31, 2, 2024)), ("45/01/2024", None), ("2024-01-03", None), (None, None), ("1/2/202", (1, 2, 2020)), ("1/2/9", None), ("０３/01/2025", (3, 1, 2025))]
PAIRS = [
    ("03/01/2025", "3-1-25", True, "date"), ("5944.05", "5 944,05", True, "numeric"), ("778451", "778452", True, "numeric"), ("15.05.2024", "15.05.1999", True, "numeric"), ("ACME", " ACME ", True, "exact"),
    ("Société", "societe", True, "normalized"), ("", None, True, "normalized"), ("null", "x", False, "mismatch"), ("NULL", "", False, "mismatch"), ("ORDER SUPPLIES SARL", "Acme Fashion", False, "mismatch"),
]


@pytest.mark.parametrize("given,want", NUMBERS)
def test_number(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(values.extract_number(F.col("t"))).first()[0]
    assert got == want


@pytest.mark.parametrize("given,want", DATES)
def test_date(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(values.parse_date(F.col("t"))).first()[0]
    assert (tuple(got) if got else None) == want


def compared(spark, pairs):
    """Verdicts on pairs of JSON values, as a record's fields."""
    import json

    rows = [(i, json.dumps({"x": a}), json.dumps({"x": b})) for i, (a, b) in enumerate(pairs)]
    got = scoring.field_verdicts(spark.createDataFrame(rows, "id int, gt string, pred string"), ["id"]).orderBy("id").collect()
    return [(r.matched, r.match_type) for r in got]


def test_cascade(spark):
    df = spark.createDataFrame([p[:2] for p in PAIRS], "a string, b string").select(values.compare_texts(F.col("a"), F.col("b")).alias("v"))
    assert [(r.v.matched, r.v.match_type) for r in df.collect()] == [p[2:] for p in PAIRS] == compared(spark, [p[:2] for p in PAIRS])


def test_nested_and_typed_values(spark):
    pairs = [(True, "1"), ([1, "a"], [1.0, "A"]), ([1], [1, 2]), ({"a": {"b": 1}}, {"A": {"B": 1}}), ("ORDER SUPPLIES SARL", "ORDER SUPLIES SARL"), (1, 2), (1.0, 1), ([], []), ([], None), ({}, {"a": 1}), ({"a": None}, {}), ({"a": 1}, [1]), ("[1]", [1]), (10**400, 10**400), ("true", True)]
    want = [(True, "numeric"), (True, "exact"), (False, "mismatch"), (True, "exact"), (True, "fuzzy"), (False, "mismatch"), (True, "numeric"), (True, "exact"), (False, "mismatch"), (True, "exact"), (True, "exact"), (False, "mismatch"), (False, "mismatch"), (True, "numeric"), (False, "mismatch")]
    assert compared(spark, pairs) == want
    assert choose_key("total_ht", ["total_ttc"]) == "total_ttc"
    assert plain_key("modéle vehicule") == plain_key("modèle_vehicule") == "modelevehicule"
    assert likeness("tide", "diet") == 0.25 and likeness("diet", "tide") == 0.5


def test_other_scripts_do_not_match(spark):
    pairs = [("１２x", "３４x"), ("ﬁn", "n"), ("Nguyễn", "Nguyn"), ("Nguyễn", "Nguyen"), ("ﬁn", "fin"), ("１２", "12"), ("Société", "SOCIETE"), ("漢字", "かな")]
    want = [(False, "mismatch")] * 3 + [(True, "normalized"), (True, "normalized"), (True, "numeric"), (True, "normalized"), (True, "normalized")]  # the last: both vanish
    assert compared(spark, pairs) == want
    native = spark.createDataFrame(pairs, "a string, b string").select(values.compare_texts(F.col("a"), F.col("b")).alias("v")).collect()
    assert [(r.v.matched, r.v.match_type) for r in native] == want


def test_normal_forms_on_random_text(spark):
    rng = random.Random(5)
    pools = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x300, 0x370), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F), [0x130, 0x131, 0x1E9E, 0x212A, 0x3A3, 0x2126, 0xA0, 0x85, 0x1C, 0x2003, 0x09, 0x0A], range(0x4E00, 0x4E10), range(0x660, 0x66A)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts = [t for t in texts if unicodedata.normalize("NFC", t).lower() is not None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_string(F.col("t")).alias("s"), text.normalize_key(F.col("t")).alias("k")).collect()
    assert [(r.s, r.k) for r in got] == [(plain_string(r.t), plain_key(r.t)) for r in got]


# Broken objects and what repair makes of them.
REPAIRS = [
    ('{"sender":"ACME","total":12.5', '{"sender":"ACME","total":12.5}'), ('{"a": [1, 2, ], }', '{"a": [1, 2]}'), ('{"a": "x', '{"a": "x"}'), ('{"a":{"b":[1', '{"a":{"b":[1]}}'), ('{"a": 1]', '{"a": 1}'), ("", ""), ("nothing", "nothing"),
    ('{"a": "\\""', '{"a": "\\""}'), ('{"a": [1]]', '{"a": [1]}'), ('{"a":[{"b":1', '{"a":[{"b":1]}}'),
]


@pytest.mark.parametrize("given,want", REPAIRS)
def test_repair(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(jsonfix.repair(F.col("t"))).first()[0] == want


OUTPUTS = [('x {"a": 1} y', '{"a": 1}'), ("```json\n{\"a\": 1}\n```", '{"a": 1}'), ('<think>{"b": 2}</think> {"a": 1}', '{"a": 1}'), ("none", "none"), (None, ""), ('{"a": {"b": 1}', '{"a": {"b": 1}'), (" { } ", "{ }"), ("a } b { c", "a } b { c"), ("</think>\u2003{}", "{}")]


@pytest.mark.parametrize("given,want", OUTPUTS)
def test_candidate(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(text.json_candidate(F.col("t"))).first()[0] == want


def test_parse_is_strict(spark):
    rows = [("{'a': 1}",), ('{"a": 1, "a": 2}',), ('{"a": NaN}',), ("[1]",), ('{"sender":"ACME","total":12.5',)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(jsonfix.parse_output(F.col("t")).alias("p")).collect()]
    assert [g.error is None for g in got] == [False, True, True, False, True]
    assert [f.text for f in got[1].fields] == ["2"] and got[4].used_repair


def test_text_functions(spark):
    df = spark.createDataFrame([("a\nb" * 10, '{"category": null}'), ("x", "{}"), ("y", "bad")], "t string, o string")
    got = df.select(text.truncated(F.col("t"), 10).alias("t"), text.category_of(F.col("o")).alias("c")).collect()
    assert [r.t for r in got] == ["a\\nba\\n...", "x", "y"]
    assert [r.c for r in got] == [None, "autre", "autre"]
