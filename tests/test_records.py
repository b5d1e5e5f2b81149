import json

import pytest
from pyspark.sql import functions as F

from treemend.functions import docs as D
from treemend.functions.arrays import parse_array, parse_array_strict
from treemend.functions.geo import resolve_location
from treemend.functions.values import normalize, normalize14, to_number
from treemend.model import Rule, lenient_json
from treemend.operators.row_rules import ROW_CHECKS, rule_filter
from treemend.operators.set_rules import uniq_key


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_to_number(spark):
    texts = ["1,000", "5f", "1d", " 12 ", "", "-99999.0", "1e3", "+.5", "1.", "0x1", "1 2", None, "UNKNOWN", "--1", "."]
    want = [1000.0, None, None, 12.0, None, -99999.0, 1000.0, 0.5, 1.0, None, None, None, None, None, None]
    assert column(spark, texts, to_number) == want


def test_attr_state(spark):
    docs = ['{"A":null}', "{}", '{"A":""}', '{"A":"  "}', '{"A":0}', '{"A":"x"}']
    got = column(spark, docs, lambda c: D.attr_state(D.attributes(c), "A"))
    assert got == ["null", "missing", "blank", "blank", "valued", "valued"]


def test_set_attrs_keeps_other_types(spark):
    doc = '{"A":1.5,"B":"1.5","C":null,"D":[1,2],"REMARK":"r"}'
    got = column(spark, [doc], lambda c: D.annotate(c, {"A": F.lit(2)}, ";x;"))[0]
    assert json.loads(got) == {"A": 2, "B": "1.5", "C": None, "D": [1, 2], "REMARK": "r;x;"}


def test_arrays(spark):
    texts = ["[1, 2,3]", "1,,2", "[1, x]", "", "[]"]
    assert column(spark, texts, parse_array) == [[1.0, 2.0, 3.0], [1.0, 2.0], [-99999.0], [], []]
    assert column(spark, ["1, 2", ""], parse_array_strict) == [[1.0, 2.0], []]
    with pytest.raises(Exception, match="not a number"):
        column(spark, ["1,x"], parse_array_strict)


def test_normalize(spark):
    texts = ["AB-1", "a b#1", "A&B", "AANDB"]
    assert column(spark, texts, normalize) == ["AB1", "AB1", "AANDB", "AANDB"]
    assert column(spark, ["1234567890", "12345678901234", "1234567890123456789", "a-b"], normalize14) == [
        "12345678900000", "12345678901234", "1234567890123456789", "ab000000000000"
    ]


def test_location(spark):
    rows = [("10", "20"), ("90", "20"), ("-90", "1"), ("10", "-99999"), ("x", "1"), ("10", "400"), (None, "1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    lat, lon = resolve_location(F.col("a"), F.col("b"))
    got = [tuple(r) for r in df.orderBy("i").select(lat, lon).collect()]
    none = (None, None)
    assert got == [(10.0, 20.0), none, none, none, none, (10.0, 400.0), none]


def test_lenient_json():
    assert lenient_json("{MinRange:0, MaxRange:5000}") == {"MinRange": 0, "MaxRange": 5000}
    assert lenient_json("") == {} and lenient_json("nonsense") == {}


STATES = ['{"A":null}', "{}", '{"A":""}', '{"A":"  "}', '{"A":0}', '{"A":-99999}', '{"A":"-99999.0"}', '{"A":"UNKNOWN"}', '{"A":"1,000"}', '{"A":"5f"}']


@pytest.mark.parametrize(
    "function, params, failed",
    [
        ("Completeness", "", [0, 2, 3, 5, 6]),
        ("ValidityRange", "{MinRange:0, MaxRange:500}", [5, 6, 8]),
        ("ValidityRange", "", []),
        ("IsNumber", "", [0, 2, 3, 5, 6, 7, 8, 9]),
        ("StringLength", '{"Min": 1, "Max": 6}', [0, 1, 2, 3, 6, 7]),
        ("StringLength", '{"Min": 0, "Max": 0}', list(range(10))),
        ("IsEqualTo", '{"Value":"UNKNOWN|0","Delimiter":"|"}', [0, 2, 3, 5, 6, 8, 9]),
        ("IsEqualTo", "", [4, 5, 6, 7, 8, 9]),
        ("IsGreaterThan", '{"Value": 0}', [5, 6]),
        ("IsGreaterThan", '{"Value": 1000}', [4, 5, 6]),
    ],
)
def test_row_rules(spark, function, params, failed):
    rule = Rule("X1", "T", function, "Validity", "A", params)
    got = column(spark, STATES, lambda c: ROW_CHECKS[function](D.attributes(c), rule))
    assert [i for i, f in enumerate(got) if f] == failed


def test_rule_filter(spark):
    docs = ['{"A":"x"}', '{"A":"y"}', '{"B":"x"}', '{"A":null}']
    keep = lambda text: column(spark, docs, lambda c: rule_filter(D.attributes(c), Rule("X", "T", "f", "t", filter=text)))
    assert keep("A = x") == [True, False, False, False]
    assert keep("A=x=y") == [False] * 4
    assert keep("A") == [False] * 4
    assert keep("") == [True] * 4


def test_uniq_key(spark):
    docs = ['{"UWI":"12-345","N":"a"}', '{"UWI":"12345","N":"A"}', '{"UWI":"","N":""}']
    got = column(spark, docs, lambda c: uniq_key(D.attributes(c), '*NORMALIZE(UWI,"-,."); *NORMALIZE(N)'))
    assert got[0] == got[1] and got[2] is None


def test_infer_schema(spark):
    docs = ['{"A":1,"B":"x","C":null,"D":"2020-01-01"}', '{"A":2.5,"B":"y","C":3,"D":"2021-01-01"}', '{"A":7}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    got = {r["attribute"]: (r["inferred_type"], r["has_null"]) for r in D.infer_schema(df).collect()}
    assert got == {"A": ("double", False), "B": ("string", False), "C": ("int", True), "D": ("date", False)}
