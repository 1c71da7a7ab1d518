"""JSON and protobuf walked as trees: no label leaks, nothing else changes, and SQL can call it."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.functions import trees
from tallymark.operators import quality


def hidden(label, salt=""):
    return "proj-" + hashlib.sha256((salt + label).encode()).hexdigest()[:8]


def test_an_item_with_a_list_before_its_name_hides_nothing():
    out = json.loads(trees.masked('{"projects": [{"langs": ["py"], "name": "q/r"}, {"name": "s"}], "z": "q/r", "y": "s"}'))
    assert out == {"projects": [{"langs": ["py"], "name": hidden("q/r")}, {"name": hidden("s")}], "z": hidden("q/r"), "y": hidden("s")}


def test_labels_are_data_whatever_they_hold():
    for label in ("D:\\Elm", 'a "quoted" one', "\\Q.*\\E", "$1 (x|y)[", "tab\tnew\nline", "é/日本", "null", "{", "12"):
        doc = {"a": [{"project": label}], "b": {"c": [label, label + "x"]}, label: label}
        assert json.loads(trees.masked(json.dumps(doc))) == {"a": [{"project": hidden(label)}], "b": {"c": [hidden(label), label + "x"]}, label: hidden(label)}


def test_labels_inside_strings_that_are_json():
    inside = json.dumps({"project": "deep", "x": ["top", json.dumps(["deep"])]})
    out = json.loads(trees.masked(json.dumps({"project": "top", "body": inside, "plain": "deep", "same": '{ "n": 1 }'})))
    assert out["plain"] == hidden("deep") and out["project"] == hidden("top") and out["same"] == '{ "n": 1 }'
    body = json.loads(out["body"])
    assert body == {"project": hidden("deep"), "x": [hidden("top"), json.dumps([hidden("deep")])]}


def test_numbers_keys_order_and_sentinels_stay():
    text = '{"n":1.50,"e":1e5,"big":123456789012345678901234567890,"t":true,"u":null,"project":"[excluded]","projects":[{"name":5},7,"x"],"z":{"name":"x"}}'
    assert trees.masked(text) == text
    assert trees.masked("junk") is None and trees.masked(None) is None and trees.masked("") is None and trees.masked("null") == "null" and trees.masked("NaN") is None
    assert trees.masked("[" * 100_000) is None and trees.masked('"\\ud800"') == '"\\ud800"'
    deep = '{"a":' * 60 + '{"project":"p"}' + "}" * 60
    assert "proj-" in trees.masked(deep) and '"p"' not in trees.masked(deep)


plain = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet="ab[]{}\"\\ é\n", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["project", "projects", "name", "k"]), x, max_size=3), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(plain)
def test_no_label_survives_and_the_shape_stays(doc):
    text = json.dumps(doc)
    labels = set(trees.labels_in(trees.parsed(text)))
    out = trees.masked(text)
    again = trees.parsed(out)

    def strings(node):
        if isinstance(node, str) and not isinstance(node, trees.Number):
            yield node
            if (inner := trees.inner(node)) is not None:
                yield from strings(inner)
        for v in node if isinstance(node, list) else node.values() if isinstance(node, dict) else ():
            yield from strings(v)

    assert not labels & set(strings(again))
    if not labels:
        assert json.loads(out) == doc


def test_masking_a_column(spark):
    df = spark.createDataFrame([(1, '{"project":"a"}'), (2, None), (3, "junk"), (4, '{"x":"a"}')], "i int, t string")
    got = {r.i: r.masked for r in quality.map_labels(df, "t", "salt").collect()}
    assert got == {1: '{"project":"' + hidden("a", "salt") + '"}', 2: None, 3: None, 4: '{"x":"a"}'}
    assert df.limit(1).select(T.pseudonym("proj", F.lit("a"), "salt")).first()[0] == hidden("a", "salt")


def test_json_walk_in_sql_and_its_depth(spark):
    trees.register(spark)
    deep = "x"
    for _ in range(20):
        deep = {"k": deep}
    df = spark.createDataFrame([(1, json.dumps({"a": [{"b": "x"}, 2], "s": '["y"]'})), (2, json.dumps(deep)), (3, "junk"), (4, None)], "i int, t string")
    rows = spark.sql("SELECT d.i, w.* FROM {d} d, LATERAL json_walk(d.t) w", d=df).collect()
    assert {(r.path, r.string) for r in rows if r.i == 1} == {("a", None), ("a[]", None), ("a[].b", "x"), ("s", '["y"]'), ("s(nested)[]", "y")}
    assert max(r.path.count("k") for r in rows if r.i == 2) == trees.DEEPEST and {r.i for r in rows} == {1, 2}


def test_protobuf_walk_in_sql(spark):
    trees.register(spark)
    inside = b"\x08\x96\x01"  # field 1: 150
    message = b"\x12" + bytes([len(inside)]) + inside + b"\x1a\x02\xff\xff" + b"\x25\x01\x00\x00\x00"
    df = spark.createDataFrame([(1, bytearray(message)), (2, bytearray(b"\xff")), (3, None)], "i int, b binary")
    rows = spark.sql("SELECT d.i, w.* FROM {d} d, LATERAL protobuf_walk(d.b) w", d=df).collect()
    assert {(r.path, r.wire, None if r.number is None else int(r.number)) for r in rows} == {("2", 2, None), ("2.1", 0, 150), ("3", 2, None), ("4", 5, None)} and {r.i for r in rows} == {1}
