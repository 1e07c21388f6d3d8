"""Names, catalogs, access rules, cursors, documents and values; no session needed."""

import datetime as dt
import time
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from heddle.functions import scalars
from heddle.operators import paging
from heddle.plans import document, policy
from heddle.plans.catalog import Column, exposed, load
from heddle.plans.naming import check_collisions, field_name


@pytest.mark.parametrize(("name", "want"), [("posts", "posts"), ("my-table", "my_table"), ("2fa", "_2fa"), ("", "_"), ("__x", "_x"), ("a b.c", "a_b_c"), ("é", "_")])
def test_field_name(name, want):
    assert field_name(name) == want


@pytest.mark.parametrize(
    "tables",
    [
        {"a-b": [], "a_b": []},
        {"t": ["x-y", "x_y"]},
        {"posts": [], "posts_bool_exp": []},
        {"posts": ["v"], "posts_nearest_by_v": []} | {"posts_connection": []},
        {"posts": [], "posts_one": []},
        {"order_by": []},
        {"page_info": []},
        {"Query": []},
        {"BigInt_comparison_exp": []},
    ],
)
def test_collisions(tables):
    with pytest.raises(ValueError, match="both map|collides"):
        check_collisions(tables)


def test_no_collision():
    check_collisions({"users": ["id", "name"], "posts": ["id"]})


SCHEMAS = {"a": T.StructType([T.StructField("id", T.LongType()), T.StructField("b_id", T.LongType()), T.StructField("v", T.ArrayType(T.FloatType()))]), "b": T.StructType([T.StructField("id", T.LongType()), T.StructField("p", T.IntegerType())])}


def catalog():
    keys = [{"name": n, "columns": ["b_id"], "references": "b", "ref_columns": ["id"]} for n in ("k1", "k2", "k3")]
    return load({"tables": {"a": {"primary_key": ["id"], "foreign_keys": keys}, "b": {"primary_key": ["id"]}}}, SCHEMAS)


def test_relation_names():
    assert list(catalog().relations("a")) == ["b", "b_by_b_id", "b_by_b_id_1"]
    assert list(catalog().relations("b")) == ["a", "a_by_b_id", "a_by_b_id_1"]


def test_exposed():
    assert exposed(["a", "b", "c"]) == ["a", "b", "c"]
    assert exposed(["a", "b", "c"], ["a", "b"], ["b"]) == ["a"]
    with pytest.raises(ValueError, match="no tables"):
        load({}, {})


CLAIMS = {"sub": "7", "app": {"tenant": {"id": 3}}, "https://x.y/claims": {"role": "r"}, "a.b": 1, "list": [1, "x"], "none": [], "obj": {}, "n": 7.0, "p.q": "x", "p": {"q": {"r": 1}, "q.s": {"t": 2}}}


@pytest.mark.parametrize(("path", "want"), [("sub", "7"), ("app.tenant.id", 3), ("https://x.y/claims.role", "r"), ("a.b", 1), ("p.q.r", 1), ("p.q.s.t", 2), ("p.q", "x")])
def test_claim(path, want):
    assert policy.claim(CLAIMS, path) == want


@pytest.mark.parametrize("path", ["nope", "app.nope", "sub.x", "app.tenant.id.x"])
def test_missing_claim(path):
    with pytest.raises(policy.AccessError):
        policy.claim(CLAIMS, path)


def test_filters():
    bind = lambda text: policy.compile_filter(text).bind(CLAIMS)
    assert bind("a = :jwt.sub OR b IN (:jwt.list)") == ("a = ? OR b IN (?, ?)", ["7", 1, "x"])
    assert bind("b IN (:jwt.none)") == ("b IN (NULL)", [])
    assert bind("b = :jwt.n") == ("b = ?", [7]) and isinstance(bind("b = :jwt.n")[1][0], int)
    assert bind("a = ':jwt.sub' AND `:jwt.sub` = :jwt.sub") == ("a = ':jwt.sub' AND `:jwt.sub` = ?", ["7"])
    for bad in ("a = :jwt.obj", "a = :jwt.nope"):
        with pytest.raises(policy.AccessError):
            bind(bad)
    with pytest.raises(ValueError, match="blank"):
        policy.compile_filter("  ")


def test_resolve():
    c = catalog()
    star = {"select": {"allow": True, "columns": ["p"]}, "insert": True}
    found = policy.resolve("r", {"tables": {"*": star, "a": {"select": True}}}, c)
    assert found["a"].keys() == {"select"} and found["b"]["select"].columns == ("p",)
    found = policy.resolve("r", {"tables": {"*": star, "a": None}}, c)
    assert "select" not in found["a"] and found["a"].keys() == {"insert"}  # no column p: denied
    with pytest.raises(ValueError, match="not exposed"):
        policy.resolve("r", {"tables": {"zz": {}}}, c)
    with pytest.raises(ValueError, match="does not exist"):
        policy.resolve("r", {"tables": {"a": {"select": {"allow": True, "columns": ["nope"]}}}}, c)
    assert policy.resolve("r", {"tables": {"a": {"select": {"allow": False}, "delete": False}}}, c) == {}
    assert not policy.pk_readable(policy.resolve("r", {"tables": {"*": star}}, c), c["b"])


KEYS = [[1, 2**62 + 1], ["x", "é\n"], [dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6)], [Decimal("1.50"), b"\x00\xff"], [True, 0.1]]


@pytest.mark.parametrize("key", KEYS)
def test_cursor(key):
    mark = paging.shape("t", {"a": {"_eq": 1}, "b": None})
    cursor = paging.encode_cursor(key, mark)
    found = paging.decode_cursor(cursor, mark, 2)
    assert found == key and [type(v) for v in found] == [type(v) for v in key]
    assert cursor == paging.encode_cursor(key, mark)
    for bad, m, n in ((cursor, paging.shape("u", None), 2), (cursor, mark, 3), ("%%%", mark, 2), (cursor[:-8], mark, 2), ("e30=", mark, 2), ("", mark, 2)):
        with pytest.raises(scalars.InputError):
            paging.decode_cursor(bad, m, n)


def test_shape():
    assert paging.shape("t", {"a": 1, "b": 2}) == paging.shape("t", {"b": 2, "a": 1})
    assert len({paging.shape("t", None), paging.shape("t", {}), paging.shape("u", None), paging.shape("t", {"a": 1})}) == 4


@pytest.mark.parametrize(("n", "first", "more", "kept"), [(0, 3, False, 0), (3, 3, False, 3), (4, 3, True, 3), (1, 0, False, 0), (2, 3, False, 2), (1, 1, False, 1)])
def test_page_info(n, first, more, kept):
    got, info = paging.page_info([[i] for i in range(n)], first, paging.shape("t", None))
    assert got == kept and info["has_next_page"] is more
    assert info["end_cursor"] == (paging.encode_cursor([kept - 1], paging.shape("t", None)) if kept else None)


def test_page_size():
    assert [paging.page_size(x, 25, 200) for x in (None, 0, 7, 999)] == [25, 0, 7, 200]
    with pytest.raises(scalars.InputError):
        paging.page_size(-1, 25, 200)


def column(kind, dtype, **more):
    return Column("c", dtype, kind, **more)


@pytest.mark.parametrize(
    ("kind", "dtype", "value", "want"),
    [
        ("BigInt", T.LongType(), "9223372036854775807", 2**63 - 1), ("BigInt", T.LongType(), 3.0, 3), ("BigInt", T.DecimalType(20, 0), str(2**64 - 1), 2**64 - 1),
        ("Decimal", T.DecimalType(10, 2), "1.50", Decimal("1.50")), ("Decimal", T.DecimalType(10, 2), 2, Decimal(2)), ("Date", T.DateType(), "2024-02-29", dt.date(2024, 2, 29)),
        ("DateTime", T.TimestampNTZType(), "2024-01-02T03:04:05+02:00", dt.datetime(2024, 1, 2, 1, 4, 5)), ("DateTime", T.TimestampNTZType(), "2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("Bytes", T.BinaryType(), "AP8=", b"\x00\xff"), ("Vector", T.ArrayType(T.FloatType()), "[1, 2.5]", [1.0, 2.5]), ("Boolean", T.ByteType(), True, 1), ("Boolean", T.BooleanType(), True, True),
        ("JSON", T.StringType(), {"a": [1]}, '{"a": [1]}'), ("Int", T.IntegerType(), None, None),
    ],
)
def test_parse(kind, dtype, value, want):
    found = scalars.parse(column(kind, dtype), value)
    assert found == want and type(found) is type(want)


@pytest.mark.parametrize(
    ("kind", "dtype", "value"),
    [
        ("Int", T.IntegerType(), 2**31), ("Int", T.IntegerType(), "1"), ("BigInt", T.LongType(), 2**63), ("BigInt", T.LongType(), 1.5), ("BigInt", T.LongType(), True), ("Decimal", T.DecimalType(5, 2), "x"),
        ("Decimal", T.DecimalType(5, 2), "NaN"), ("Date", T.DateType(), "2024-13-01"), ("DateTime", T.TimestampType(), "yesterday"), ("Bytes", T.BinaryType(), "%%"), ("Vector", T.ArrayType(T.FloatType()), "[1, true]"),
        ("Vector", T.ArrayType(T.FloatType()), "nope"), ("String", T.StringType(), 5), ("Boolean", T.ByteType(), 1), ("Float", T.DoubleType(), "1"),
    ],
)
def test_parse_errors(kind, dtype, value):
    with pytest.raises(scalars.InputError):
        scalars.parse(column(kind, dtype), value)


def test_shown():
    assert scalars.shown("Decimal", Decimal("10.50")) == "10.50"
    assert scalars.shown("DateTime", dt.datetime(2024, 1, 2, 3, 4, 5, 999999)) == "2024-01-02T03:04:05Z"
    assert scalars.shown("Vector", [1.0, 2.5]) == "[1,2.5]"
    assert scalars.shown("JSON", '{"a": 1}') == {"a": 1} and scalars.shown("Boolean", 2) is True


def test_depth():
    assert document.depth(document.parse("{ a { b { c } } d }")) == 3
    assert document.depth(document.parse("{ a { ...F } } fragment F on x { b { c { d } } }")) == 5 - 1
    assert document.depth(document.parse("{ a { ...F } } fragment F on x { b { ...F } }")) == 2
    text = "{ ...F0 }" + "".join(f" fragment F{i} on x {{ a {{ ...F{i + 1} }} b {{ ...F{i + 1} }} }}" for i in range(60)) + " fragment F60 on x { z }"
    began = time.time()
    assert document.depth(document.parse(text)) == 61
    assert time.time() - began < 5


@pytest.mark.parametrize("text", ["", "{", "{ }", "{ a(b: ) }", "{ a(b: 1, b: 2) }", "query ($a) { b }", '{ a(b: "x) }', "fragment F { a }", "what { a }", "{ a ? }"])
def test_bad_documents(text):
    with pytest.raises(document.DocumentError):
        document.parse(text)


def test_values():
    op = document.parse('{ a(i: -3, f: 1.5e2, s: "x\\n\\u00e9", b: true, n: null, e: RED, l: [1, [2]], o: {k: $v}) }').operations[0]
    args = document.resolve(op.selections[0].args, {"v": 9}, {"v"})
    assert args == {"i": -3, "f": 150.0, "s": "x\né", "b": True, "n": None, "e": "RED", "l": [1, [2]], "o": {"k": 9}}
