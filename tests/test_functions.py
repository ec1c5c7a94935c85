"""Normalizers, typed values, ids and digests."""

import hashlib
import hmac
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.errors import InvalidConfiguration
from kinfold.functions import digest, normalize, values
from kinfold.plans.rules import ExactRule


def apply(spark, normalizer, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    out = df.select("i", normalizer.apply(F.col("x"), df.schema["x"].dataType).alias("v")).orderBy("i").collect()
    return [None if r["v"] is None else (r["v"]["type"], r["v"]["value"]) for r in out]


def text(v):
    return None if v is None else v[1]


def test_trimmed(spark):
    got = apply(spark, normalize.TrimmedText(), [None, "", " \t\n", "  Acme   Corp  ", " x"])
    assert got == [None, None, None, ("string", "Acme   Corp"), ("string", " x")]
    same = ["مرحبا", "\U0001f468‍\U0001f469", "é"]
    assert [text(v) for v in apply(spark, normalize.TrimmedText(), same)] == same
    assert [text(v) for v in apply(spark, normalize.TrimmedText(lowercase=True), ["Acme"])] == ["acme"]
    assert [text(v) for v in apply(spark, normalize.TrimmedText(nfc=True), ["é"])] == ["é"]
    assert apply(spark, normalize.TrimmedText(), [5], "int") == [("string", "5")]
    assert apply(spark, normalize.TrimmedText(), [True], "boolean") == [None]
    bad = spark.sql("select cast(x'B131' as string) x")
    assert bad.select(normalize.TrimmedText().apply(F.col("x"), T.StringType()).alias("v")).first()["v"] is None
    assert normalize.TrimmedText().version != normalize.TrimmedText(lowercase=True).version


def test_email(spark):
    got = apply(spark, normalize.Email(), ["  John.Doe+tag@Example.COM ", None, "", "not-an-email", "user@", "user@localhost", "user name@example.com"])
    assert [text(v) for v in got] == ["John.Doe+tag@example.com", None, None, None, None, None, None]
    assert [text(v) for v in apply(spark, normalize.Email(lowercase_local=True), ["John.Doe@Example.COM"])] == ["john.doe@example.com"]
    assert apply(spark, normalize.Email(), [42], "int") == [None]


def test_identity(spark):
    n = normalize.Identity()
    assert apply(spark, n, [0], "int") == [("integer", "0")]
    assert apply(spark, n, ["0", None, "", "   ", "  x  "]) == [("string", "0"), None, None, None, ("string", "  x  ")]
    assert apply(spark, n, [False, True], "boolean") == [("boolean", "0"), ("boolean", "1")]
    for kind, x in (("double", 1.5), ("array<int>", [1])):
        with pytest.raises(InvalidConfiguration):
            apply(spark, n, [x], kind)


@pytest.mark.parametrize("n", [normalize.Identity(), normalize.TrimmedText(), normalize.TrimmedText(True), normalize.TrimmedText(True, True), normalize.Email()])
def test_idempotent(spark, n):
    once = [text(v) for v in apply(spark, n, ["  Ada Lovelace  ", "  Ada@Example.COM  "])]
    assert [text(v) for v in apply(spark, n, once)] == once


def test_tuples_are_injective(spark):
    df = spark.sql("select 'a' a, 'a,b' ab, 'b' b, 1 one, '1' one_text, true yes, 'é/\"' odd")

    def of(*names):
        parts = [values.typed(F.col(n), df.schema[n].dataType) for n in names]
        return df.select(values.tuple_json(parts).alias("t")).first()["t"]

    all_ = [of("ab"), of("a", "b"), of("b", "a"), of("one"), of("one_text"), of("yes")]
    assert len(set(all_)) == len(all_)
    assert of("odd") == json.dumps([["string", 'é/"']], ensure_ascii=False, separators=(",", ":"))


def test_record_ids(spark):
    ids = ["0", "1", "9", "10", "100", "1000", "99999999999999999999", "-5", "-50", "9223372036854775808"]
    df = spark.createDataFrame([(x,) for x in ids], "v string").withColumn("r", F.struct(F.lit("int").alias("type"), F.col("v").alias("value")))
    got = [r["v"] for r in df.orderBy(values.id_order(F.col("r"))).collect()]
    assert got == [str(x) for x in sorted(map(int, ids))]
    back = df.select(values.encode_id(F.col("r")).alias("e")).select(values.decode_id(F.col("e")).alias("d"), "e").collect()
    assert all(r["e"] == f"int:{r['d']['value']}" for r in back)
    odd = spark.createDataFrame([("a:b:c",), ("none",)], "e string").select(values.decode_id(F.col("e")).alias("d")).collect()
    assert (odd[0]["d"]["type"], odd[0]["d"]["value"], odd[1]["d"]) == ("a", "b:c", None)
    domains = spark.createDataFrame([("123E4567-e89b-12d3-a456-426614174000",), ("01ARZ3NDEKTSV4RRFFQ69G5FAV",), ("x",)], "v string")
    assert [r[0] for r in domains.select(values.key_domain(F.col("v"), T.StringType())).collect()] == ["uuid", "ulid", "string"]
    lone = spark.createDataFrame([("-",), ("-3",), ("3a",)], "v string").select(values.valid_int(F.col("v"))).collect()
    assert [r[0] for r in lone] == [False, True, False]


def test_typed_equality(spark):
    q = spark.sql("select cast(null as int) n, 0 zero, '0' zero_text, '' blank, false no, cast('0.10' as decimal(4,2)) d1, '0.1' d2, 5 five, '5' five_text")

    def equal(a, b):
        return q.select(values.typed_equal(*(values.typed(F.col(c), q.schema[c].dataType) for c in (a, b)))).first()[0]

    for a, b in (("zero", "n"), ("no", "n"), ("zero_text", "zero"), ("zero_text", "blank"), ("d1", "d2"), ("five", "five_text")):
        assert equal(a, b) is False
    for a in q.columns:
        assert equal(a, a) is True


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30).filter(lambda s: all(ord(c) >= 32 and not 0xD800 <= ord(c) < 0xE000 and c not in "\x7f  " for c in s)), min_size=1, max_size=5), st.binary(min_size=1, max_size=100))
def test_hmac_equals_the_standard_library(spark, texts, key):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select("t", digest.hmac_column(key, F.col("t")), digest.keyed(key, ["a", "b"], F.col("t"))).collect()]
    for t, h, k in got:
        assert h == hmac.new(key, t.encode(), hashlib.sha256).hexdigest()
        assert k == digest.keyed_text(key, ["a", "b"], t)


def test_scopes_and_pairs(spark):
    assert digest.scope_hash(b"k", "d", "c", "o", None) == digest.scope_hash(b"k", "d", "c", "o", "")
    assert digest.scope_hash(b"k", "d", "c", "o", "x") != digest.scope_hash(b"k", "d", "c", "o", "y")
    assert digest.retirement_domain("c", "m", "o") == digest.retirement_domain("c", "m", "o")
    df = spark.createDataFrame([("int:1", "int:2")], "a string, b string")
    assert len({r for r in df.select(digest.pair_hash(b"k", "s", F.col("a"), F.col("b")), digest.pair_hash(b"k", "s", F.col("b"), F.col("a"))).first()}) == 1


def test_rules(spark):
    df = spark.sql("select 'x' a, cast(null as string) b, 1.5D f")
    assert df.select(ExactRule("r", ("a", "b")).components(df.schema).alias("t")).first()["t"] is None
    for fields in ((), ("missing",), ("f",)):
        with pytest.raises(InvalidConfiguration):
            ExactRule("r", fields).components(df.schema)
    assert ExactRule("r", ("a",)).signature != ExactRule("r", ("a",), normalize.TrimmedText()).signature
    assert ExactRule("r", ("a",), normalize.TrimmedText()).signature != ExactRule("r", ("a",), normalize.TrimmedText(True)).signature


def test_display(spark):
    df = spark.sql("select true b, cast(null as int) n, timestamp'2024-01-02 03:04:05.678' t, array(1, 2) a, 'x' s")
    got = df.select(*[values.display(F.col(c), df.schema[c].dataType) for c in df.columns]).first()
    assert list(got) == ["true", "", "2024-01-02T03:04:05+00:00", "[1,2]", "x"]


def test_values_are_normalised_once(spark):
    """A plan names each dear step once, whatever is made of its value."""
    df = spark.createDataFrame([("A ", "b"), ("  ", "b"), (None, "c")], "x string, y string")
    rule = ExactRule("r", ("x", "y"), normalize.TrimmedText(True))
    out = df.select(digest.keyed(b"k", ["a"], rule.components(df.schema)).alias("d"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2 and plan.count("trim(") == 2 and plan.count("sha2(") == 2
    assert [r["d"] for r in out.collect()] == [digest.keyed_text(b"k", ["a"], '[["string","a"],["string","b"]]'), None, None]


def test_tuple_text_equals_tuple_json(spark):
    df = spark.sql("select * from values ('a', 1, true), ('é/\"\\n', 2, false), (null, 3, true), ('null', null, null), ('x', 4, null) as t(s, i, b)")
    kinds = {c: df.schema[c].dataType for c in df.columns}
    for names in (["s"], ["i", "b"], ["b", "s", "i"]):
        a = values.tuple_json([values.typed(F.col(c), kinds[c]) for c in names])
        b = values.tuple_text([values.typed_text(F.col(c), kinds[c]) for c in names])
        rows = df.select(a.alias("a"), b.alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows] and any(r["a"] for r in rows)


def test_email_lengths(spark):
    long = ["a" * 64 + "@example.com", "a" * 65 + "@example.com", "a@" + "b" * 63 + ".com", "a@" + "b" * 64 + ".com", "a@" + ".".join(["b" * 60] * 4) + ".example", "a@" + ".".join(["b" * 60] * 4) + ".examples.com"]
    assert [text(v) is not None for v in apply(spark, normalize.Email(), long)] == [True, False, True, False, True, False]
