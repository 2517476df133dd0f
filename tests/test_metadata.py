"""Strict metadata view (Q1, Q2), validity rule."""

from pyspark.sql import functions as F

from evtide.functions.metadata import (
    has_key, json_text, metadata_issue, with_hot_columns, with_typed_metadata,
)


def typed(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, metadata string")
    out = with_typed_metadata(df, out="m", ok_col="ok").orderBy("id").collect()
    return out


def test_type_mismatch_nulls_whole_struct(spark):
    rows = ['{"page":123}', '{"page":"a","product_id":"x"}', '{"product_id":1.0}',
            '{"product_id":3000000000}', '[1]', '{"page":{"a":1}}', 'not json', None]
    for r in typed(spark, rows):
        assert r["m"] is None and r["ok"] is False, r


def test_unknown_keys_and_nulls_kept(spark):
    out = typed(spark, ['{"page":"a","zzz":1}', '{"page":null}', '{"product":{"id":1}}',
                        '{"product_id":5,"session_id":"s"}'])
    assert out[0]["m"]["page"] == "a" and out[0]["ok"]
    assert out[1]["m"] is not None and out[1]["m"]["page"] is None
    assert out[2]["m"] is not None and out[2]["m"]["product_id"] is None
    assert out[3]["m"]["product_id"] == 5 and out[3]["m"]["session_id"] == "s"


def test_pushed_filter_on_typed_field(spark):
    df = spark.createDataFrame([(1, '{"page":"a"}'), (2, '{"page":5}'), (3, '{}')],
                               "id int, metadata string")
    got = (with_typed_metadata(df, out="m").filter(F.col("m.page").isNotNull())
           .select("id").collect())
    assert [r.id for r in got] == [1]


def test_key_exists_even_when_null(spark):
    df = spark.createDataFrame([('{"page":null}',), ('{"x":1}',), ('{"page":"p"}',)], "m string")
    got = df.select(has_key("m", "page").alias("k"), json_text("m", "page").alias("v")).collect()
    assert [r.k for r in got] == [True, False, True]
    assert [r.v for r in got] == [None, None, "p"]


def test_validity_rule(spark):
    df = spark.createDataFrame([
        ('{"referrer":"ftp://x"}',), ('{"product_id":0}',),
        ('{"referrer":"https://ok","product_id":7}',), ('{}',)], "metadata string")
    got = (with_typed_metadata(df, out="m").select(metadata_issue("m").alias("r")).collect())
    assert [r.r for r in got] == ["invalid_referrer", "invalid_product_id", None, None]


def test_hot_columns_equal_the_strict_view(spark):
    rows = ['{"page":123}', '{"page":"a","product_id":"x"}', '{"product_id":1.0}', '{}',
            '{"product_id":3000000000}', '[1]', '{"page":{"a":1}}', 'not json', None, '"text"',
            '{"page":"a","zzz":1}', '{"page":null}', '{"product_id":5,"session_id":"s"}', 'null',
            '{"page":"a","page":"b"}', '{"page":"a"} trailing', '{"page":[1, 2]}', '{"page":1.50}',
            '{"page":"q\\"uo\\u00e9\\n","referrer":null,"product_id":null}', '', ' {"page":"b"} ',
            '{"page":true,"session_id":"s"}', '{"referrer":"r","session_id":7}', '{"PAGE":"x"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, metadata string")
    want = with_typed_metadata(df, out="m").select(
        "id", has_key("metadata", "page"), json_text("metadata", "page"), "m.page", "m.referrer",
        "m.session_id", "m.product_id").collect()
    got = with_hot_columns(df).drop("metadata").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
