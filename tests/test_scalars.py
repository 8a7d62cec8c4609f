from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runloom.functions import fixed
from runloom.functions import scalars as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,seconds",
    [
        ("30s", 30.0), ("5m", 300.0), ("2h", 7200.0), ("1d", 86400.0), ("@hourly", 3600.0), ("@daily", 86400.0),
        ("@weekly", 604800.0), ("@once", None), (None, None), (" 1.5h ", 5400.0), ("0s", 0.0),
    ],
)
def test_schedule_text(spark, text, seconds):
    assert one(spark, S.schedule_seconds, text) == seconds
    assert one(spark, S.is_bad_schedule, text) is False
    assert one(spark, S.require_schedule, text) == seconds


@pytest.mark.parametrize("text", ["*/5 * * * *", " @daily", "5", "m5", "", "1.h"])
def test_unreadable_schedules(spark, text):
    assert one(spark, S.is_bad_schedule, text) is True
    with pytest.raises(Exception, match="bad schedule"):
        one(spark, S.require_schedule, text)


@pytest.mark.parametrize(
    "schedule,last,now,due",
    [
        ("@hourly", None, 100.0, True),
        ("@hourly", 100.0, 100.0, False),
        ("@hourly", 100.0, 3700.0, True),
        ("@once", None, 5.0, True),
        ("@once", 0.0, 5.0, False),
        (None, None, 5.0, False),
        ("0s", 5.0, 5.0, True),
    ],
)
def test_due(spark, schedule, last, now, due):
    df = spark.createDataFrame([(schedule, last, now)], "s string, l double, n double")
    assert df.select(S.is_due(F.col("s"), F.col("l"), F.col("n")).alias("d")).first()["d"] is due


@pytest.mark.parametrize(
    "seconds,label",
    [
        (0, "0s ago"), (59, "59s ago"), (60, "1m ago"), (150, "2m ago"), (210, "4m ago"), (3600, "1h ago"),
        (5400, "2h ago"), (86400, "1d ago"), (2.5 * 86400, "2d ago"), (59.6, "60s ago"), (0.5, "0s ago"),
    ],
)
def test_age(spark, seconds, label):
    now = 10_000_000.0
    assert one(spark, lambda c: S.age_label(c, F.lit(now)), now - seconds, "double") == label


def test_age_without_a_time(spark):
    assert one(spark, lambda c: S.age_label(c, F.lit(5.0)), None, "double") == "-"


@pytest.mark.parametrize(
    "text,values,rejected",
    [
        ("5.1,3.5, 1.4 ,0.2", [5.1, 3.5, 1.4, 0.2], False),
        ("  1\t2\n3 ", [1.0, 2.0, 3.0], False),
        ("1,,2", [1.0, 2.0], False),
        ("1 abc", [1.0, None], True),
        ("1d 2f", [None, None], True),
        ("1e3 -.5 +2. 1_000", [1000.0, -0.5, 2.0, 1000.0], False),
        ("1__0", [None], True),
        ("", [], False),
        (" , ", [], False),
    ],
)
def test_rows_of_text(spark, text, values, rejected):
    assert one(spark, S.parse_row, text) == values
    assert one(spark, lambda c: S.is_rejected(S.parse_row(c)), text) is rejected


def test_infinite_and_missing_numbers(spark):
    got = one(spark, S.parse_row, "inf -Infinity NaN -nan")
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] != got[3]


def test_width_is_checked_before_anything_else(spark):
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert df.select(S.width_message(F.col("v"), names).alias("m")).first()["m"] == "expected 4 values (a, b, c, d), got 3"
    with pytest.raises(Exception, match="expected 4 values"):
        df.select(S.require_width(F.col("v"), names)).collect()


@pytest.mark.parametrize("index,name", [(0, "x"), (2, "z"), (3, None)])
def test_class_names(spark, index, name):
    classes = F.array(*[F.lit(c) for c in "xyz"]) if spark else None
    assert one(spark, lambda c: S.decode_class(classes, c), index, "int") == name


@pytest.mark.parametrize(
    "text,kept", [("", None), ("  ", None), ("String", None), (" NULL ", None), ("none", None), (None, None), (" m ", "m")]
)
def test_blanks(spark, text, kept):
    assert one(spark, S.given, text) == kept


def test_run_key_is_stable_and_zone_free(spark):
    df = spark.createDataFrame([("iris", 0.0)], "d string, t double")
    key = df.select(S.run_key(F.col("d"), F.col("t"), F.lit(1)).alias("k")).first()["k"]
    assert key.startswith("iris__19700101T000000__") and len(key.rsplit("__", 1)[1]) == 6
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        again = df.select(S.run_key(F.col("d"), F.col("t"), F.lit(1)).alias("k")).first()["k"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert again == key


@pytest.mark.parametrize("needle", fixed.AUTH_NEEDLES)
def test_login_failures(spark, needle):
    assert one(spark, S.is_auth_failure, f"fatal: {needle.upper()} for x") is True


def test_other_failures_are_not_login_failures(spark):
    assert one(spark, S.is_auth_failure, "connection reset") is False
    assert one(spark, S.is_auth_failure, None) is False


@pytest.mark.parametrize(
    "ref,module,function", [("a.b:f", "a.b", "f"), ("a:C.f", "a", "C.f"), ("a:b:c", "a", "b:c"), ("a.b", "a.b", "")]
)
def test_refs(spark, ref, module, function):
    assert one(spark, S.ref_module, ref) == module
    assert one(spark, S.ref_function, ref) == function


@pytest.mark.parametrize(
    "error,kind,message",
    [
        ("ValueError: bad: worse", "ValueError", "bad: worse"),
        ("KeyError: two\nlines", "KeyError", "two\nlines"),
        ("no type here", None, "no type here"),
        (None, None, None),
    ],
)
def test_error_parts(spark, error, kind, message):
    assert one(spark, S.error_type, error) == kind
    assert one(spark, S.error_message, error) == message


def test_log_tail_counts_characters(spark):
    text = "ä" * 10 + "b" * 2000
    assert one(spark, S.log_tail, text) == "b" * 2000
    assert one(spark, S.log_tail, "short") == "short"


@pytest.mark.parametrize("text,value", [('{"v": 1}', 1), ("", None), (None, None), ("null", None), ("oops", None)])
def test_results(spark, text, value):
    assert one(spark, lambda c: F.try_variant_get(S.decode_result(c), "$.v", "int"), text) == value


def test_tag_lists(spark):
    df = spark.createDataFrame([({"classes": '["x","y"]'},)], "tags map<string,string>")
    row = df.select(
        S.tag_list(F.col("tags"), "classes").alias("kept"),
        S.tag_list(F.col("tags"), "features").alias("none"),
        S.tag_list(F.col("tags"), "classes", F.array(F.lit("own"))).alias("own"),
        S.list_tag(["x", "y"]).alias("text"),
    ).first()
    assert (row["kept"], row["none"], row["own"], row["text"]) == (["x", "y"], [], ["own"], '["x","y"]')


@pytest.mark.parametrize("tag,experiment", [(None, "inference"), ("", "inference"), ("iris", "iris")])
def test_experiment(spark, tag, experiment):
    assert one(spark, S.experiment_of, tag) == experiment


@pytest.mark.parametrize("value,text", [(0.97777, "0.9778"), (1.0, "1.0000"), (None, None)])
def test_score_text(spark, value, text):
    assert one(spark, lambda c: S.fixed_text(c, 4), value, "double") == text
