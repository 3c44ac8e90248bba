"""Row expressions and id handling on hand-written cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vulnlake.functions import coerce, features as fx, ids


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


@pytest.mark.parametrize("value,want", [("cve-2021-1", "CVE-2021-1"), (" CVE-2021-12345 ", "CVE-2021-12345"), ("x CVE-2020-9 y", "CVE-2020-9"), ("CVE-20-1", None), (None, None)])
def test_id(spark, value, want):
    assert one(spark, value).select(ids.found_id(F.col("v"))).first()[0] == want


def test_id_falls_back_to_other_columns(spark):
    df = spark.createDataFrame([(None, "see cve-2020-7"), ("CVE-2019-1", "CVE-2020-7")], "cve_id string, note string")
    assert [r[0] for r in df.select(ids.canonical_cve_id(df, ["cve_id", "absent"])).collect()] == ["CVE-2020-7", "CVE-2019-1"]


def test_aliases(spark):
    text = "CVE-2021-1234; GHSA-x\nCVE-2021-1234|cve-2022-99999,CVE-2021-123 CVE-2021-12345678 CVE-2021-4444-FOO"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, aliases string")
    assert sorted((r.k, r.cve_id) for r in ids.explode_aliases(df, "aliases").collect()) == [(1, "CVE-2021-1234"), (1, "CVE-2021-4444"), (1, "CVE-2022-99999")]


def test_ids_in_text(spark):
    df = spark.createDataFrame([("CVE-2020-1111 and cve-2020-2222", 1), ("again CVE-2020-1111", 2)], "a string, b int")
    assert {r.cve_id for r in ids.extract_ids_from_text(df).collect()} == {"CVE-2020-1111", "CVE-2020-2222"}


def test_names_and_leaves(spark):
    df = spark.createDataFrame([((1, ([1, 2], "x")), 5)], "`A  b` struct<`X-y`:int,z:struct<l:array<int>,t:string>>, `a b` int")
    plain = coerce.normalize_columns(df)
    assert plain.columns == ["a_b"]
    flat = coerce.flatten_struct(df.select(F.col("`A  b`").alias("s")), "s", "all").drop("s").first().asDict()
    assert flat == {"all_x_y": 1, "all_z_l": "[1,2]", "all_z_t": "x"}


@pytest.mark.parametrize("value,want", [("1.5", 1.5), ("abc", None), ("NaN", None), (None, None)])
def test_numbers(spark, value, want):
    assert one(spark, value).select(coerce.number(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("value,want", [
    ("2021-01-02T03:04Z", datetime(2021, 1, 2, 3, 4)), ("2021-01-02T03:04:05.500Z", datetime(2021, 1, 2, 3, 4, 5, 500000)), ("2021-01-02", datetime(2021, 1, 2)),
    ("Dec 12, 2025, 1:02:03 PM", datetime(2025, 12, 12, 13, 2, 3)), ("soon", None), (None, None),
])
def test_moments(spark, value, want):
    got = one(spark, value).select(F.date_format(coerce.moment(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSS")).first()[0]
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S.") + f"{want.microsecond // 1000:03d}")


@pytest.mark.parametrize("score,want", [(3.9, "LOW"), (3.95, "MEDIUM"), (6.9, "MEDIUM"), (7.0, "HIGH"), (8.9, "HIGH"), (9.0, "CRITICAL"), (None, None)])
def test_severity(spark, score, want):
    df = one(spark, score, "double")
    assert df.select(fx.severity_label(score=F.col("v"))).first()[0] == want
    assert df.select(fx.severity_label(text=F.lit("moderate"), score=F.col("v"))).first()[0] == "MEDIUM"


@pytest.mark.parametrize("value,kind,text,want", [
    (True, "boolean", True, True), (None, "boolean", True, False), (1, "int", True, True), (0, "int", True, False), ("yes", "string", True, True), ("yes", "string", False, False),
    ("2021-05-01", "string", True, True), ("no", "string", True, False), (datetime(2021, 1, 1), "timestamp", False, True),
])
def test_label(spark, value, kind, text, want):
    assert one(spark, value, kind).select(fx.kev_flag([(F.col("v"), kind)], text)).first()[0] is want


def test_vectors(spark):
    rows = ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "av:p/ac:h", "AV:N/AV:L", "AV:Q", "AV", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    made = {**fx.parse_cvss_vector(F.col("v")), **fx.cvss_ordinals(F.col("v"))}
    got = [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in made.items()]).orderBy("i").collect()]
    assert [r["cvss_av"] for r in got] == ["N", "P", "L", "Q", None, None, None] and [r["cvss_av_ord"] for r in got] == [3, 0, 1, None, None, None, None]
    assert got[0]["cvss_a_ord"] == 2 and got[1]["cvss_ac_ord"] == 0 and got[0]["cvss_v3_present"] == 1 and got[5]["cvss_v3_present"] == 0


def test_spread_and_lag(spark):
    d = [datetime(2021, 1, 1), datetime(2021, 1, 3), datetime(2021, 1, 5)]
    rows = [(0, None, None, None), (1, d[0], None, None), (2, d[0], d[1], None), (3, *d)]
    df = spark.createDataFrame(rows, "i int, a timestamp, b timestamp, c timestamp")
    dates = [F.col(x) for x in "abc"]
    got = df.select("i", fx.spread_days(dates, 0), fx.spread_days(dates, 1), fx.publication_lag(dates)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(None, None, None), (0.0, None, 0.0), (1.0, 2.0, 2.0), (pytest.approx(8 / 3), 4.0, 4.0)]


def test_text(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "  "), (3, "A Remote Code Execution")], "i int, v string")
    got = df.select("i", *[c.alias(n) for n, c in fx.text_stats(F.col("v")).items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0), (0, 0, 0), (2, 0, 0), (23, 4, 1)]
