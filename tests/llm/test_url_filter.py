"""Rules, block lists and the cascade behind them."""

import pytest
from pyspark.sql import functions as F

from riskline.llm import url_filter as uf

RULES = [uf.Rule("allow", "org/"), uf.Rule("block", "example.org/es/"), uf.Rule("block", "example.org/en/1"), uf.Rule("allow", "com/fr/"), uf.Rule("block", "com/de/")]


def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(df, RULES, **kw).collect()}


def test_urls(spark):
    got = judged(
        spark,
        [
            (1, None), (2, "nope"), (3, "http://"), (4, "HTTP://WWW.Casino-Win.Example.COM"), (5, "x://a.b.pills-x.c/p/é?q#r"),
            (6, "http://" + "a." * 5000 + "casino.net/z"), (7, "http://É.ORG/fr/"), (8, "http://org?x"), (9, "http://org/"), (10, "http://xorg/"),
            (11, "https://m.example.org/en/1234"), (12, "https://example.org/es/"), (13, "https://a.com/de/x://b"), (14, "a://b://c"), (15, "http://x-pills-y.z"),
            (16, "http://mypills.z"), (17, "http://a.com#/de/"), (18, "http://a.com/fr/" + "x" * 100_000), (19, "http://spam.1.2.3.4.5/"), (4, "HTTP://WWW.Casino-Win.Example.COM"),
        ],
        words=("casino", "pills", "spam"),
    )
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.casino-win.example.com", "", None, "block")
    assert got[5] == ("a.b.pills-x.c", "/p/é", None, "block")
    assert got[6][1:] == ("/z", None, "block") and len(got[6][0]) == 10010
    assert got[7] == ("É.org", "/fr/", "org/", "allow")
    assert got[8] == ("org", "", None, "allow")
    assert got[9][2:] == ("org/", "allow") and got[10][2:] == (None, "allow")
    assert got[11][2:] == ("example.org/en/1", "block") and got[12][2:] == ("example.org/es/", "block")
    assert got[13] == ("a.com", "/de/x://b", "com/de/", "block") and got[14] == ("b:", "//c", None, "allow")
    assert got[15][3] == "block" and got[16][3] == "allow"
    assert got[17] == ("a.com", "", None, "allow") and got[18][2] == "com/fr/"
    assert got[19][3] == "allow"
    assert judged(spark, [], words=("casino",)) == {}


def test_other_columns_pass(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "x", "y", 3)], "page_id long, url string, Host string, _listed string, rule int")
    got = uf.judge(df, RULES, spark.createDataFrame([("b",)], "key string"))
    assert got.columns == ["page_id", "url", "_listed", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == (1, "http://a.b/c", "y", "a.b", "/c", None, "block")


@pytest.mark.parametrize("most", [uf.MOST, 1 << 14])
def test_membership_is_exact(spark, monkeypatch, most):
    """Every key of the universe, by one cascade or by several, against the list itself."""
    monkeypatch.setattr(uf, "MOST", most)
    hosts = spark.range(30_000).select(F.concat(F.md5(F.col("id").cast("string")), F.lit(".org")).alias("host"), "id")
    listed = hosts.where("id % 13 = 0").select(F.col("host").alias("key")).union(spark.createDataFrame([("not.there",)], "key string"))
    got = uf.with_listed(hosts, listed, "hit")
    assert got.where("hit <> (id % 13 = 0)").count() == 0 and got.count() == 30_000
    keys = uf.marked_keys(uf.universe(hosts, 2), listed)
    levels = uf.cascade(keys).levels
    assert len(levels) >= 3 and levels[1].words < levels[0].words
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def test_empty_lists(spark):
    hosts = spark.createDataFrame([("a.b",), ("",)], "host string")
    none = spark.createDataFrame([], "key string")
    assert [r["hit"] for r in uf.with_listed(hosts, none, "hit").collect()] == [False, False]
    every = spark.createDataFrame([("b",), ("b",), ("",)], "key string")
    assert [r["hit"] for r in uf.with_listed(hosts, every, "hit").orderBy("host").collect()] == [False, True]
