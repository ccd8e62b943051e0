"""Hosts that the method itself blocks: by the outcomes of the rules, and by outcomes that the caller labels."""

import duckdb
from oracle import rows
from orestrata.llm import urls


def planted():
    pages = [(f"http://bad.shop.com/de/{i}",) for i in range(60)] + [(f"http://good.shop.com/fr/{i}",) for i in range(60)]
    pages += [(f"http://worse.evil.co.uk/x/{i}",) for i in range(3)]
    pages += [(u,) for h in ("bad", "good", "new", "sub.bad") for u in (f"http://{h}.shop.com/it/1", f"http://{h}.shop.com/it/2")]
    return [(i, u) for i, (u,) in enumerate(pages)]


def test_the_rules_outcomes_block_a_host(spark, tmp_path):
    spark.createDataFrame(planted(), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op9_host_reputation(spark, str(tmp_path))
    free = {(r["host"], r["verdict"]) for r in got.collect() if r["rule"] is None}
    assert {("bad.shop.com", "block"), ("good.shop.com", "allow"), ("new.shop.com", "allow"), ("worse.evil.co.uk", "allow")} <= free and ("bad.shop.com", "allow") not in free
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(urls.OP9_SQL)
    assert rows([d[0] for d in want.description], want.fetchall()) == rows(got.columns, [tuple(r) for r in got.collect()])


def test_labelled_outcomes_of_the_caller(spark):
    """Hosts of a bad domain nobody labelled are blocked by their domain's prior; a good host of it isn't."""
    seen = [(f"h{h}.evil.net", 1) for h in range(20) for _ in range(30)] + [(f"h{h}.kind.net", 0) for h in range(40) for _ in range(30)] + [("odd.evil.net", 0)] * 200
    outcomes = spark.createDataFrame(seen, "_u_host string, _u_blocked int")
    pages = spark.createDataFrame([(1, "http://h3.evil.net/a"), (2, "http://odd.evil.net/a"), (3, "http://h3.kind.net/a"), (4, "http://far.kind.net/a"), (5, "http://fresh.evil.net/"), (6, "http://org.org/x")], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, outcomes=outcomes).collect()}
    assert [got[i]["_u_verdict"] for i in range(1, 5)] == ["block", "allow", "allow", "allow"] and got[6]["_u_rule"] == "org/"
    assert max(got[3]["_u_bound"], got[4]["_u_bound"]) < got[5]["_u_bound"] < got[1]["_u_bound"]


def test_clashing_columns_stay(spark):
    d = spark.createDataFrame([(1, "http://a.com/de/1", "h", "p", "r", "v", 0.5)], "page_id long, url string, host string, path string, rule string, verdict string, n double")
    r = urls.judge(d).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"], r["n"]) == ("h", "p", "r", "v", 0.5) and r["_u_verdict"] == "block" and r["_u_host"] == "a.com"
