import datetime
import sys
from collections import Counter
from pathlib import Path

import pytest
from llm_rows import doc
from oracle import compare, connect
from pyspark.sql import functions as F

from treemend.llm.queries import ORACLES, QUERIES
from treemend.llm.urls import filter_urls, host_of, keys_of, path_of, validity

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


@pytest.mark.parametrize("url, host, keys", [
    (None, "", []), ("", "", []), ("no url", "", []), ("http://A.b.C/x/y//z/w?q#f", "a.b.c", ["a.b.c", "b.c", "a.b.c/x", "a.b.c/x/y", "a.b.c/x/y/z"]),
    ("https://user:pw@Host.org:8080", "host.org", ["host.org"]), ("ftp://localhost/", "localhost", ["localhost"]), ("https://x.com./p", "x.com", ["x.com", "x.com/p"]),
    ("https://x.com?u=http://y.com/a", "x.com", ["x.com"]),
])
def test_keys(spark, url, host, keys):
    df = spark.createDataFrame([(url,)], "url string").withColumn("h", host_of(F.col("url")))
    r = df.select("h", keys_of(F.col("h"), F.coalesce(path_of(F.col("url")), F.lit(""))).alias("k")).first()
    assert r["h"] == host and sorted(r["k"]) == sorted(keys)


LOG = [
    ("bad.com", "spam", 10, "add"), ("bad.com", "spam", 20, "drop"), ("bad.com", "spam", 30, "add"), ("bad.com", "spam", 31, "add"), ("x.org/p", None, 0, "add"),
    ("x.org/p", None, 0, "drop"), ("y.net", "old", 5, "drop"), ("Y.net", "old", 400, "add"), (None, "spam", 1, "add"), ("bad.com", "adult", 15, "add"), ("z.com", "spam", 3, "add"), ("z.com", "spam", 3, "add"),
]


def test_intervals(spark):
    entries = spark.createDataFrame([(k, c, day(d), a, 1) for k, c, d, a in LOG], "key string, category string, day date, action string, n_hits int")
    got = {(r["key"], r["category"], r["valid_from"], r["valid_to"]) for r in validity(entries).collect()}
    end = datetime.date(9999, 12, 31)
    assert got == {("bad.com", "spam", day(10), day(20)), ("bad.com", "spam", day(30), end), ("bad.com", "adult", day(15), end), ("y.net", "old", day(400), end), ("z.com", "spam", day(3), end)}


def test_captures_as_of_their_day(spark):
    entries = spark.createDataFrame([(k, c, day(d), a) for k, c, d, a in LOG], "key string, category string, day date, action string")
    rows = [(f"http://www.bad.com/{d}", day(d)) for d in (0, 9, 10, 14, 15, 19, 20, 29, 30, 300)] + [("http://bad.com/0", day(12))] * 3
    rows += [("http://y.net", day(399)), ("http://y.net", day(400)), (None, day(1)), ("http://z.com", None), ("nonsense", day(5)), ("http://notbad.com", day(12)), ("http://x.org/p", day(1))]
    captures = spark.createDataFrame([(i, u, d, "r", 5) for i, (u, d) in enumerate(rows)], "page_id long, url string, fetched date, reasons string, key int")
    got = {r["row"]["page_id"]: (r["reasons"], r["n_hits"], r["blocked"]) for r in filter_urls(captures, entries).collect()}
    active = lambda d: [s for s, on in (("adult:bad.com", d >= 15), ("spam:bad.com", 10 <= d < 20 or d >= 30)) if on]
    for i, (u, d) in enumerate(rows):
        want = active((d - day(0)).days) if u and d and ("www.bad.com" in u or "//bad.com" in u) else ["old:y.net"] if u == "http://y.net" and d == day(400) else []
        assert got[i] == (",".join(want), len(want), bool(want)), (u, d)
    assert filter_urls(captures.limit(0), entries).count() == 0 and filter_urls(captures, entries.limit(0)).where("blocked").count() == 0


def test_list_keys_with_capitals_and_long_paths(spark):
    keys = ["Example.com/News", "a.org/1/2/3/4/5", "a.org/1/2/3/4/5/6/7", "B.net"]
    entries = spark.createDataFrame([(k, "c", day(0), "add") for k in keys], "key string, category string, day date, action string")
    urls = {
        "http://EXAMPLE.com/News/x": ["c:example.com/News"], "http://example.com/news": [], "http://a.org/1/2/3/4/5?q": ["c:a.org/1/2/3/4/5"], "http://a.org/1/2/3/4": [],
        "http://a.org/1/2/3/4/5/6/7/8/9": ["c:a.org/1/2/3/4/5", "c:a.org/1/2/3/4/5/6/7"], "http://b.net/a/b/c/d": ["c:b.net"],
    }
    captures = spark.createDataFrame([(u, day(1)) for u in urls], "url string, fetched date")
    assert {r["row"]["url"]: r["reasons"] for r in filter_urls(captures, entries).collect()} == {u: ",".join(w) for u, w in urls.items()}
    hosts = filter_urls(captures, entries.where("key = 'B.net'"))
    assert {r["row"]["url"] for r in hosts.where("blocked").collect()} == {"http://b.net/a/b/c/d"}
    # one key, whichever way its host is written
    log = spark.createDataFrame([("X.com/Ab", "c", day(1), "add"), ("x.com/Ab", "c", day(5), "drop"), ("x.com/ab", "c", day(2), "add")], entries.schema)
    got = {(r["key"], r["valid_from"], r["valid_to"]) for r in validity(log).collect()}
    assert got == {("x.com/Ab", day(1), day(5)), ("x.com/ab", day(2), datetime.date(9999, 12, 31))}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, QUERIES[name], ORACLES[name]) is None


def test_pages_are_judged(spark):
    got = QUERIES["op8_url_filters"](spark, "/root/testdata/sf0.01")
    assert got.count() == 250 and 0 < got.where("blocked").count() < 250


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mix", "packing"]


def test_stages_of_an_empty_table(spark, docs, tmp_path):
    empty = docs([])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, empty, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns), name


def test_pipeline_stage_by_stage(spark, docs, tmp_path):
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    secret = "here token = 0b96a8c8d79c4a5085c919698889f59b72ab7bb6 and " + " ".join(reversed(real[0][1].split()))
    rows = [*real, doc(9001, None), doc(9002, "12345 !!"), doc(9003, ""), doc(9004, real[0][1]), doc(9005, secret), doc(9005, secret), doc(None, real[1][1])]
    kept = [docs(rows)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(k.columns == kept[0].columns for k in kept[1:5])
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert {9001, 9002, 9003} & ids[1] == set() and len(ids[1] & {r[0] for r in real}) >= 198
    assert 9004 not in ids[2] and None not in ids[2] and {0, 9005} <= ids[2] and kept[2].where("doc_id = 9005").count() == 1
    assert kept[3].count() == kept[2].count() and kept[3].where("text LIKE '%0b96a8c8d79c4a50%'").count() == 0
    assert kept[3].where("text LIKE '%[secret]%'").count() >= 1
    words = F.sum(F.size(F.split(F.trim("text"), r"\s+")))
    assert abs(kept[4].agg(words).first()[0] / kept[3].agg(words).first()[0] - 1) < 0.05
    pieces = Counter(r["doc_id"] for r in kept[5].where("piece = 0").collect())
    assert pieces == Counter(r["doc_id"] for r in kept[4].collect())
    assert kept[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_pipeline_runs_on_a_folder(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 150
