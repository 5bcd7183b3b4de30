"""Revisits against a brute-force as-of search and DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, sql, warc

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://User@WWW.Example.com:80/A/b/?b=2&utm_source=x&a=1&&ref=z#top", "example.com/A/b?a=1&b=2&ref=z"),
        ("https://a.com:443/x?fbclid=1", "a.com/x"),
        ("https://a.com:80/x", "a.com:80/x"),
        ("http://a.com:443/x", "a.com:443/x"),
        ("https://example.com", "example.com"),
        ("https://example.com/?", "example.com"),
        ("https://m.example.com:8080/x?gclid", "m.example.com:8080/x"),
        ("No Scheme", "no scheme"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(warc.canonical_url(F.col("url"))).first()[0] == want


def brute(records):
    out = []
    for i, kind, url, at, headers in records:
        status = response = None
        if kind == "revisit":
            earlier = [(a, j, h) for j, k, u, a, h in records if k == "response" and u is not None and u == url and at is not None and a is not None and a < at]
            status = "missing"
            if earlier:
                _, j, theirs = max(earlier, key=lambda x: x[:2])
                mine, theirs = headers or {}, theirs or {}
                same = None
                for name in ("etag", "last-modified", "warc-payload-digest"):
                    if mine.get(name) is not None and theirs.get(name) is not None:
                        same = mine[name].removeprefix("W/") == theirs[name].removeprefix("W/") if name == "etag" else mine[name] == theirs[name]
                        break
                status = "unverified" if same is None else "resolved" if same else "changed"
                if same:
                    response = j
                    headers = theirs | {k: v for k, v in mine.items() if k in warc.PERMITTED}
        out.append((i, status or "", response or -1, sorted((headers or {}).items())))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_as_of(spark, block):
    draw = random.Random(block)
    records = []
    for i in range(400):
        url = draw.choice([None, "hot", "hot", "hot", *(f"u{k}" for k in range(30))])
        headers = draw.choice([None, {}, {"etag": draw.choice(["a", "W/a", "b"]), "x": str(i), "date": str(i)}, {"last-modified": draw.choice("mn"), "vary": str(i)}, {"warc-payload-digest": draw.choice("st")}])
        records.append((i, draw.choice(["response", "revisit", "request"]), url, draw.choice([None, *range(60)]), headers))
    df = spark.createDataFrame([(*r, "x") for r in records], "record_id long, kind string, url string, at long, headers map<string,string>, status string")
    made = sorted((r.record_id, r.status or "", -1 if r.response_id is None else r.response_id, sorted((r.headers or {}).items())) for r in warc.resolve_revisits(df, block).collect())
    want = [(i, s, r if s == "resolved" else -1, h) for i, s, r, h in brute([(i + 1, *r) for i, *r in records])]
    assert [(i + 1, s, r + 1 if r >= 0 else -1, h) for i, s, r, h in made] == want
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_query_is_the_sql(spark):
    pages = duckdb.read_parquet(f"{SF}/pages.parquet")  # noqa: F841
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    made = queries.op9_warc(spark, SF)
    want = duckdb.sql(sql.OP9)
    assert made.columns == want.columns
    rows = [tuple(r) for r in made.collect()]
    assert sorted(map(key, rows)) == sorted(map(key, want.fetchall()))
    assert {r[4] for r in rows} == {None, "resolved", "changed", "unverified", "missing"}
