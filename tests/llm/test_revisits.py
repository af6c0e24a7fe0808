import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import revisits as RV

SCHEMA = ("record_id long, kind string, url string, ts long, headers array<struct<name:string,value:string>>, payload_digest string, "
          "key string, full int")
KEPT = set(RV.KEPT)


def get(headers, name):
    return next((v for n, v in headers or [] if n is not None and n.lower() == name), None)


def naive(rows, canon):
    out = []
    for i, kind, url, ts, heads, digest, *_ in rows:
        if kind != "revisit":
            continue
        old = [r for r in rows if r[1] == "response" and url is not None and ts is not None and r[3] is not None and r[2] is not None
               and canon[r[2]] == canon[url] and r[3] < ts]
        ref = max(old, key=lambda r: (r[3], r[0])) if old else None
        verdict = "no_earlier"
        if ref:
            weak = lambda x: x and x.removeprefix("W/")
            for name, a, b in (("etag", weak(get(heads, "etag")), weak(get(ref[4], "etag"))),
                               ("last_modified", get(heads, "last-modified"), get(ref[4], "last-modified")), ("digest", digest, ref[5])):
                if a is not None and b is not None:
                    verdict = name if a == b else "mismatch"
                    break
            else:
                verdict = "unchecked"
        fits = verdict in ("etag", "last_modified", "digest")
        merged = None
        if fits:
            new = [(n, v) for n, v in heads or [] if n is not None and n.lower() not in KEPT]
            names = {n.lower() for n, _ in new}
            merged = tuple([h for h in ref[4] or [] if h[0] is None or h[0].lower() not in names] + new)
        out.append((i, canon.get(url), verdict, ref[0] if fits else None, ref[5] if fits else None, merged))
    return sorted(out, key=repr)


URLS = {"http://www.A.com:80/x/": "a.com/x", "https://a.com/x#t": "a.com/x", "http://u:p@a.com/x?utm_source=q&ref=2": "a.com/x",
        "https://b.org/?b=2&a=1": "b.org?a=1&b=2", "http://b.org?a=1&b=2&": "b.org?a=1&b=2", "not a url": "not a url", " https://b.org:443 ": "b.org",
        "HTTPS://b.org/": "b.org", "http://a.com/X": "a.com/X", "": "", "http://": ""}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, None]], "url string")
    assert {r["url"]: r["c"] for r in df.select("url", RV.canonical_url(F.col("url")).alias("c")).collect()} == {**URLS, None: None}


def corpus(seed, n=300, hot=0.4):
    rng = random.Random(seed)
    urls = list(URLS)
    tags = ['"1"', 'W/"1"', '"2"', None]
    rows = []
    for i in range(n):
        heads = [(n_, v) for n_, v in (("ETag", rng.choice(tags)), ("last-Modified", rng.choice(["m", "n", None])), ("Content-Length", "9"),
                                       (rng.choice(["X-a", "x-A"]), str(i)), ("Connection", "close")) if v is not None]
        rng.shuffle(heads)
        rows.append((i, rng.choice(["response", "revisit"]), urls[0] if rng.random() < hot else rng.choice([*urls, None]),
                     rng.choice([rng.randrange(40), rng.randrange(1000), None]), rng.choice([heads, heads, heads, None, []]),
                     rng.choice(["d", "e", None]), "x", 5))
    return rows + [rows[5], (n, "metadata", urls[0], 1, [], None, "x", 5), (n + 1, "revisit", urls[1], 2000, [(None, "q"), ("E", None)], "d", "x", 5),
                   (n + 2, "response", urls[1], 1999, [(None, "z"), ("e", "1")], "d", "x", 5)]


@pytest.mark.parametrize("seed, hot_rows", [(1, 10**6), (2, 10), (3, 1), (4, 60)])
def test_against_brute_force(spark, seed, hot_rows):
    rows = corpus(seed)
    got = RV.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3), hot_rows).collect()
    assert sorted(((r["id"], r["key"], r["verdict"], r["response"], r["payload_digest"],
                    None if r["headers"] is None else tuple(map(tuple, r["headers"]))) for r in got), key=repr) == naive(rows, URLS)


def test_hot_url_is_cut(spark):
    """A URL with most rows: no window group has more rows than a few segments' worth."""
    rows = [(i, "response" if i % 50 == 0 else "revisit", "http://a.com/x", i, [("ETag", '"1"')], None, "x", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r["response"] for r in RV.resolve(df, 100).collect()}
    assert got == {i: (i - 1) // 50 * 50 for i in range(3000) if i % 50}


def test_empty_tables(spark):
    assert RV.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert RV.resolve(RV.archive_of(pages)).count() == 0


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "http://a.com", None), (None, "http://a.com", "y"), (3, "http://a.com/", "z" * 100_000)],
                                  "page_id long, url string, html string")
    got = RV.resolve(RV.archive_of(pages)).collect()
    assert len(got) == 4
