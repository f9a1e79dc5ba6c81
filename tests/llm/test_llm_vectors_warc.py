"""Vector searches and WARC archives against brute force."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import permutation, pivotdistance, warc
from millrace.llm.components import components
from millrace.session import shared_path

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # copies: ties
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [NAN] * 8), (2003, [None] * 8), (2004, [INF] + [1.0] * 7), (2005, [])]
    rows += [(60, rows[60][1]), (2010, [1e-9] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))


def valid(vectors, zero):
    rows = {}
    for r in vectors.collect():
        v = r["embedding"]
        if v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            rows[r["vec_id"]] = np.array(v)
    return rows


def test_neighbours(vectors):
    rows = valid(vectors, zero=False)
    found = permutation.neighbours(vectors, F.col("id") % 20 == 0, k=7, pivots=32, prefix=16, share=1.0).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == {i for i in rows if i % 20 == 0}
    for q, got in by_query.items():
        want = sorted((np.sqrt(((rows[i] - rows[q]) ** 2).sum()), i) for i in rows if i != q)[:7]
        assert [g[0] for g in got] == list(range(1, 8))
        assert [g[1] for g in got] == [i for _, i in want]
        assert [g[2] for g in got] == pytest.approx([d for d, _ in want])


def test_recall_with_production_parameters(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = permutation.neighbours(df, F.col("id") % 100 == 0).collect()
    hits = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = INF
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * len(found) and len(found) == 600


@pytest.mark.parametrize("scale", [64, 1 << 50])
def test_top_products(vectors, scale):
    rows = {i: [int(np.floor(scale * x)) for x in v] for i, v in valid(vectors, zero=True).items()}
    if scale > 64:
        rows = {i: v for i, v in rows.items() if i < 30}
        vectors = vectors.where("vec_id < 30").withColumn("embedding", F.transform("embedding", lambda v: v / 2**25))
        rows = {r["vec_id"]: [int(np.floor(scale * x)) for x in r["embedding"]] for r in vectors.collect()}
    found = pivotdistance.top_products(vectors, F.col("id") % 15 == 0, k=9, scale=scale, pivots=5).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert set(by_query) == {i for i in rows if i % 15 == 0}
    for q, got in by_query.items():
        assert got == sorted((-sum(a * b for a, b in zip(rows[i], rows[q])), i) for i in rows if i != q)[:9]


def test_annuli_are_skipped_and_exact():
    rng = np.random.default_rng(5)
    centre = rng.integers(-40, 40, (8, 6)) * 10
    x = (centre[rng.integers(0, 8, 4000)] + rng.integers(-3, 4, (4000, 6))).astype(float)
    ids = np.arange(4000)
    places, scores = pivotdistance.largest(x, x[:50], ids, ids[:50], 20, 16)
    for q in range(50):
        s = x @ x[q]
        s[q] = -INF
        want = np.lexsort((ids, -s))[:20]
        assert (places[q] == want).all() and (scores[q] == s[want]).all()


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], kind)
    every = F.col("id") >= 0
    assert permutation.neighbours(two, every).count() == 2 and pivotdistance.top_products(two, every).count() == 2
    none = spark.createDataFrame([], kind)
    assert permutation.neighbours(none, every).count() == 0 and pivotdistance.top_products(none, every).count() == 0


def test_vectors_of_each_length_are_searched(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(i, rng.normal(size=3).tolist()) for i in range(40, 50)]
    rows += [(60, [1.0] * 7), (61, [2.0, 3.0]), (0, [9.0])]  # alone; the vector of 0 that sorts first counts
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = {}
    for i, v in rows:
        once[i] = min(once.get(i, v), v)
    every = F.col("id") >= 0
    near = permutation.neighbours(df, every, k=3, pivots=8, prefix=4, share=1.0).collect()
    top = pivotdistance.top_products(df, every, k=3, pivots=4).collect()
    for found, score in ((near, lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))), (top, lambda a, b: -sum(np.floor(64 * x) * np.floor(64 * y) for x, y in zip(a, b)))):
        for q, v in once.items():
            want = sorted((score(v, w), i) for i, w in once.items() if i != q and len(w) == len(v))[:3]
            assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in want]


def test_warc_null_keys(spark):
    rows = [(1, "http://h/1", "a"), (None, "http://h/2", "a"), (None, "http://h/3", "b"), (None, None, "b"), (None, "http://h/4", None), (2, "u", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    assert records.count() == 18 and records.select("record_id").distinct().count() == 18
    captures = warc.assemble(records).collect()
    assert len(captures) == 6 and all(r["request"] and r["metadata"] for r in captures)
    found = {r["response"]["target_uri"]: (r["metadata"]["fields"].get("capture"), r["response"]) for r in captures}
    assert {u: k for u, (k, _) in found.items()} == {u: None if i is None else str(i) for i, u, _ in rows}
    answers = {u: a for u, (_, a) in found.items()}
    assert answers["http://h/2"]["type"] == "revisit" and answers["http://h/2"]["refers_to"] == "<urn:capture:1:response>"
    assert answers["http://h/4"]["type"] == "response" and bytes(answers["http://h/4"]["payload"]) == b""
    twins = [answers["http://h/3"], answers[None]]
    one, other = sorted(twins, key=lambda a: a["type"])
    assert (one["type"], bytes(one["payload"]), other["type"], other["refers_to"]) == ("response", b"b", "revisit", one["record_id"])


def test_warc_round_trip(spark):
    tricky = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc é 日\n\r\n\r\n"
    rows = [(i, f"http://h.example/{i} x\n", f"body {i % 4}") for i in range(12)]
    rows += [(20, None, tricky), (21, "http://h.example", tricky), (22, "x", None), (23, "y", ""), (24, "z", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit(1))
    path = shared_path(spark, "warc")
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path)
    assert records.groupBy("type").count().collect() and records.count() == 3 * len(rows)
    captures = {int(r["metadata"]["fields"]["capture"]): r for r in warc.assemble(records).collect()}
    assert set(captures) == {r[0] for r in rows}
    first = {}
    for i, url, html in sorted(rows, key=lambda r: r[0]):
        data, r = (html or "").encode(), captures[i]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["response"]["payload_digest"] == f"sha1:{digest}"
        assert r["metadata"]["fields"]["payload-bytes"] == str(len(data))
        assert r["request"]["headers"].startswith("GET /") and r["request"]["concurrent_to"] == r["record_id"]
        if data in first:
            assert r["response"]["type"] == "revisit" and r["response"]["refers_to"] == f"<urn:capture:{first[data]}:response>"
        else:
            first[data] = i
            assert r["response"]["type"] == "response" and bytes(r["response"]["payload"]) == data
        want = None if url is None else url.replace("\n", "%0A").replace(" ", "%20")
        assert r["response"]["target_uri"] == want


def test_warc_smaller_payloads_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbbbb"), (4, "u", "bbbbbb")], "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    warc.write_warc(pages, path, least=5)
    kinds = {r["record_id"]: r["type"] for r in warc.read_warc(spark, path).collect() if r["type"] in ("response", "revisit")}
    assert [kinds[f"<urn:capture:{i}:response>"] for i in range(1, 5)] == ["response", "response", "response", "revisit"]
    path = shared_path(spark, "warc")
    warc.write_warc(pages.where("page_id < 0"), path)
    assert warc.assemble(warc.read_warc(spark, path)).count() == 0


def test_warc_files_of_long_payloads_hold_fewer_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 1_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 48)
    sizes = [10] * 40 + [3_000] * 20 + [40_000] * 6 + [700_000] * 3
    pages = spark.createDataFrame([(i, f"http://h/{i}", chr(97 + i % 26) * (n + i)) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    path = shared_path(spark, "warc")
    warc.write_warc(pages.coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    lengths = [[(r[1], len(r[9])) for r in warc._parse(warc._plain(bytes(f[0])))] for f in files]
    assert sorted(n for f in lengths for kind, n in f if kind == "response") == sorted(n + i for i, n in enumerate(sizes))
    for least, most in ((1_000, 6), (8_000, 3)):
        assert all(len(f) <= most for f in lengths if max(n for _, n in f) > least)
    captures = warc.assemble(warc.payload_sha1(warc.read_warc(spark, path)))
    assert sorted(r[0] for r in captures.select("response.payload_bytes").collect()) == sorted(n + i for i, n in enumerate(sizes))


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_warc_archives_are_read_piece_by_piece(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    records = [
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
        for i, body in enumerate(["", "a\r\n\r\nWARC/1.1\r\n", "b" * 5_000])
    ]
    plain = b"".join(records)
    for data in (plain, gzip.compress(plain), b"".join(map(gzip.compress, records)), gzip.compress(plain) + b"\0" * 64):
        found = list(warc._parse(warc._plain(data)))
        assert [(r[0], r[1], len(r[9])) for r in found] == [("<0>", "resource", 0), ("<1>", "resource", 15), ("<2>", "resource", 5_000)]
    assert list(warc._parse(warc._plain(b""))) == []
    for broken in (plain[:-100], gzip.compress(plain[:50]), b"no archive\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc._parse(warc._plain(broken)))
    monkeypatch.setattr(warc, "BATCH_BYTES", 100)
    assert [len(b) for b in warc._batches(iter(found))] == [3] and [len(b) for b in warc._batches(iter(found * 2))] == [3, 3]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    links += [(5, 5), (None, 3)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    found = components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    assert {r["id"]: r["label"] for r in found} == {i: find(i) for i in list(parent)}
    assert len(found) == len(parent)
