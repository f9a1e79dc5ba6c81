"""Prefix trie, filter audit and phrase index against brute force: DuckDB on small odd tables, or plain Python."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import filteraudit, joined, phraseindex, prefixtrie, wordstream
from millrace.llm.queries import ORACLES, QUERIES


def compare(name, spark, folder, tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    rows = QUERIES[name](spark, str(folder)).select(names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, found.fetchall()))
    return rows


def trie_by_hand(rows):
    """Nodes of rebuilt conversations, by dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0], t[1], t[2], t[3][:64], hashlib.sha256(t[3].encode()).hexdigest()))
    sequences = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        sequences[c] = tuple((t[2], t[3]) for t in own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    below = {s: [] for s in members}
    for s in members:
        for d in range(len(s) + 1):
            below[s[:d]].append(s)
    children = {s: sum(len(x) == len(s) + 1 for x in below[s]) for s in members}
    out = []
    for s, cs in members.items():
        ends = sorted(c for c in cs if len(sequences[c]) == len(s))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[s] if x)
        parent = min(members[s[:-1]]) if s else None
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(cs), len(s), parent, len(cs), children[s], sum(children[x] == 0 for x in below[s]), saved, sha))
    return sorted(map(repr, out))


CONVERSATIONS = "conv_id long, turn long, role string, text string, place string, n int, key string"


def conversations(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, "x", 1, None) for r in rows], CONVERSATIONS)
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted(repr(tuple(r)) for r in QUERIES["op11_prefix_trie"](spark, str(tmp_path)).collect())


def test_trie_of_odd_conversations(spark, tmp_path):
    draw = random.Random(5)
    rows = [(c, t, draw.choice("ab"), draw.choice(["", "é", "long " * 9])) for c in range(1, 160) for t in range(draw.randint(1, 6)) if c % 10]
    rows += [(c, t, "u", "same") for c in range(1000, 1300) for t in range(9)]  # a large group of copies
    rows += [(2000, None, "u", "null turn"), (2000, 1, None, "x"), (2000, 1, "", "x"), (2000, 1, "a", None), (2000, 1, "a", "y" * 70), (None, 1, "u", "no conversation")]
    rows += [(2001, 5, "u", "tie"), (2001, 5, "u", "tie"), (2001, 5, "u", "a tie"), (2003, 1, None, None)]
    rows += [(3000, 1, "u", "é" * 100_000), (3001, 1, "u", "é" * 100_000)]
    assert conversations(spark, tmp_path, rows) == trie_by_hand(rows)


def test_trie_of_long_conversations(spark, tmp_path):
    rows = []
    for i, (same, length) in enumerate([(31, 40), (32, 40), (32, 32), (33, 33), (33, 70), (64, 64), (64, 65), (65, 200), (65, 65), (200, 200), (200, 201), (199, 300)]):
        for c in (5 * i, 5 * i + 1, 5 * i + 3):
            rows += [(c, t, "u", f"t{t % 7}" if t < same else f"t{i} {t}") for t in range(length)]
    rows += [(1001, t, "u", f"t{t % 7}") for t in range(100)]
    assert conversations(spark, tmp_path, rows) == trie_by_hand(rows)


def test_trie_across_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefixtrie, "ROWS", 5)  # ranges of about five rows: nearly every node crosses a border
    draw = random.Random(6)
    rows = [(c, t, "u", draw.choice("xy")) for c in range(100) for t in range(draw.choice([1, 3, 12, 40]))]
    assert conversations(spark, tmp_path, rows) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_one(spark, tmp_path):
    assert conversations(spark, tmp_path / "none", []) == []
    assert conversations(spark, tmp_path / "one", [(7, 1, "u", "x")]) == trie_by_hand([(7, 1, "u", "x")])


def test_joined_sha256_of_a_large_group(spark):
    rows = spark.range(30_000).select((F.col("id") % 30_000 > 20).cast("int").alias("g"), (F.col("id") - 100).alias("v"))
    found = joined.joined_sha256(rows.select(F.unhex(F.hex("g")).alias("group"), joined.sortable(F.col("v")).alias("order"), F.col("v").cast("string").alias("value")))
    found = {r["n"]: r["sha256"] for r in found.collect()}
    for n, values in ((21, range(-100, -79)), (29_979, range(-79, 29_900))):
        assert found[n] == hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, bits int, hash string, id int"
WORDS = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, WORDS, "a"), (2, WORDS, "a"), (2, WORDS, "a"), (3, WORDS, None), (None, WORDS, "b"), (None, WORDS, "b"), (4, None, "a"), (5, "", ""), (None, None, "a"),
    (6, "x " * 80, "a"), (7, "x\x1f\x0b\x0cy \t" * 40, "c"), (8, "ABC é" * 30, "c"), (9, WORDS + " 5 %", "b"), (10, "é" * 1000 + "A" * 50, "c"), (11, "é" * 1000 + "A" * 53, "c"),
    (12, "word " * 300_000, "d"), (13, "word " * 300_000, "d"), (14, "z" * 2_500_000 + " q", "d"), (15, " ".join(map(str, range(300_000))) + " | ", "d"),
]


def documents(spark, tmp_path, rows):
    frame = spark.createDataFrame([(i, t, "en", s, None, 9, "h", 9) for i, t, s in rows], DOCUMENTS)
    frame.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))


def test_audit_of_odd_documents(spark, tmp_path):
    documents(spark, tmp_path, ODD + [(100 + i, "copy of a text " * 20, "hot") for i in range(400)])
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (9, 1, 1), (777, 1, 1), (400, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = compare("op12_filter_audit", spark, tmp_path, ("documents", "labels"))
    assert len(rows) == 600 * 6
    hot = {(r["filter_order"], r["step"]): r for r in rows if r["part"] == "hot"}
    assert hot["EABCD", 1]["removed"] == 399 and hot["EABCD", 1]["kept"] == 1


def test_audit_of_nothing(spark, tmp_path):
    documents(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert QUERIES["op12_filter_audit"](spark, str(tmp_path)).count() == 0


def test_failures_keep_every_row(spark, tmp_path):
    documents(spark, tmp_path, ODD)
    failed = filteraudit.failures(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert failed.agg(F.sum("n")).first()[0] == len(ODD)
    copies = {r["id"] for r in failed.where("bits & 16 = 16").collect()}
    assert copies == {2, 3, 5, 13, None}


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
def test_words_do_not_depend_on_stretches(stretch, monkeypatch):
    monkeypatch.setattr(wordstream, "STRETCH", stretch)
    texts = ["", "ab cd", "cd", "x" * 200, None, "é1 É-e\n", " ", "ab", "A" * 100 + " b " + "c" * 90, ""]
    column = pa.array(["skip", *[t or "" for t in texts]]).slice(1)
    found = [[] for _ in texts]
    ended = 0
    for row, hashes, ended in wordstream.Texts(column).words(phraseindex.IS_WORD, lowered=True):
        for r, h in zip(row, hashes):
            found[r].append(int(h))
    assert ended == len(texts)
    number = {}
    named = [[number.setdefault(h, len(number)) for h in row] for row in found]
    assert named == [[], [0, 1], [1], [2], [], [3, 4, 5], [], [0], [6, 7, 8], []]


ITEMS = [(1, " ".join(f"p{i}" for i in range(25))), (2, " ".join(f"p{i}" for i in range(15))), (2, "Alpha beta GAMMA"), (3, "alpha beta gamma"), (None, "lonely item words"),
         (4, None), (5, "..."), (10, "the the the the the the the the the the the"), (11, " ".join(f"p{i}" for i in range(5, 30)))]


def test_phrases_in_odd_documents(spark, tmp_path):
    p = [f"p{i}" for i in range(40)]
    texts = [
        " ".join(p[:12]), "x " + " ".join(p[2:11]), " ".join(p[:9]) + " x " + p[9], "ALPHA, beta\x00gamma! alpha beta gamma", "alpha beta", "gamma", "the " * 40, "the " * 9, None, "",
        "so a lonely item words é", "y " * 30_000 + "y" * 3_000_000 + " " + " ".join(p), "é" * 400_000, " ".join(p[::-1]), " ".join(p), " ".join(p),
    ]
    documents(spark, tmp_path, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "alpha beta gamma", None), (None, " ".join(p), None), (3, "alpha beta gamma", None)])
    frame = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, group int")
    frame.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = compare("op13_phrase_index", spark, tmp_path, ("documents", "benchmark"))
    assert {(r["n_hit"], r["n_items"]) for r in rows if r["doc_id"] == 10} == {(3, 0)}


def test_phrases_in_blocks_and_without_documents_or_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phraseindex, "PHRASES", 3)
    test_phrases_in_odd_documents(spark, tmp_path / "blocks")
    for name, docs, items in (("a", [], ITEMS), ("b", [(1, "alpha beta gamma", None)], [])):
        documents(spark, tmp_path / name, docs)
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        compare("op13_phrase_index", spark, tmp_path / name, ("documents", "benchmark"))


def test_proximity_matches(spark):
    p = [f"p{i}" for i in range(10)]
    moved = [*p[:4], "x", "y", *p[4:]]
    texts = [p, moved, [*p[:4], "x", "y", "z", *p[4:]], [*p[:3], p[4], p[3], *p[5:]], p[:9], [*p[1:], p[0]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    index = phraseindex.build_index(docs)
    wanted, groups = phraseindex.phrases(spark.createDataFrame([(1, " ".join(p))], "item_id long, text string"))
    found = phraseindex.per_document(index, phraseindex.search(index, wanted, slack=2), groups)
    seen = {r["key"]: (r["n_hit"], r["n_near"] > 0) for r in found.collect()}
    assert seen == {0: (10, False), 1: (0, True), 2: (0, False), 3: (0, True), 4: (0, False), 5: (0, False)}


def test_segments_split_between_documents(monkeypatch):
    monkeypatch.setattr(phraseindex, "SEGMENT", 50)
    monkeypatch.setattr(wordstream, "STRETCH", 64)
    texts = ["a b c " * (i % 9) for i in range(60)] + ["w " * 500, "", "z"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 20, len(texts)))), pa.array(texts[i : i + 20])], ["key", "text"]) for i in range(0, len(texts), 20)]
    rows = [r for b in phraseindex._segments(iter(batches)) for r in b.to_pylist()]
    docs = [r for r in rows if r["term"] is None]
    assert [r["key"] for r in docs] == list(range(len(texts))) and [r["n"] for r in docs] == [len(t.split()) for t in texts]
    assert len({r["segment"] for r in docs}) > 5
    listed = {}
    for r in rows:
        if r["term"] is not None:
            for place in np.frombuffer(r["positions"], "<i4"):
                assert listed.setdefault((r["segment"], int(place)), r["term"]) == r["term"]
    for r in docs:
        own = [listed.pop((r["segment"], r["base"] + i)) for i in range(r["n"])]
        assert len(set(own)) == len(set(texts[r["key"]].split()))
    assert not listed
