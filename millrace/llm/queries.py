"""Thin queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import filteraudit, language, mixing, packing, permutation, phraseindex, pivotdistance, prefixtrie, secrets, substrings, superminhash, tokencount, warc
from millrace.session import shared_path
from millrace.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs, where=~held_out)
    found = language.identify(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op3_superminhash_dedup")
def op3_superminhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op2_permutation_index")
def op2_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return permutation.neighbours(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


OP7_SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op7_pivot_distance", OP7_SQL)
def op7_pivot_distance(spark: SparkSession, folder: str) -> DataFrame:
    return pivotdistance.top_products(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query("op8_source_mix")
def op8_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


OP10_SQL = """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
    ), d AS (
        SELECT page_id, n,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
                   (CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS g
        FROM p
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY g, n) AS first FROM d)
    SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f"""


@query("op10_warc", OP10_SQL)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    captures = warc.assemble(warc.payload_sha1(warc.read_warc(spark, path)))
    answer, facts = F.col("response"), F.col("metadata.fields")
    revisit = answer["type"] == "revisit"
    keyed = answer["refers_to"].startswith("<urn:capture:")
    return captures.select(
        facts["capture"].cast("long").alias("page_id"),
        F.when(revisit, facts["payload-bytes"].cast("long")).otherwise(answer["payload_bytes"]).alias("payload_bytes"),
        F.when(revisit, F.substring(answer["payload_digest"], 6, 32)).otherwise(answer["payload_sha1"]).alias("payload_digest"),
        answer["type"].alias("record_type"),
        F.regexp_extract(F.when(keyed, answer["refers_to"]), "^<urn:capture:(.*):response>$", 1).cast("long").alias("refers_to"),
    )


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, secrets.learn(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents")).drop("kept")


OP12_SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), least AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
    g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN low < d.doc_id OR low IS NOT NULL AND d.doc_id IS NULL THEN 16 ELSE 0 END AS bits
        FROM d JOIN least USING (t) LEFT JOIN g USING (doc_id)
    ), c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, bits),
    l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bit
        FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
          AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
    ), s AS (
        SELECT filter_order, step, bit[step] AS own, CAST(coalesce(list_sum(bit[1:step - 1]), 0) AS INTEGER) AS before
        FROM o, (SELECT unnest(range(1, 6)) AS step)
    ), r AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
               CAST(sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
               CAST(sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN bits & before <> 0 AND bits & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
               CAST(sum(CASE WHEN bits = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
               CAST(sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
        FROM s, c GROUP BY part, filter_order, step, own, before
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM r"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    failed = filteraudit.failures(table(spark, folder, "documents"))
    return filteraudit.audit(filteraudit.combinations(failed, table(spark, folder, "labels")))


OP13_SQL = r"""
    WITH b AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ), d AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), p AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
    ), s AS (
        SELECT r, n, i, string_agg(v, ' ') OVER a AS g, count(*) OVER a AS held
        FROM (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM p)
        WINDOW a AS (PARTITION BY r, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)
    ), m AS (SELECT r, n, i, item_id FROM s JOIN p USING (n, g) WHERE held = n),
    h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
    t AS (
        SELECT r, count(*) AS n_items, sha256(string_agg(v, ',' ORDER BY v)) AS items_sha256
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS v FROM m WHERE item_id IS NOT NULL) GROUP BY r
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


@query("op13_phrase_index", OP13_SQL)
def op13_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    index = phraseindex.build_index(table(spark, folder, "documents"))
    wanted, groups = phraseindex.phrases(table(spark, folder, "benchmark"))
    found = phraseindex.per_document(index, phraseindex.search(index, wanted), groups)
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP11_SQL = """
    WITH RECURSIVE bit(b, step, crc) AS (
        SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
        UNION ALL SELECT b, step + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM bit WHERE step < 8
    ), crc AS (SELECT list(crc ORDER BY b) AS tab FROM bit WHERE step = 8),
    t AS (
        SELECT conv_id AS c, row_number() OVER (
                   PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), sha256(coalesce(text, ''))) AS p,
               coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL
    ), k AS (
        SELECT c, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)),
                   lambda x, y: xor(x >> 8, tab[CAST(xor(x, y) & 255 AS INTEGER) + 1]))) % 9 AS h
        FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t), crc
    ), u AS (
        SELECT k.c, 0 AS own, t.p, t.role, t.text FROM k JOIN t ON t.c = k.c - k.c % 5 AND t.p <= k.h
        UNION ALL SELECT k.c, 1, t.p, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.p > k.h
    ), v AS (
        SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, sha256(length(role) || ':' || role || text) AS item, octet_length(encode(text)) AS b FROM u
    ), x AS (
        SELECT c, d, b, sha256(string_agg(item, '') OVER (PARTITION BY c ORDER BY d)) AS prefix FROM v
        UNION ALL SELECT c, 0, 0, '' FROM k
    ), len AS (SELECT c, max(d) AS d FROM x GROUP BY c),
    node AS (SELECT d, prefix, min(c) AS c, count(*) AS n, any_value(b) AS b FROM x GROUP BY d, prefix),
    link AS (SELECT DISTINCT x.d, x.prefix, y.prefix AS above FROM x JOIN x y ON x.c = y.c AND y.d = x.d - 1),
    child AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM link GROUP BY d, above),
    full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, prefix)),
    sub AS (
        SELECT x.d, x.prefix, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n - 1) * f.b) AS saved
        FROM full_node f JOIN x ON x.c = f.c AND x.d <= f.d GROUP BY x.d, x.prefix
    ), ends AS (
        SELECT x.d, x.prefix, sha256(string_agg(CAST(x.c AS VARCHAR), ',' ORDER BY x.c)) AS ends FROM x JOIN len USING (c, d) GROUP BY x.d, x.prefix
    )
    SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
           CAST(sub.saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
    FROM full_node f JOIN sub USING (d, prefix) LEFT JOIN ends USING (d, prefix)
    LEFT JOIN link USING (d, prefix) LEFT JOIN node p ON p.d = f.d - 1 AND p.prefix = link.above"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    placed, places = prefixtrie.numbered(table(spark, folder, "conversations"))
    return prefixtrie.trie(prefixtrie.rebuilt(placed, places))
