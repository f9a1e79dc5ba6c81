"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

1. Every text becomes its set of word shingles and a SuperMinHash signature. Texts with equal sets are one class from here
   on, under a number of its own; its text is that of one of its rows.
2. Signatures are cut into bands. Classes that share a band are tied to the smallest number of that bucket; the ties' components
   (*families*) hold every pair that the bands bring together, without a pair being written out.
3. Each family is dealt to tasks in blocks of bounded size. A task holds one or two blocks of full sets, and unites classes
   whose sets are close enough; only uniting links leave the task. A family of one block is finished by one task. A larger one first meets its first block; what is then outside its largest component meets every
   block.
4. Links are made into components by rounds of minimum labels, each written to shared storage.

A link with similarity ``s`` is missed by the bands with probability ``(1 - s**rows)**bands`` (2e-5 at 0.8 and the
default numbers); every link found is exact, and within a family all pairs count, banded or not.

Defined results: null and word-free texts have no shingle, are linked with nothing and kept. Repeated and null ids count as one
row each, and share their component only if their texts link. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytetext import mix, shingle_set
from millrace.llm.components import components
from millrace.session import cut_lineage

BANDS, ROWS = 36, 6
BLOCK = 1_500_000  # shingles in a block
FLAT = 1 << 16  # shingles whose signatures are made together
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set; empty sets get zeros.

    Element ``e`` draws a permutation of the slots by Fisher-Yates and offers ``j + r`` to its ``j``-th slot, ``r``
    uniform below one. Step ``j`` is made for the elements of all sets at once. A slot that was offered something at an earlier
    step cannot be improved, so a set stops as soon as all its slots have an offer.
    """
    out = np.full((len(sets), size), np.iinfo(np.uint64).max, np.uint64)
    lengths = np.array([len(s) for s in sets])
    out[lengths == 0] = 0
    if not lengths.sum():
        return out
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    open_slots = np.ones((len(sets), size), bool)
    open_slots[lengths == 0] = False
    order: np.ndarray | None = None  # of the slots, per element; made when a second step is needed
    first: np.ndarray | None = None
    for j in range(size):
        draw = mix(element + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        k = j + ((draw >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = first = k
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.int16), (len(element), 1))
                at = np.arange(len(element))
                order[at, first], order[:, 0] = 0, first
            at = np.arange(len(element))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
            order[:, j] = slot
        offer = (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        flat = owner * size + slot
        ok = open_slots.ravel()[flat]
        np.minimum.at(out.ravel(), flat[ok], offer[ok])
        open_slots.ravel()[flat] = False
        alive = open_slots.any(axis=1)[owner]
        if not alive.any():
            break
        if not alive.all():
            element, owner = element[alive], owner[alive]
            order = order[alive] if order is not None else None
            first = first[alive]
    return out


def identity(text: str = "text", key: str = "doc_id") -> Column:
    """Digest of a row's id, which may be null, and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def sketch(df: DataFrame, text: str, key: str, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``id``, ``mark`` (see ``identity``), ``n`` (set size), ``same`` (128 bits that equal sets share) and ``bands`` (hashes, empty for no words)."""
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, identities, texts = batch.columns
            sets, at = [], 0
            kept: list = []
            for value in texts.to_pylist():
                sets.append(shingle_set(value, width))
                at += len(sets[-1])
                if at >= FLAT:
                    kept.append(_rows(sets, bands, rows, size))
                    sets, at = [], 0
            kept.append(_rows(sets, bands, rows, size))
            n, same, keys = (sum((k[i] for k in kept), []) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [ids, identities, pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "mark", "n", "same", "bands"],
            )

    picked = df.select(F.col(key).cast("long").alias("id"), identity(text, key).alias("mark"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "id long, mark binary, n long, same binary, bands array<long>")


def _rows(sets: list[np.ndarray], bands: int, rows: int, size: int) -> tuple[list, list, list]:
    if not sets:
        return [], [], []
    marks = signatures(sets, size).reshape(len(sets), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))  # so that bands don't share keys
    for r in range(rows):
        keys = mix(keys * _STEP + marks[:, :, r])
    n = [len(s) for s in sets]
    same = [
        np.array([len(s), mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + _STEP)) if len(s) else 0], np.uint64).tobytes()
        for s in sets
    ]
    return n, same, [k.view(np.int64) if c else [] for k, c in zip(keys, n)]


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` (it is that id), one row per input row.

    Two texts link if their sets' intersection is at least ``percent`` hundredths of their union. A null id is that of a component without
    any other. Intermediate tables are written to shared storage while the result is being built.
    """
    found = grouped(df, text, key, width, percent, bands, rows, block)
    kept = F.col("component_id").eqNullSafe(F.col("id")).alias("kept")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", kept)


def grouped(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """``id``, ``mark``, ``n``, ``component`` and ``component_id`` of every row.

    ``component`` is a number that only the rows of one component share, whatever their ids; null where ``n`` is 0.
    """
    marks = cut_lineage(sketch(df, text, key, width, bands, rows))
    classes = marks.where("n > 0").groupBy("same")
    classes = classes.agg(F.min("mark").alias("mark"), F.min("id").alias("least"), F.min("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes.withColumn("rep", F.monotonically_increasing_id()))
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("m")).where("m > 1")
    ties = banded.join(centres, "bucket").where("rep <> centre").select("rep", "centre").distinct()
    families = cut_lineage(components(cut_lineage(ties), "rep", "centre").withColumnRenamed("label", "family"))
    # a text once, however many rows repeat it under one id or without one
    texts = df.select(identity(text, key).alias("mark"), F.col(text).alias("text")).dropDuplicates(["mark"])
    links = _verified(texts, classes, families, width, percent, block)
    found = components(links, "a", "b").select(F.col("id").alias("rep"), F.col("label").alias("component"))
    found = cut_lineage(found.join(classes.select("rep", "least"), "rep"))
    names = cut_lineage(found.groupBy("component").agg(F.min("least").alias("name")))
    found = cut_lineage(found.join(names, "component").select("rep", "component", "name"))
    by_class = classes.select("same", "rep", "least").join(found, "rep", "left")
    by_class = by_class.select("same", F.coalesce("component", "rep").alias("component"), F.coalesce("name", "least").alias("name"))
    out = marks.select("id", "mark", "n", "same").join(by_class, "same", "left")
    component_id = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id"))
    return out.select("id", "mark", "n", F.when(F.col("n") > 0, F.col("component")).alias("component"), component_id.alias("component_id"))


def unite(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join all sets linked directly or through others; pairs that share a label already are not compared.

    One set at a time is compared with all sets of other labels, always one from outside the largest component, until of
    each pair of differing labels at least one set has been compared with everything.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    done = np.zeros(len(sets), bool)
    mask = np.zeros(len(names), bool)
    links = []
    while True:
        groups, counts = np.unique(labels, return_counts=True)
        left = np.flatnonzero(~done & (labels != groups[np.argmax(counts)]))
        if not len(left):
            return links
        i = left[0]
        done[i] = True
        near = (labels != labels[i]) & (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes)
        to = np.flatnonzero(near)
        if not len(to):
            continue
        mask[flat[starts[i] : ends[i]]] = True
        if len(to) <= 32:
            shared = np.array([np.count_nonzero(mask[flat[starts[t] : ends[t]]]) for t in to])
        else:
            running = np.concatenate(([0], np.cumsum(mask[flat])))
            shared = running[ends[to]] - running[starts[to]]
        mask[flat[starts[i] : ends[i]]] = False
        for t in to[100 * shared >= percent * (sizes[i] + sizes[to] - shared)]:
            if labels[t] != labels[i]:
                links.append((int(i), int(t)))
                labels[labels == labels[t]] = labels[i]


def _unite_blocks(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """Links found inside each ``task``; ``label`` holds what is known to be one component. A task's rows follow each other."""

    def links_of(ids: list[int], labels: list[int], texts: list[str]) -> list[tuple[int, int]]:
        unique = {i: (label, t) for i, label, t in zip(ids, labels, texts)}  # a set can come with both blocks
        if len(unique) < 2:
            return []
        order = sorted(unique)
        sets = [shingle_set(unique[i][1], width) for i in order]
        known = np.unique([unique[i][0] for i in order], return_inverse=True)[1]
        return [(order[x], order[y]) for x, y in unite(sets, known, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, labels, texts = None, [], [], []
        for batch in batches:
            found = []
            for t, i, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task:
                    found += links_of(ids, labels, texts)
                    task, ids, labels, texts = t, [], [], []
                ids.append(i), labels.append(label), texts.append(text)
            yield _pairs(found)
        yield _pairs(links_of(ids, labels, texts))

    dealt = dealt.repartition("task").sortWithinPartitions("task").select("task", "rep", "label", "text")
    return dealt.mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([p[at] for p in found], pa.int64()) for at in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _verified(texts: DataFrame, classes: DataFrame, families: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links on full sets that make every family's components whole."""
    members = families.withColumnRenamed("id", "rep").join(classes.select("rep", "mark", "n"), "rep")
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    members = members.join(blocks, "family")
    members = cut_lineage(members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    texts = texts.hint("merge")  # one plan at every size: texts are dealt by mark, never sent to all
    meets = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = members.select("rep", "mark", F.col("rep").alias("label"), "family", F.explode(meets).alias("with"))
    dealt = dealt.select("rep", "mark", "label", F.struct("family", F.lit(0).alias("of"), "with").alias("task"))
    links = cut_lineage(_unite_blocks(dealt.join(texts, "mark"), width, percent))
    if members.where("blocks > 1").isEmpty():
        return links
    found = components(links, "a", "b")
    large = members.where("blocks > 1").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    large = cut_lineage(large.withColumn("label", F.coalesce("label", "rep")))
    by_label = large.groupBy("family", "label").agg(F.sum("n").alias("n"))
    main = by_label.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = large.join(main, "family").where("label <> main").drop("main")
    parts = rest.groupBy("family").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    rest = rest.join(parts, "family").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("parts")).cast("int"))
    rest = rest.select("rep", "mark", "label", "family", F.col("part").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    whole = large.join(parts, "family").select(
        "rep", "mark", "label", "family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of"), F.col("block").alias("with")
    )
    dealt = rest.union(whole).select("rep", "mark", "label", F.struct("family", "of", "with").alias("task")).distinct()
    return links.union(cut_lineage(_unite_blocks(dealt.join(texts, "mark"), width, percent)))
