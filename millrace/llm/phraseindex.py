"""Benchmark decontamination by a distributed positional inverted index.

1. ``build_index``: every task turns its documents into segments of bounded size. A segment stores, for each term (64-bit hash of a word), the sorted
   list of its positions, and one row per document with the position of its first word. The index is a plain table; building it shuffles nothing.
2. ``phrases``: the runs of ``width`` words of the benchmark items, each distinct one once, with the group of items that hold it.
3. ``search``: for every segment the lists of the phrases' terms are brought together. A phrase starts from its rarest term there: the positions of that
   term less its offset are candidate starts, which are intersected with the offset-adjusted lists of the next rarer terms in turn. A start that every list
   confirms is an exact match; one that every list confirms within ``slack`` words is a proximity match.
4. ``per_document``: words hit and the items found, for every document of the index.

Phrases are a query set that is set against all segments in blocks of at most ``PHRASES`` on average; only such a block is ever sent to the tasks, whatever the benchmark's
size. A segment has ``SEGMENT`` words, or one document if that is longer. Nothing else is gathered: lists of a frequent term are spread over all segments.

Defined results: words are runs of 0-9, a-z (A-Z taken so) and characters beyond ASCII. Null and empty texts have no word and no hit. An item of fewer than
``width`` words is one phrase; one without a word is none. Items with a null id hit words but are not counted or listed; items that repeat an id are one.
Documents keep one row each, also where ids repeat or are null. Matches never cross documents. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.joined import joined_sha256
from millrace.llm.wordstream import Texts
from millrace.session import cut_lineage

WIDTH = 10
SLACK = 2
GAP = 16  # positions that stay free between documents
SEGMENT = 1 << 21  # words
PHRASES = 100_000  # in a block
CANDIDATES = 1 << 21  # starts looked up together
ROWS = 50_000  # of an Arrow batch
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``values[cuts[i]:cuts[i + 1]]`` as little-endian 32-bit numbers."""
    values = np.ascontiguousarray(values[cuts[0] : cuts[-1]], "<i4")
    offsets = ((cuts - cuts[0]) * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


class _Segment:
    """Documents and words that are gathered until they make a segment."""

    def __init__(self, number: int, kind: pa.DataType):
        self.number, self.kind = number, kind
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.words = 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate([np.empty(0, np.int64), *self.counts])
        hashes = np.concatenate([np.empty(0, np.uint64), *self.hashes])
        at = np.cumsum(counts + GAP) - counts - GAP  # of the first word
        keys = pa.concat_arrays([k.cast(self.kind) for k in self.keys]) if self.keys else pa.array([], self.kind)
        for i in range(0, len(counts), ROWS):
            n = len(counts[i : i + ROWS])
            ordinal = pa.array(np.arange(i, i + n), pa.int64())
            yield self._batch(n, key=keys.slice(i, n), ordinal=ordinal, n=pa.array(counts[i : i + n]), base=pa.array(at[i : i + n]))
        order = np.argsort(hashes, kind="stable")
        place = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(len(hashes))
        hashes, place = hashes[order], place[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        cuts = np.append(np.flatnonzero(new), len(hashes))
        terms = hashes[cuts[:-1]].view(np.int64)
        for i in range(0, len(terms), ROWS):
            part = cuts[i : i + ROWS + 1]
            yield self._batch(len(part) - 1, term=pa.array(terms[i : i + ROWS]), n=pa.array(np.diff(part)), positions=_lists(place, part))

    def _batch(self, size: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"key": self.kind, "ordinal": pa.int64(), "base": pa.int64(), "n": pa.int64(), "term": pa.int64(), "positions": pa.binary()}
        segment = pa.array(np.full(size, self.number, np.int64))
        made = [columns[c] if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()]
        return pa.RecordBatch.from_arrays([segment, *made], ["segment", *kinds])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 24
    segment = None
    for batch in batches:
        texts, keys = Texts(batch.column(1)), batch.column(0)
        segment = segment or _Segment(number, keys.type)
        done = 0  # rows of the batch that are in the segment as a whole
        counts = np.zeros(len(texts), np.int64)
        for row, hashes, ended in texts.words(IS_WORD, lowered=True):
            if len(row):
                counts[row[0] : row[-1] + 1] += np.bincount(row - row[0])
                segment.hashes.append(hashes)
                segment.words += len(hashes)
            if segment.words >= SEGMENT and ended > done and not counts[ended:].any():  # not inside a text
                segment.keys.append(keys.slice(done, ended - done))
                segment.counts.append(counts[done:ended])
                yield from segment.rows()
                number, done = number + 1, ended
                segment = _Segment(number, keys.type)
        segment.keys.append(keys.slice(done))
        segment.counts.append(counts[done:])
    if segment is not None:
        yield from segment.rows()


def build_index(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of all words of all texts, as a table in shared storage.

    Rows with a ``term`` hold ``n`` ``positions``; those without describe a document: ``ordinal`` in its segment, ``base`` (position of its first word), ``n`` words, ``key``.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(_segments, f"segment long, key {kind}, ordinal long, base long, n long, term long, positions binary"))


def phrases(items: DataFrame, text: str = "text", key: str = "item_id", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The distinct phrases (``terms``, ``group``, ``block``) and what their groups stand for (``group``, ``item``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = [h for _, h, _ in Texts(batch.column(1).slice(i, 1)).words(IS_WORD, lowered=True)]
                words = np.concatenate([np.empty(0, np.uint64), *words]).view(np.int64)
                if not len(words):
                    continue
                n = min(width, len(words))
                runs = np.lib.stride_tricks.sliding_window_view(words, n)
                for at in range(0, len(runs), ROWS):
                    part = np.unique(runs[at : at + ROWS], axis=0)
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * n)
                    terms = pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))
                    item = pa.array([batch.column(0)[i].as_py()] * len(part), pa.string())
                    yield pa.RecordBatch.from_arrays([item, terms], ["item", "terms"])

    rows = items.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = cut_lineage(rows.mapInArrow(cut, "item string, terms array<bigint>").distinct())
    members = F.xxhash64("item").cast("decimal(38,0)")
    found = pairs.groupBy("terms").agg(F.xxhash64(F.sum(F.when(F.col("item").isNotNull(), members)), F.count("item")).alias("group"))
    blocks = -(-pairs.select("terms").distinct().count() // PHRASES) or 1
    found = cut_lineage(found.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks))))
    one = found.groupBy("group").agg(F.min("terms").alias("terms"))  # the same items hold all phrases of a group
    return found, cut_lineage(pairs.where("item IS NOT NULL").join(one, "terms").select("group", "item"))


def _runs(rows: np.ndarray) -> np.ndarray:
    """Unions of the (ordinal, group, near, start, end) rows that touch."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
    # ends grow with the starts but for short phrases; a running maximum within the like rows settles those
    ends = rows[:, 4].copy()
    part = np.concatenate(([0], np.cumsum(~same)))
    high = np.maximum.accumulate(ends + part * (1 << 32)) - part * (1 << 32)
    new = np.ones(len(rows), bool)
    new[1:] = ~same | (rows[1:, 3] > high[:-1])
    at = np.flatnonzero(new)
    out = rows[at].copy()
    out[:, 4] = np.maximum.reduceat(ends, at)
    return out


class _Lists:
    """The position lists of a segment: ``keys`` has term number and position of each word, sorted."""

    def __init__(self, vocabulary: np.ndarray, terms: np.ndarray, positions: list[bytes]):
        at = np.searchsorted(vocabulary, terms)
        order = np.argsort(at)
        lists = [np.frombuffer(positions[i], "<i4").astype(np.int64) for i in order]
        self.counts = np.zeros(len(vocabulary), np.int64)
        self.counts[at[order]] = [len(x) for x in lists]
        self.first = np.cumsum(self.counts) - self.counts
        self.places = np.concatenate([np.empty(0, np.int64), *lists])
        self.keys = (np.repeat(np.arange(len(vocabulary)), self.counts) << 32) + self.places

    def nearest(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of ``term`` has a position from ``low`` to ``high``."""
        at = np.searchsorted(self.keys, (term << 32) + low)
        found = at < len(self.keys)
        found[found] = self.keys[at[found]] <= ((term << 32) + high)[found]
        return found & (low <= high)


def _match(lists: _Lists, words: np.ndarray, lengths: np.ndarray, base: np.ndarray, size: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrase, document, start and whether it is a proximity match, for each match. ``words``: term numbers of the phrases, beyond their length -1."""
    width = words.shape[1]
    counts = np.where(words >= 0, lists.counts[words], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")  # the rarest first
    words, least = np.take_along_axis(words, order, 1), np.take_along_axis(counts, order, 1)[:, 0]
    live = np.flatnonzero(least > 0)
    total = np.cumsum(least[live])
    for low in range(0, int(total[-1]) if len(total) else 0, CANDIDATES):
        part = live[np.searchsorted(total, low, "right") : np.searchsorted(total, low + CANDIDATES, "right")]
        if not len(part):
            continue
        many = least[part]
        phrase = np.repeat(part, many)
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = lists.places[lists.first[words[phrase, 0]] + inner]
        doc = np.searchsorted(base, place, "right") - 1
        start = place - order[phrase, 0]
        near = np.zeros(len(phrase), bool)
        for k in range(1, width):
            term, there = words[phrase, k], start + order[phrase, k]
            first, last = base[doc], base[doc] + size[doc] - 1
            padded = term < 0
            exact = lists.nearest(np.maximum(term, 0), np.maximum(there, first), np.minimum(there, last))
            close = exact if not slack else lists.nearest(np.maximum(term, 0), np.maximum(there - slack, first), np.minimum(there + slack, last))
            near |= ~exact & ~padded
            keep = close | padded
            phrase, doc, start, near = phrase[keep], doc[keep], start[keep], near[keep]
        if len(phrase):
            yield phrase, doc, start, near


MATCHES = "segment long, ordinal long, group long, near boolean, start long, end long"


def search(index: DataFrame, wanted: DataFrame, slack: int = SLACK) -> DataFrame:
    """Where documents match phrases: ``segment`` and ``ordinal`` of the document, ``group`` of items, ``near`` (a proximity match), words ``start`` to ``end`` (exclusive).

    Matches of one group that overlap or touch are one row. ``slack`` 0 looks for exact matches only.
    """
    if not 0 <= slack < GAP:
        raise ValueError(f"slack must be from 0 to {GAP - 1}")
    found = None
    for block in range(wanted.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]):
        one = _search_block(index, wanted.where(F.col("block") == block), slack)
        found = one if found is None else found.union(one)
    return cut_lineage(found if found is not None else index.sparkSession.createDataFrame([], MATCHES))


def _search_block(index: DataFrame, wanted: DataFrame, slack: int) -> DataFrame:
    rows = wanted.select("terms", "group").toArrow()  # about PHRASES at most
    lengths = rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows["terms"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vocabulary, numbers = np.unique(flat, return_inverse=True)
    words = np.full((len(lengths), int(lengths.max(initial=0))), -1, np.int64)
    words[np.arange(words.shape[1]) < lengths[:, None]] = numbers
    groups = rows["group"].to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, words, lengths, groups))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        vocabulary, words, lengths, groups = shared.value
        listed = table.filter(pa.compute.is_valid(table["term"]))
        docs = table.filter(pa.compute.is_null(table["term"])).sort_by("base")
        lists = _Lists(vocabulary, listed["term"].to_numpy(), listed["positions"].to_pylist())
        base, size, ordinal = (docs[c].to_numpy() for c in ("base", "n", "ordinal"))
        made = [np.empty((0, 5), np.int64)]
        for phrase, doc, start, near in _match(lists, words, lengths, base, size, slack):
            low = np.maximum(start - base[doc], 0)
            high = np.minimum(start - base[doc] + lengths[phrase], size[doc])
            made.append(_runs(np.stack([ordinal[doc], groups[phrase], near, low, high], axis=1)))
        ordinals, group, near, start, end = _runs(np.concatenate(made)).T if len(made) > 1 else made[0].T
        columns = [np.full(len(start), key[0].as_py(), np.int64), ordinals, group, near.astype(bool), start, end]
        return pa.table([pa.array(c) for c in columns], names=["segment", "ordinal", "group", "near", "start", "end"])

    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    lists = index.where("term IS NOT NULL").join(F.broadcast(terms), "term", "left_semi")  # terms: those of one block
    columns = ["segment", "ordinal", "base", "n", "term", "positions"]
    return lists.select(columns).union(index.where("term IS NULL AND n > 0").select(columns)).groupBy("segment").applyInArrow(run, MATCHES)


def per_document(index: DataFrame, matches: DataFrame, groups: DataFrame) -> DataFrame:
    """``key``, ``n_words``, ``n_hit``, ``n_near`` (proximity matches), ``n_items``, ``items_sha256`` and ``contaminated`` for each document of the index."""
    doc = ["segment", "ordinal"]
    before = F.max("end").over(Window.partitionBy(*doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    exact = matches.where("NOT near")
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0))))
    hits = exact.withColumn("before", before).groupBy(*doc).agg(F.sum(new).cast("long").alias("n_hit"), F.sort_array(F.collect_set("group")).alias("groups"))
    hits = cut_lineage(hits.withColumn("held", F.unhex(F.sha2(F.concat_ws(",", F.col("groups").cast("array<string>")), 256))))
    kinds = hits.groupBy("held").agg(F.first("groups").alias("groups"))  # documents with the same groups share their items
    items = kinds.select("held", F.explode("groups").alias("group")).join(groups, "group").select("held", "item").distinct()
    listed = joined_sha256(items.select(F.col("held").alias("group"), F.col("item").cast("binary").alias("order"), F.col("item").alias("value")))
    listed = listed.select(F.col("group").alias("held"), F.col("n").alias("n_items"), F.col("sha256").alias("items_sha256"))
    hits = hits.drop("groups").join(listed, "held", "left").drop("held")
    close = matches.where("near").groupBy(*doc).agg(F.count("*").alias("n_near"))
    docs = index.where("term IS NULL").select(*doc, "key", F.col("n").alias("n_words"))
    out = docs.join(hits, doc, "left").join(close, doc, "left")
    return out.select(
        "key",
        "n_words",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_near", "n_items")],
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
