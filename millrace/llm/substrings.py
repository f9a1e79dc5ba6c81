"""Removal of repeated byte strings across all documents, decided by suffix arrays of what can repeat.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (smaller id, or the same document and an earlier start).

1. *Blocks.* The smallest hashed ``GRAM``-byte string of a window is its anchor. Equal windows have equal anchors at equal places, so
   neighbouring windows with the same anchor form a block that can only repeat where the anchor's string does. About one byte in 32
   starts a block.
2. *Equal blocks share one entry.* Blocks are dealt by the hash of their anchor's string, after each task has put its own
   equal blocks together. All but the first of equal blocks repeat with all their windows. If an anchor has only one distinct block, nothing
   else can repeat.
3. *Suffix arrays.* The distinct blocks of an anchor are cut into cells of ``CELL`` window places; cells with equal common bytes are
   laid end to end, and the suffix array of this text, by linear grouping, puts equal windows next to each other. All but the
   first of them repeat.
4. An anchor with over ``MANY`` distinct blocks is dealt by cell instead, and a cell with over ``MANY`` in parts; the first windows of the parts
   are then compared by one more aggregate.
5. The repeated ranges meet their document, are united, and cut out.

Blocks of one anchor, and cells of one anchor, are told apart by 64-bit hashes, windows by their bytes. Documents travel compressed.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing. Rows with equal id and text count as one document and
get equal results; rows with equal ids and different texts are different documents, in the order of a hash of the text. Documents
without an id follow all ids below 2**62, in the order of a hash of the text. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytetext import mix, powers, prefix_hash, utf8
from millrace.llm.suffixarray import suffix_array
from millrace.session import cut_lineage

GRAM = 32
CELL = 8
MANY = 2_000
CHUNK = 16_000_000  # bytes of text whose blocks are put together in a task
PART = 2_000_000  # bytes of blocks handled at once
STRETCH = 1 << 20  # bytes of a text hashed at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "gram long, span long, doc long, place long, form long"
_BLOCK_NAMES = ["gram", "span", "doc", "place", "form"]


def hashed(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``[start, end)``; equal substrings have equal hashes wherever they lie."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] ^ np.uint64(0xA5A5F00DCAFE1234))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def blocks_of(b: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hash of the anchor's string, hash of the block, first window, windows before the anchor, number of windows.

    Long texts are taken in stretches. The last block of a stretch may go on, so the next stretch begins with it.
    """
    found: list[tuple[np.ndarray, ...]] = []
    begin = 0
    while True:
        stretch = b[begin : begin + STRETCH]
        more = begin + len(stretch) < len(b)
        sums = prefix_hash(stretch)
        at = np.arange(len(stretch) - GRAM + 1)
        gram = hashed(sums, at, at + GRAM)
        keys = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        anchor = (smallest(keys, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(anchor)])) - 1
        if more:
            rest, first, last = first[-1], first[:-1], last[:-1]
        left, windows = anchor[first] - first, last - first + 1
        span = mix(hashed(sums, first, last + length) + (left * 256 + windows).astype(np.uint64) * _STEP)
        found.append((gram[anchor[first]], span, first + begin, left, windows))
        if not more:
            return tuple(np.concatenate(c) for c in zip(*found))
        begin += int(rest)


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of the union; touching ranges become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]


def _documents(df: DataFrame, text: str, key: str) -> DataFrame:
    """``doc``, ``version`` (of the text, for ids that repeat), ``given`` (the id as it came) and ``data``, the compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["doc", "version", "given", "data"])

    return _versions(df, text, key).mapInArrow(run, "doc long, version long, given long, data binary")


def _versions(df: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    given = F.col(key).cast("long")
    nameless = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.lit(4), whole), 2)
    version = F.shiftrightunsigned(F.xxhash64(whole), 33)
    return df.select(F.coalesce(given, nameless).alias("doc"), version.alias("version"), given.alias("given"), whole.alias("text"))


def _deal(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks, of equal ones the first only; ranges of the others have a negative ``form``, their length."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        gram, span, doc, place, form = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, span, gram))
        gram, span, doc, place, form = (x[order] for x in (gram, span, doc, place, form))
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (span[1:] == span[:-1])
        again = same.copy()  # the same place once more is a repeated row
        again[1:] &= (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
        rows = [x[~same] for x in (gram.view(np.int64), span.view(np.int64), doc, place, form)]
        lost = same & ~again
        if lost.any():
            d, s, n = doc[lost], place[lost], form[lost] % 256 + length - 1
            order = np.lexsort((s, d))
            d, s, e = d[order], s[order], (s + n)[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (s[1:] > e[:-1])  # neighbours overlap or touch; a gap or another text starts anew
            at = np.flatnonzero(new)
            stop = np.maximum.reduceat(e, at)
            spread = mix(d[at].astype(np.uint64)).view(np.int64)
            ranges = [spread, np.zeros(len(at), np.int64), d[at], s[at], s[at] - stop]
            rows = [np.concatenate(p) for p in zip(rows, ranges)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], _BLOCK_NAMES)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, version, _, text in zip(*(c.to_pylist() for c in batch.columns)):
            b = utf8(text)
            if len(b) < length:
                continue
            gram, span, first, left, windows = blocks_of(b, length)
            held.append((gram, span, np.full(len(gram), doc), (version << 32) + first, left * 256 + windows))
            size += len(b)
            if size >= CHUNK:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


FOUND = "repeated boolean, gram long, doc long, place long, form long"


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From blocks in (gram, span, doc, place) order: ranges that repeat, and the distinct blocks of grams with more than one.

    Only the last row, and the first block of a gram that has no second one yet, are carried from batch to batch.
    """
    last: tuple | None = None
    pending: tuple | None = None
    for batch in batches:
        gram, span, doc, place, form = (c.to_numpy() for c in batch.columns)
        ranges = form < 0
        out = [(np.ones(ranges.sum(), bool), gram[ranges], doc[ranges], place[ranges], -form[ranges])]
        gram, span, doc, place, form = (x[~ranges] for x in (gram, span, doc, place, form))
        if len(gram):
            before = [np.concatenate(([x[0] if last is None else y], x[:-1])) for x, y in zip((gram, span, doc, place), last or (0,) * 4)]
            new_gram = gram != before[0]
            new_span = new_gram | (span != before[1])
            again = ~new_span & (doc == before[2]) & (place == before[3])
            if last is None:
                new_gram[0] = new_span[0] = True
                again[0] = False
            lost = ~new_span & ~again
            out.append((np.ones(lost.sum(), bool), gram[lost], doc[lost], place[lost], form[lost] % 256 + length - 1))
            at = np.flatnonzero(new_span)
            if len(at):
                opens = new_gram[at]
                if pending is not None and not opens[0]:
                    out.append(tuple(np.array([x]) for x in (False, *pending)))
                several = np.append(~opens[1:], False) | ~opens
                keep = at[several]
                out.append((np.zeros(len(keep), bool), gram[keep], doc[keep], place[keep], form[keep]))
                end = at[-1]
                pending = (gram[end], doc[end], place[end], form[end]) if opens[-1] else None
            last = (gram[-1], span[-1], doc[-1], place[-1])
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["repeated", "gram", "doc", "place", "form"])


SPANS = "gram long, doc long, place long, form long, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the blocks of each document."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, version, data, blocks in zip(*(c.to_pylist() for c in batch.columns)):
            text = unpack.decompress(data)
            for block in blocks:
                start = block["place"] & 0xFFFFFFFF
                rows.append((block["gram"], doc, block["place"], block["form"], text[start : start + block["form"] % 256 + length - 1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.binary()])],
            ["gram", "doc", "place", "form", "bytes"],
        )


def cells_of(grams: np.ndarray, forms: np.ndarray, spans: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Cells of many blocks at once: block, hash of the cell's common bytes, hash of all its bytes, first window, windows."""
    sizes = np.array([len(s) for s in spans])
    begin = np.cumsum(sizes) - sizes
    sums = prefix_hash(np.frombuffer(b"".join(spans), np.uint8))
    left, windows = forms // 256, forms % 256
    block = np.repeat(np.arange(len(spans)), windows)
    window = np.arange(len(block)) - np.repeat(np.cumsum(windows) - windows, windows)
    cell = (left[block] - window) // CELL
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(block)))
    block, window, cell = block[at], window[at], cell[at]
    # every window of a cell covers the bytes from its last place to the end of the window at its first place
    anchor = begin[block] + left[block]
    common = hashed(sums, anchor - cell * CELL, anchor - cell * CELL - CELL + 1 + length)
    common = mix(common + grams[block].astype(np.uint64) * _STEP + cell.astype(np.uint64))
    whole = mix(hashed(sums, begin[block] + window, begin[block] + window + count - 1 + length) + count.astype(np.uint64) + (window - left[block]).astype(np.uint64) * _STEP)
    return block, common, whole, window, count


def repeated_windows(spans: list[bytes], length: int, order: list[tuple]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(span, window) of the windows with an earlier equal one, and of the earliest of every kind.

    The spans are laid end to end with a separator above all bytes; in their suffix array equal windows follow each other.
    """
    text: list[int] = []
    owner: dict[int, tuple[int, int]] = {}
    for i, span in enumerate(spans):
        owner.update((len(text) + w, (i, w)) for w in range(len(span) - length + 1))
        text += [*span, 256]
    repeated, firsts = [], []
    run: list[tuple[int, int]] = []
    shown: bytes | None = None

    def close() -> None:
        if run:
            run.sort(key=lambda x: (order[x[0]][0], order[x[0]][1] + x[1]))
            firsts.append(run[0])
            repeated.extend(run[1:])

    for start in suffix_array(text):
        if start in owner:
            i, w = owner[start]
            window = spans[i][w : w + length]
            if window != shown:
                close()
                run, shown = [], window
            run.append((i, w))
    close()
    return repeated, firsts


SOLVED = "doc long, place long, size long, bytes binary"


def _solve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated ranges inside each ``task`` (rows of a task follow each other); of ``open`` tasks also the first windows."""

    def work(rows: list[tuple]) -> list[tuple]:
        _, grams, docs, places, forms, spans, opened = (list(c) for c in zip(*rows))
        block, common, whole, window, count = cells_of(np.array(grams), np.array(forms), spans, length)
        task = np.unique([r[0] for r in rows], return_inverse=True)[1]
        doc, place = np.array(docs)[block], np.array(places)[block] + window
        order = np.lexsort((place, doc, whole, common, task[block]))
        key = np.column_stack((task[block][order].astype(np.uint64), common[order]))
        new_cell = np.ones(len(order), bool)
        new_cell[1:] = (key[1:] != key[:-1]).any(axis=1)
        new_text = new_cell.copy()
        new_text[1:] |= whole[order][1:] != whole[order][:-1]
        out = [(doc[i], place[i], count[i] + length - 1, None) for i in order[~new_text]]
        kinds = np.add.reduceat(new_text, np.flatnonzero(new_cell))
        texts = order[new_text]
        at = 0
        for n in kinds:
            own = texts[at : at + n]
            at += n
            if n > 1 or opened[block[own[0]]]:
                parts = [spans[block[i]][window[i] : window[i] + count[i] - 1 + length] for i in own]
                places_of = [(doc[i], place[i]) for i in own]
                repeated, firsts = repeated_windows(parts, length, places_of)
                out += [(places_of[i][0], places_of[i][1] + w, length, None) for i, w in repeated]
                if opened[block[own[0]]]:
                    out += [(places_of[i][0], places_of[i][1] + w, length, parts[i][w : w + length]) for i, w in firsts]
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["doc", "place", "size", "bytes"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= PART and row[0] != held[-1][0]:
                yield batch_of(work(held))
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield batch_of(work(held))


def _solved(spans: DataFrame, length: int) -> DataFrame:
    dealt = spans.repartition("task").sortWithinPartitions("task").select("task", *SPANS.replace(" long", "").replace(" binary", "").split(", "), "open")
    return cut_lineage(dealt.mapInArrow(lambda batches: _solve(batches, length), SOLVED))


def _to_cells(spans: DataFrame, length: int) -> DataFrame:
    """The cells of blocks as blocks of their own, with the hash of their common bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, doc, place, form = (c.to_numpy() for c in batch.columns[:4])
            texts = batch.column(4).to_pylist()
            if not texts:
                continue
            block, common, _, window, count = cells_of(gram, form, texts, length)
            parts = [texts[b][w : w + n - 1 + length] for b, w, n in zip(block, window, count)]
            left = form[block] // 256 - window  # may lie before the cell's first window, which cells_of allows for
            rows = [common.view(np.int64), doc[block], place[block] + window, left * 256 + count]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(parts, pa.binary())], ["gram", "doc", "place", "form", "bytes"])

    return spans.select("gram", "doc", "place", "form", "bytes").mapInArrow(run, SPANS)


def _ranges(spans: DataFrame, length: int, many: int) -> DataFrame:
    """``doc``, ``place`` and ``size`` of the repeated ranges among distinct blocks."""
    counted = cut_lineage(spans.groupBy("gram").agg(F.count("*").alias("n")))  # tables, so that hot keys of the joins can be split
    if counted.where(F.col("n") > many).isEmpty():
        return _solved(spans.select("*", F.col("gram").alias("task"), F.lit(False).alias("open")), length).select("doc", "place", "size")
    spans = cut_lineage(spans.join(counted, "gram"))
    few = spans.where(F.col("n") <= many).select("*", F.col("gram").alias("task"), F.lit(False).alias("open"))
    cells = cut_lineage(_to_cells(spans.where(F.col("n") > many), length))
    sizes = cut_lineage(cells.groupBy("gram").agg(F.count("*").alias("n")))
    cells = cells.join(sizes, "gram").where("n > 1")
    parts = F.ceil(F.col("n") / many)
    cells = cells.withColumn("open", parts > 1)
    cells = cells.withColumn("task", F.xxhash64("gram", F.pmod(F.xxhash64("doc", "place"), parts)))
    names = ["gram", "doc", "place", "form", "bytes", "task", "open"]
    solved = _solved(few.select(names).union(cells.select(names)), length)
    firsts = solved.where("bytes IS NOT NULL")
    least = firsts.groupBy("bytes").agg(F.min(F.struct("doc", "place")).alias("least"))
    later = firsts.join(least, "bytes").where(F.struct("doc", "place") > F.col("least"))
    return solved.where("bytes IS NULL").select("doc", "place", "size").union(later.select("doc", "place", "size"))


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100, many: int = MANY) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the remaining bytes) of every row.

    Intermediate tables are written to shared storage while the result is being built.
    """
    if not GRAM + CELL <= length <= GRAM + 200:
        raise ValueError(f"length must lie between {GRAM + CELL} and {GRAM + 200}")
    blocks = _versions(df, text, key).mapInArrow(lambda batches: _deal(batches, length), BLOCKS)
    blocks = blocks.repartition("gram").sortWithinPartitions("gram", "span", "doc", "place")
    found = cut_lineage(blocks.mapInArrow(lambda batches: _compare(batches, length), FOUND))
    documents = _documents(df, text, key)
    version = F.shiftright("place", 32).alias("version")
    wanted = found.where("NOT repeated").groupBy("doc", version).agg(F.collect_list(F.struct("gram", "place", "form")).alias("blocks"))
    joined = documents.dropDuplicates(["doc", "version"]).join(wanted.hint("merge"), ["doc", "version"])
    spans = joined.select("doc", "version", "data", "blocks").mapInArrow(lambda batches: _cut_out(batches, length), SPANS)
    ranges = _ranges(cut_lineage(spans), length, many)
    ranges = ranges.union(found.where("repeated").select("doc", "place", F.col("form").alias("size")))
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start")
    by_doc = ranges.groupBy("doc", version).agg(F.collect_list(F.struct(start, "size")).alias("ranges"))
    whole = documents.join(by_doc.hint("merge"), ["doc", "version"], "left").select("given", "data", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, data, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpack.decompress(data)
                starts = np.array([r["start"] for r in ranges or ()], np.int64)
                starts, ends = united(starts, starts + np.array([r["size"] for r in ranges or ()], np.int64))
                kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
                rows.append((doc, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return whole.mapInArrow(cut, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
