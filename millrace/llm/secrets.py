"""Secret scans: fixed patterns, and formats learned from the credentials that these find.

*Base* spans are those of three fixed patterns. The strings they find are labelled credentials; from a bounded sample of each
kind a probabilistic automaton is inferred by state merging, and one from ordinary long words. Every run of
``CANDIDATE`` characters that lies in no base span is then scored: it is a ``format`` span if some kind's automaton gives it a likelihood
like that of the kind's own sample, and at least ``margin`` bits a symbol more than the words' automaton does. If a run with dots is
none, its parts between the dots are scored.

Spans are code points ``[start, end)`` of the whole text. Defined results: a null or empty text has no span; texts are scanned each on its
own, so repeated rows get equal spans; without a labelled credential there are base spans only. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.automata import Automaton, infer
from millrace.session import cut_lineage

KINDS = ("assign", "access", "hex", "format")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # a run shorter than 16 fails anyhow
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")  # what a labelled credential can be
PART = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
DIGIT = re.compile(rb"[0-9]")
ORDINARY = "word"

Span = tuple[str, int, int]


@dataclass(frozen=True)
class Formats:
    """Automata by kind with the least likelihood that counts, and the automaton of ordinary words."""

    kinds: list[tuple[str, Automaton, float]]
    words: Automaton | None
    margin: float

    def fits(self, token: str) -> bool:
        best = max((bits for _, a, least in self.kinds if (bits := a.bits(token)) >= least), default=None)
        return best is not None and (self.words is None or best - self.words.bits(token) >= self.margin)


def base_spans(data: bytes) -> list[tuple[str, int, int, bytes]]:
    """Kind, byte offsets and credential of the fixed patterns' matches."""
    found = []
    low = data.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(data) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(data) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(data)]
    return found


def outside(start: int, end: int, base: list[tuple[str, int, int, bytes]]) -> bool:
    """Whether some of ``[start, end)`` is in no base span."""
    return not any(s <= start and end <= e for _, s, e, _ in base)


def format_spans(data: bytes, base: list[tuple[str, int, int, bytes]], fits: Callable[[str], bool]) -> Iterator[tuple[str, int, int]]:
    for m in CANDIDATE.finditer(data):
        start, end = m.span()
        if outside(start, end, base):
            if fits(m[0].decode("ascii")):
                yield "format", start, end
            elif b"." in m[0]:
                for p in PART.finditer(data, start, end):
                    if outside(*p.span(), base) and fits(p[0].decode("ascii")):
                        yield "format", *p.span()


def spans_of(text: str | None, formats: Formats | None) -> list[Span]:
    """All spans by start, then kind as listed in ``KINDS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    base = base_spans(data)
    found = [(k, s, e) for k, s, e, _ in base]
    if formats and formats.kinds:
        found += format_spans(data, base, formats.fits)
    if found and len(data) != len(text):
        inner = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)  # bytes that start no code point
        found = [(k, s - int(inner[s]), e - int(inner[e - 1])) for k, s, e in found]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def learn(
    df: DataFrame, text: str = "text", sample_per_kind: int = 300, alpha: float = 0.05, margin: float = 1.0, slack: float = 0.25, seed: int = 17
) -> Formats:
    """Infer the formats from the labelled credentials of ``df``.

    All rows are scanned; of the distinct credentials of each kind the ``sample_per_kind`` with the smallest seeded hash
    are learned from. They reach the driver, where the merging runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for value in batch.column(0).to_pylist():
                data = (value or "").encode("utf-8", "surrogatepass")
                base = base_spans(data)
                found.update((k, secret.decode("ascii")) for k, _, _, secret in base)
                # a sixteenth of the long words, by their own hash
                found.update(
                    (ORDINARY, m[0].decode("ascii"))
                    for m in CANDIDATE.finditer(data)
                    if zlib.crc32(m[0]) % 16 == 0 and not DIGIT.search(m[0]) and outside(*m.span(), base)
                )
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "token"])

    labelled = df.select(F.col(text).alias("text")).mapInArrow(run, "kind string, token string").distinct()
    labelled = cut_lineage(labelled)
    order = F.struct(F.xxhash64(F.lit(seed), "token"), F.col("token"))
    sample = {}
    for kind in (*KINDS[:3], ORDINARY):
        rows = labelled.where(F.col("kind") == kind).orderBy(order).limit(sample_per_kind).collect()
        sample[kind] = [r["token"] for r in rows]
    kinds = []
    for kind in KINDS:
        if sample.get(kind):
            automaton = infer(sample[kind], alpha)
            least = float(np.quantile([automaton.bits(t) for t in sample[kind]], 0.05)) - slack
            kinds.append((kind, automaton, least))
    words = infer(sample[ORDINARY], alpha) if sample.get(ORDINARY) else None
    return Formats(kinds, words, margin)


def scan(df: DataFrame, formats: Formats, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``spans`` (kind, start, end) of every row, in one pass without a shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, formats)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [key, "spans"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def redact(df: DataFrame, formats: Formats, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """All rows and columns, with every span (overlapping ones as one) replaced by ``mask`` in ``text``."""
    at = df.columns.index(text)

    def masked(value: str | None) -> str | None:
        spans = spans_of(value, formats)
        if not spans:
            return value
        out, done = [], 0
        for _, start, end in spans:
            if start >= done:
                out += [value[done:start], mask]
            done = max(done, end)
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([masked(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, StructType(df.schema.fields))

