"""Words of a whole Arrow batch of texts at once, in stretches of bounded size. Used inside tasks only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from millrace.llm.bytetext import LOWER, prefix_hash, substring_hash

STRETCH = 1 << 20  # bytes hashed together; a word longer than that makes its stretch longer


class Texts:
    """The bytes of a batch of texts, end to end. ``cuts`` are the row starts and the end of the last row."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        self.cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, places, "right") - 1

    def stretches(self, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of the data that no word crosses."""
        at, end = int(self.cuts[0]), int(self.cuts[-1])
        while at < end:
            stop = min(at + STRETCH, end)
            if stop < end:
                row = int(self.cuts[np.searchsorted(self.cuts, stop, "right") - 1])  # the last row start up to here
                if row > at:
                    stop = row
                else:  # inside one long row
                    gaps = np.flatnonzero(~is_word[self.data[at:stop]])
                    if len(gaps):
                        stop = at + int(gaps[-1]) + 1
                    else:
                        stop = self._word_end(stop, is_word)
            yield at, stop
            at = stop

    def _word_end(self, at: int, is_word: np.ndarray) -> int:
        last = int(self.cuts[np.searchsorted(self.cuts, at, "right")])
        while at < last:
            gaps = np.flatnonzero(~is_word[self.data[at : min(at + STRETCH, last)]])
            if len(gaps):
                return at + int(gaps[0])
            at = min(at + STRETCH, last)
        return last

    def counts(self, kind: np.ndarray) -> np.ndarray:
        """For every row the bytes that ``kind`` (a table of 256 booleans) marks."""
        total = np.zeros(len(self), np.int64)
        for at in range(int(self.cuts[0]), int(self.cuts[-1]), STRETCH):
            found = np.flatnonzero(kind[self.data[at : min(at + STRETCH, int(self.cuts[-1]))]])
            if len(found):
                rows = self.row_of(found + at)
                total[rows[0] : rows[-1] + 1] += np.bincount(rows - rows[0])
        return total

    def words(self, is_word: np.ndarray, lowered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Row and 64-bit hash of each word (maximal run of bytes that ``is_word`` marks) in order, and the rows that end, a stretch at a time.

        Equal words have equal hashes wherever they lie; ``lowered`` takes A-Z as a-z, so ``is_word`` must mark both alike.
        """
        for at, stop in self.stretches(is_word):
            b = self.data[at:stop]
            if lowered:
                b = LOWER[b]
            inside = is_word[b]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            closes = inside.copy()
            closes[:-1] &= ~inside[1:]
            heads = self.cuts[np.searchsorted(self.cuts, at) : np.searchsorted(self.cuts, stop, "left")] - at
            heads = heads[heads < len(b)]  # words do not cross rows
            opens[heads] |= inside[heads]
            tails = heads[heads > 0] - 1
            closes[tails] |= inside[tails]
            starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            ended = int(np.searchsorted(self.cuts[1:], stop, "right"))
            yield self.row_of(starts + at), substring_hash(prefix_hash(b), starts, ends), ended
