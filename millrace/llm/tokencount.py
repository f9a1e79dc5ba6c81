"""Token counts by a whole-token shortcut.

The tokenizer joins pieces only inside a run of blanks followed by other characters, because no vocabulary string has a
blank behind another character. So a text is cut before every run of blanks, and each such pre-token is counted on its own. Offline, every
vocabulary string is encoded once; those that come out as one token are the *whole tokens*. A pre-token among them counts as
one, and only the others are merged by the library, each distinct one once per task while the memory for them lasts.

Defined results: a null or empty text has no token and no byte. Repeated rows get equal counts. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
REMEMBERED = 400_000  # distinct merged pre-tokens kept per task; then the memory starts anew
TEXTS = 256  # texts counted together


@cache
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def cuts_at_blanks(path: str) -> bool:
    """Whether no vocabulary string has a blank behind another character, on which the cutting rests."""
    p = processor(path)
    return not any(BLANK in p.id_to_piece(i).lstrip(BLANK) for i in range(p.get_piece_size()))


@cache
def whole_tokens(path: str) -> dict[str, int]:
    """The pre-tokens, written without their one leading blank, that are proved to encode as one token."""
    p = processor(path)
    words = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    words = [w[1:] for w in words if w.startswith(BLANK) and BLANK not in w[1:] and len(w) > 1]
    return {w: 1 for w, ids in zip(words, p.encode(words, num_threads=1)) if len(ids) == 1}


class Counter:
    """Counts the tokens of texts; ``known`` starts from the whole tokens and learns merged pre-tokens."""

    def __init__(self, path: str):
        if not cuts_at_blanks(path):
            raise ValueError("the vocabulary joins across blanks, so pre-tokens cannot be counted alone")
        self.processor = processor(path)
        self.whole = whole_tokens(path)
        self.known = {**self.whole, "": 1}  # a lone blank is one token
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.blank_led = np.array([p.startswith(BLANK) for p in pieces])

    def learn(self, words: set[str]) -> None:
        """Merge what is not known yet, in one call."""
        if len(self.known) > REMEMBERED:
            self.known = {**self.whole, "": 1}
        new = list(words.difference(self.known))
        if new:  # each starts with the library's blank, by which their tokens are told apart
            lines = [" ".join(new[i : i + 64]) for i in range(0, len(new), 64)]
            ids = np.array(sum(self.processor.encode(lines, num_threads=1), []))
            ends = np.append(np.flatnonzero(self.blank_led[ids]), len(ids))
            self.known.update(zip(new, np.diff(ends).tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[int]:
        split = []
        for text in texts:
            plain = text and "  " not in text and text[0] != " " and BLANK not in text
            split.append(text.split(" ") if plain else None)
        self.learn(set().union(*filter(None, split)))
        get = self.known.__getitem__
        return [sum(map(get, words)) if words else self._with_runs(text) for words, text in zip(split, texts)]

    def _with_runs(self, text: str | None) -> int:
        """A text with runs of blanks: pre-tokens with one blank as above, the others merged with their blanks."""
        if not text:
            return 0
        total, blanks = 0, 1  # the library's own blank in front
        words = text.replace(BLANK, " ").split(" ")
        for at, word in enumerate(words):
            if word == "" and at < len(words) - 1:
                blanks += 1
                continue
            if blanks == 1 and word not in self.known:
                total += len(self.processor.encode(word, num_threads=1))
            elif blanks == 1:
                total += self.known[word]
            else:
                total += len(self.processor.encode(" " * (blanks - 1) + word, num_threads=1))
            blanks = 1
        return total


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    df: DataFrame, text: str = "text", key: str = "doc_id", limit: int = 4096, model_path: str | None = None
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` for every row, in one pass without a shuffle.

    ``model_path`` names a file that every executor has; by default that of the installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path or public_tokenizers.path(MODEL))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = pa.array(sum((counter(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)), []), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], [key, "n_bytes", "n_tokens"])

    rows = df.select(F.col(key), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
