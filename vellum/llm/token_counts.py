"""Token counts for whole texts, by batch encoding in Arrow functions that return lengths only.

A text is split at its safe boundaries, a space between two other characters: the byte-level splitter never joins across
one, so counts of pieces (each with the space before it) add up. Long texts thus never reach the library whole. A batch's
pieces are told apart in Arrow; those not met before go to the library in batches of about equal bytes.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import map_text, narrow, worker_own
from vellum.llm.cut import Texts

CACHE = 600_000
BATCH_BYTES = 1 << 18


class Counter:
    """Counts tokens with the `tokenizers` library and keeps the counts of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, texts: Texts) -> np.ndarray:
        """The number of tokens of each text."""
        data = texts.data
        white = texts.white() | (data - np.uint8(0x1C) < 4)  # nor is a text cut beside a separator control
        begin = np.zeros(len(data), bool)
        if len(data) > 2:
            begin[1:-1] = (data[1:-1] == 32) & ~white[:-2] & ~white[2:]
        pieces, place, first = texts.parts(begin)
        keys = pieces.to_pylist()
        n = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(n < 0)
        if len(self.known) + len(new) > CACHE:
            self.known = {keys[i]: int(n[i]) for i in np.flatnonzero(n >= 0).tolist()}
        if len(new):
            some = [keys[i] for i in new.tolist()]
            n[new] = self._encode(some)
            self.known.update(zip(some, n[new].tolist(), strict=True))
        total = np.concatenate([[0], np.cumsum(n[place])])
        return np.diff(total[first])

    def _encode(self, pieces: list[str]) -> list[int]:
        """Counts by the library, some BATCH_BYTES at a time; a longer single piece goes alone."""
        ends, out, i = np.cumsum([len(p.encode()) for p in pieces]), [], 0
        while i < len(pieces):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_BYTES, side="right")))
            out += map(len, self.tokenizer.encode_batch_fast(pieces[i:j], add_special_tokens=False))
            i = j
        return out


def counter(path: str) -> Counter:
    """One for each Python worker."""
    return worker_own(("token_counts", path), lambda: Counter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; over_limit: more than `limit` tokens.

    A null or empty text has zero bytes and tokens; repeated rows are kept; other columns are ignored; an empty table
    gives an empty one. Special strings inside texts are the library's special tokens, as is its default.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        n = counter(path).counts(texts)
        size = np.diff(texts.offsets).astype(np.int64)
        return pa.record_batch([part.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = narrow(docs, "doc_id", "text")
    return map_text(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
