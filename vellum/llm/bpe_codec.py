"""BPE encoding and decoding of whole texts by the tokenization automaton of `bpe`."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.bpe import Encoder, Speller, encoder
from vellum.llm.common import map_text, narrow


def _speller(e: Encoder) -> Speller:
    if not hasattr(e, "speller"):
        e.speller = Speller(e.automaton.labels)
    return e.speller


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): every row's ids and what they decode to.

    A null or empty text has no ids and decodes to the empty string; repeated rows are kept; other columns are ignored;
    an empty table gives an empty one. Decoding joins the labels of the automaton's arcs, special tokens included.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        ids, first = e.ids(part.column("text"))
        speller, out = _speller(e), [b""] * part.num_rows
        for i, x in speller.spans(speller.labels, ids, first):
            out[i] += bytes(x)
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.record_batch([part.column("doc_id"), lists, pa.array([x.decode() for x in out], pa.string())], ["doc_id", "ids", "decoded"])

    docs = narrow(docs, "doc_id", "text")
    return map_text(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode_decode gives, made where the ids are so that neither leaves the task."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        ids, first = e.ids(part.column("text"))
        speller, columns = _speller(e), []
        for column in (speller.numbers, speller.labels):
            made = [hashlib.sha256() for _ in range(part.num_rows)]
            for i, x in speller.spans(column, ids, first):
                made[i].update(x)
            columns.append(pa.array([m.hexdigest() for m in made], pa.string()))
        return pa.record_batch([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = narrow(docs, "doc_id", "text")
    return map_text(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
