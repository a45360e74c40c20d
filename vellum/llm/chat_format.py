"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the assistant's spans are met with the token
spans by binary search. Control strings inside texts get a backslash after their first character (one more where some
are there already), so that no text can close a turn and every text can be read back.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import worker_own

#: What opens and closes a turn by role; any other role is written out.
BEGIN = "<s>"
TURN = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
_NAMES = r"(?=/?(?:s>|SYS\]|INST\]|OUT\]|ROLE\]|TURN\]))"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _NAMES)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _NAMES)
SLICE = 256


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and where in it each turn's escaped text stands."""
    out, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        body = escape(text)
        head, tail = TURN.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
        out += [head, body, tail]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(tail)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a rendered string."""
    at, out = len(BEGIN), []
    while at < len(formatted):
        for role, (head, tail) in TURN.items():
            if formatted.startswith(head, at):
                break
        else:
            end = formatted.index(OTHER[1].strip(), at)
            role, at = unescape(formatted[at + len(OTHER[0]) : end - 1]), end + len(OTHER[1]) - 1
            head, tail = "", OTHER[2]
        end = formatted.index(tail.strip(), at + len(head))
        out.append((role, unescape(formatted[at + len(head) : end - 1])))
        at = end + len(tail) - 1
    return out


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[dict]]:
    """Which tokens (sorted by place) meet a span, and the characters of each span that tokens cover."""
    on, under = np.zeros(len(starts), bool), []
    for a, b in spans:
        if a < b:
            low, high = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
            on[low:high] = True
            if low < high:
                under.append({"start": max(a, int(starts[low])), "end": min(b, int(ends[high - 1]))})
    return on, under


def tokenizer(path: str):
    """One for each Python worker."""
    return worker_own(("chat_format", path), lambda: _load(path))


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """(conv_id, formatted, ids, loss, under): a row for each conv_id of `rows` (conv_id, turn, role, text).

    ids: the tokens of the whole string; loss: whether each token meets an assistant's text; under: for each non-empty
    assistant's text the characters of `formatted` that these tokens cover of it. Turns go by turn, then role and text; a
    null text or role is empty; a null conv_id is a conversation like any other; repeated rows are turns of their own;
    other columns are ignored; an empty table gives an empty one. A conversation is rendered in one task, as its string
    has to be; a group is never more than that.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        tk = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                turns = [[(t["role"], t["text"]) for t in c] for c in part.column("turns").to_pylist()]
                made = [render(c) for c in turns]
                ids, loss, under = [], [], []
                for e, c, (_, spans) in zip(tk.encode_batch([s for s, _ in made], add_special_tokens=False), turns, made, strict=True):
                    at = np.array(e.offsets, np.int64).reshape(-1, 2)
                    on, covered = mask(at[:, 0], at[:, 1], [x for (role, _), x in zip(c, spans, strict=True) if role == "assistant"])
                    ids.append(e.ids)
                    loss.append(on.tolist())
                    under.append(covered)
                columns = [part.column("conv_id"), pa.array([s for s, _ in made], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_())), pa.array(under, pa.list_(span))]
                yield pa.record_batch(columns, ["conv_id", "formatted", "ids", "loss", "under"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, loss array<boolean>, under array<struct<start:int,end:int>>")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted strings and masks."""

    def run(batches):
        for b in batches:
            out = []
            for s, under in zip(b.column("formatted").to_pylist(), b.column("under").to_pylist(), strict=True):
                turns = read_back(s)
                loss = "".join(unescape(s[x["start"] : x["end"]]) for x in under)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            x = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([b.column("conv_id"), pa.array(x[0], pa.int64()), pa.array(x[1], pa.string()), pa.array(x[2], pa.int64()), pa.array(x[3], pa.string()), pa.array(x[4], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "under").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
