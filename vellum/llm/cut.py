"""Cutting batches of texts at safe boundaries, and bounded stores of what is known of the parts, all without a Python object for each part."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_WIDE = [c.encode() for c in WHITE if ord(c) > 127]
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in WHITE if ord(c) < 128]] = 1
_KIND[[x[0] for x in _WIDE]] = 2
#: 1: an ASCII letter, 2: ASCII punctuation other than the apostrophe, 4: else.
_SIDE = np.array([1 if chr(c).isalpha() else 2 if chr(c).isprintable() and not chr(c).isalnum() and chr(c) not in " '" else 4 for c in range(128)] + [4] * 128, np.uint8)


class Texts:
    """The bytes of a batch of texts, each null one empty: `data`, and `offsets` of each text in it."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        first, last = int(offsets[0]), int(offsets[-1])
        held = column.buffers()[2] if last > first else None
        self.data = np.frombuffer(held, np.uint8)[first:last] if held else np.zeros(0, np.uint8)
        self.offsets = offsets - first

    def white(self) -> np.ndarray:
        """Whether each byte is of a white-space character."""
        kind = _KIND[self.data]
        out = kind == 1
        lead = np.flatnonzero(kind == 2)
        if len(lead):
            x = np.append(self.data, np.zeros(2, np.uint8))
            code = x[lead].astype(np.uint32) << 16 | x[lead + 1].astype(np.uint32) << 8 | x[lead + 2]
            for w in {(len(c), c) for c in _WIDE}:
                n, want = w[0], int.from_bytes(w[1].ljust(3, b"\0"), "big")
                at = lead[(code if n == 3 else code & 0xFFFF00) == want]
                for i in range(n if len(at) else 0):
                    out[at + i] = True
        return out

    def edges(self) -> np.ndarray:
        """Whether a byte is an ASCII letter behind ASCII punctuation (no apostrophe) or the reverse."""
        side = _SIDE[self.data]
        out = np.zeros(len(side), bool)
        np.equal(side[:-1] | side[1:], 3, out=out[1:])
        return out

    def parts(self, begin: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different parts that start where `begin` says or a text does, each part's place among them, and each text's first part."""
        if not len(self.data):
            return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(len(self.offsets), np.int64)
        begin[self.offsets[:-1][self.offsets[:-1] < len(begin)]] = True
        at = np.flatnonzero(begin)
        whole = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(begin)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data)))
        coded = whole.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(at, self.offsets)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and the bytes of an Arrow array of strings or binaries without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


class Store:
    """Byte strings by key, one behind the other, so that Arrow joins many of them without a Python object for each.

    At most `most` keys are kept beyond those of one call: when they are reached, the keys that the call asks for stay.
    """

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.offsets, self.data, self.used = np.zeros(1 << 12, np.int32), np.zeros(1 << 16, np.uint8), 0

    def find(self, keys: list[str]) -> np.ndarray:
        """Each key's place, or -1."""
        out = np.fromiter(map(self.at.get, keys, repeat(-1)), np.int64, len(keys))
        if len(self.at) + int((out < 0).sum()) > self.most and len(self.at) > (out >= 0).sum():
            held = np.flatnonzero(out >= 0)
            kept = [keys[i] for i in held]
            offsets, data = strings(self.array().take(pa.array(out[held])))
            offsets, data = offsets.copy(), data.copy()
            self._clear()
            self.add(kept, offsets, data)
            out[held] = np.arange(len(held))
        return out

    def add(self, keys: list[str], offsets: np.ndarray, data: np.ndarray) -> None:
        """Keeps the string of each new key; offsets start at the first's."""
        n, size = len(self.at), int(offsets[-1] - offsets[0])
        while n + len(keys) >= len(self.offsets):
            self.offsets = np.resize(self.offsets, 2 * len(self.offsets))
        while self.used + size > len(self.data):
            self.data = np.resize(self.data, 2 * len(self.data))
        self.offsets[n : n + len(keys) + 1] = offsets - offsets[0] + self.used
        self.data[self.used : self.used + size] = data[offsets[0] : offsets[-1]]
        self.used += size
        self.at.update(zip(keys, range(n, n + len(keys)), strict=True))

    def array(self) -> pa.Array:
        n = len(self.at)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(self.offsets[: n + 1]), pa.py_buffer(self.data[: self.used])])
