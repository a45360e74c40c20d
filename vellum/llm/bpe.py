"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens by applying one gadget for each merge:
for (u, v) -> w the target of u's arcs is copied without its v arc, u's arcs are turned to the copy, and w arcs
are laid beside every u arc to where v used to lead. All arcs of a token share one target, so a state is named by
the token that leads to it, and it differs by the arcs that gadgets took: `gone` maps (u, v) to the gadget's rank.
Target of w starts as v's target of that time, so a state's full list of lost arcs is its own and, up to the rank
at which it was split off, that of its right part; an arc w exists where its left part's arc did when w came.

The table of all (state, token) pairs would hold billions, nearly all of which no text asks for. It is therefore filled
as states are entered: the first time that a pair is met the gadgets say whether the arc is there, and from then on the
table does. What bytes a token is spelled with is a second table, a trie in one array of (state, symbol) transitions.
A string has one accepting path; a sweep over both tables finds it for many words at once, and decoding emits the labels
of the path's arcs.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex

from vellum.llm.common import worker_own
from vellum.llm.cut import WHITE, Store, Texts, strings

END = 256  # the symbol that follows a word's last byte where the vocabulary marks word ends
STOP = 257  # the symbol that follows it elsewhere; no token is spelled with it
WORDS, CHUNKS = 300_000, 500_000  # what a worker keeps
ARCS = 1 << 20  # pairs that the arc table holds before it is emptied
STEP = 1 << 18  # symbols that are swept at once


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Trie:
    """Spellings as one array of transitions: state s goes by symbol c to base[s] + c if owner[that] is s; state 0 is the root."""

    def __init__(self, spellings: list[tuple[list[int], int]]):
        rows: list[dict[int, int]] = [{}]
        token_at = [-1]
        for symbols, token in spellings:
            node = 0
            for sym in symbols:
                nxt = rows[node].get(sym)
                if nxt is None:
                    nxt = rows[node][sym] = len(rows)
                    rows.append({})
                    token_at.append(-1)
                node = nxt
            token_at[node] = token
        size = 2 * len(rows) + 4 * (STOP + 1)
        taken, place, base = bytearray(size), [0] * len(rows), [0] * len(rows)
        taken[0] = 1
        # the widest rows first; rows of one width go on from the place of the last, so that no place is tried for ever
        width, at = 0, 0
        for n in sorted((n for n, row in enumerate(rows) if row), key=lambda n: -len(rows[n])):
            symbols = sorted(rows[n])
            if width != len(symbols):
                width, at = len(symbols), STOP + 1
            while True:
                at = taken.find(0, at)
                if at < 0 or at + STOP >= len(taken):
                    taken.extend(bytes(len(taken)))
                    at = max(at, STOP + 1)
                    continue
                b = at - symbols[0]
                if not any(taken[b + s] for s in symbols[1:]):
                    break
                at += 1
            base[n] = b
            for s in symbols:
                taken[b + s] = 1
                place[rows[n][s]] = b + s
        size = len(taken)
        self.base, self.owner, self.token = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        slots = np.array(place)
        self.base[slots], self.token[slots] = base, token_at
        for n, row in enumerate(rows):
            for child in row.values():
                self.owner[place[child]] = place[n]


class Arcs:
    """The (state, token) table, open addressed: the key and, in its lowest bit, whether the arc is there."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.cells = np.full(1 << bits, -1, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """1, 0 or, for a pair not met before, -1."""
        slot = self._slot(key)
        held = self.cells[slot]
        out = np.where(held >> 1 == key, held & 1, -1)
        at = np.flatnonzero((held >= 0) & (held >> 1 != key))
        while len(at):
            slot[at] = slot[at] + 1 & len(self.cells) - 1
            held = self.cells[slot[at]]
            hit = held >> 1 == key[at]
            out[at[hit]] = held[hit] & 1
            at = at[(held >= 0) & ~hit]
        return out

    def add(self, key: np.ndarray, there: np.ndarray) -> None:
        """Keeps pairs that differ and aren't held."""
        if self.n + len(key) > ARCS:
            self.__init__()
        while 2 * (self.n + len(key)) > len(self.cells):
            old = self.cells[self.cells >= 0]
            self.__init__(self.bits + 1)
            self._put(old)
        self._put(key << 1 | there)

    def _put(self, cells: np.ndarray) -> None:
        self.n += len(cells)
        slot = self._slot(cells >> 1)
        while len(cells):
            first = np.unique(slot, return_index=True)[1]
            first = first[self.cells[slot[first]] < 0]
            self.cells[slot[first]] = cells[first]
            rest = np.ones(len(cells), bool)
            rest[first] = False
            cells, slot = cells[rest], slot[rest] + 1 & len(self.cells) - 1


class Automaton:
    """Tables of the token automaton and of the tokens' spellings."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str | None):
        self.suffix, size = suffix, max(vocab.values()) + 1
        created, left, right = [-1] * size, [-1] * size, [-1] * size
        gone: dict[tuple[int, int], int] = {}
        dead = [False] * size
        merges = list(merges)

        def has_arc(u: int, t: int, limit: int) -> bool:
            """Whether the state after u has an arc t once `limit` gadgets were applied."""
            while True:
                if gone.get((u, t), limit) < limit:
                    return False
                if created[u] > created[t]:
                    limit, u = created[u], right[u]
                elif created[t] >= 0:
                    limit, t = created[t] + 1, left[t]
                else:
                    return True

        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if created[w] >= 0 or dead[u] or dead[v] or not has_arc(u, v, len(merges)):
                dead[w] = created[w] < 0
                continue
            gone[u, v] = k
            created[w], left[w], right[w] = k, u, v
        self.size, self.n_gadgets, self._has_arc = size, len(merges), has_arc
        self.arcs = Arcs()
        self.labels = [""] * size
        chars, spellings = byte_chars(), []
        for text, i in vocab.items():
            self.labels[i] = text
            ends = suffix is not None and text.endswith(suffix) and len(text) > len(suffix)
            body = text[: -len(suffix)] if ends else text
            if not (dead[i] or created[i] < 0 and len(body) != 1 or any(c not in chars for c in body)):
                spellings.append(([*(chars[c] for c in body), *([END] if ends else [])], i))
        self.trie = Trie(spellings)

    def allowed(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state after each token `state` has an arc `token`: by the table, which pairs new to it are added to."""
        key = state.astype(np.int64) * self.size + token
        out = self.arcs.find(key)
        open_ = np.flatnonzero(out < 0)
        if len(open_):
            new, back = np.unique(key[open_], return_inverse=True)
            there = np.array([self._has_arc(k // self.size, k % self.size, self.n_gadgets) for k in new.tolist()], np.int64)
            self.arcs.add(new, there)
            out[open_] = there[back]
        return out > 0

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one behind the other, and how many each has; an empty word has none."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids, count, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        ends = np.cumsum(size + 1)
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, side="right")))
            some = self._sweep(b"\xff".join(words[i:j]), size[i:j])
            ids.append(some[0])
            count.append(some[1])
            i = j
        return np.concatenate(ids), np.concatenate(count)

    def _sweep(self, joined: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        trie, marked = self.trie, self.suffix is not None
        first = np.cumsum(size + 1) - size - 1
        stop = first + size
        sym = np.append(np.frombuffer(joined, np.uint8).astype(np.int16), np.zeros(2, np.int16))[: int(stop[-1]) + 1] if len(joined) else np.zeros(int(stop[-1]) + 1, np.int16)
        sym[stop] = END if marked else STOP
        n = len(sym)
        closing = sym >= END
        # every spelling that starts anywhere: (start, end, token); no token ends where a word's end mark must follow
        start = np.flatnonzero(~closing).astype(np.int32)
        node, at = np.zeros(len(start), np.int32), start
        found = []
        while len(start):
            to = trie.base[node] + sym[at]
            go = np.flatnonzero(trie.owner[to] == node)
            start, node, at = start[go], to[go], at[go] + 1
            token = trie.token[node]
            good = token >= 0
            if marked:
                good &= (at == n) | ~closing[np.minimum(at, n - 1)] | closing[at - 1]
            good = np.flatnonzero(good)
            found.append((start[good], at[good], token[good]))
            live = np.flatnonzero(at < n)
            start, node, at = start[live], node[live], at[live]
        start, end, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int32)] * 3
        place = start - np.repeat(first, size + 1)[start]
        order = np.argsort(place, kind="stable") if len(place) and place.max() > 30_000 else np.argsort(place.astype(np.int16), kind="stable")
        start, end, token = start[order], end[order], token[order]
        cut = np.searchsorted(place[order], np.arange(int(size.max(initial=0)) + 1))
        last, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)  # by end: the path's last token and where it starts
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            s, e, t = start[a:b], end[a:b], token[a:b]
            if i:
                before = last[s]
                ok = before >= 0
                ok[ok] = self.allowed(before[ok], t[ok])
                s, e, t = s[ok], e[ok], t[ok]
            last[e], back[e] = t, s
        on = np.zeros(n + 1, bool)
        pos, floor = (stop + marked)[size > 0], first[size > 0]
        if (last[pos] < 0).any():
            raise ValueError("a word has no path; its bytes aren't in the vocabulary")
        while len(pos):
            on[pos] = True
            pos = back[pos]
            go = pos > floor
            pos, floor = pos[go], floor[go]
        path = np.flatnonzero(on)
        return last[path].astype(np.uint32), np.diff(np.searchsorted(path, np.append(first + 1, n + 1)))


class Encoder:
    """Texts to tokens for a vocabulary file with word ends, whose splitter never joins across white space, nor letters with punctuation.

    A batch is cut there; what its different chunks encode to is kept, and the batch's ids are taken from there.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or None)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile("\n|" + split.replace(r"\s", "".join(rf"\u{ord(c):04x}" for c in WHITE))).findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = self.automaton.labels
        for text, i in self.special.items():
            labels.extend([""] * (i + 1 - len(labels)))
            labels[i] = text
        # the longest of those that start at one place is the one
        self.find_special = regex.compile(b"|".join(regex.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True))).finditer if self.special else None
        self.words, self.chunks = Store(WORDS), Store(CHUNKS)

    def normal(self, chunk: str) -> str:
        # lower-casing is by code point: no final sigma
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's start; a null text is empty."""
        texts = Texts(column)
        white = texts.white()
        begin = texts.edges()
        begin[1:] |= white[:-1] & ~white[1:]
        whole = texts.data.tobytes() if self.special else b""
        if any(x.encode() in whole for x in self.special):
            for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
                for m in self.find_special(whole, a, b):
                    begin[m.start() : m.end()] = False
                    begin[m.start()] = True
                    if m.end() < len(begin):
                        begin[m.end()] = True
        chunks, place, first = texts.parts(begin)
        keys = chunks.to_pylist()
        at = self.chunks.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.chunks.at) + np.arange(len(new))
            self.learn([keys[i] for i in new.tolist()])
        offsets, data = strings(self.chunks.array().take(pa.array(at[place])))
        return data[: offsets[-1]].view(np.uint32), offsets[first].astype(np.int64) // 4

    def learn(self, keys: list[str]) -> None:
        """Encodes chunks, each with the white space behind it, and keeps them."""
        bare = [k.rstrip(WHITE) for k in keys]
        special = {i: self.special[x] for i, x in enumerate(bare) if x in self.special} if self.special else {}
        for i in special:
            bare[i] = ""
        flat = self.split(self.normal("\n".join(bare)))
        flat.append("\n")
        coded = pa.array(flat, pa.string()).dictionary_encode()
        place, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        at = self.words.find(different)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.words.at) + np.arange(len(new))
            some = [different[i] for i in new.tolist()]
            ids, count = self.automaton.encode([w.encode() if w != "\n" else b"" for w in some])
            self.words.add(some, np.append(0, np.cumsum(4 * count)), ids.view(np.uint8))
        offsets, data = strings(self.words.array().take(pa.array(at[place])))
        line = np.flatnonzero(place == different.index("\n"))
        cut = np.append(0, offsets[line])
        if special:  # a special string's one id, where its empty chunk is
            rows, ids = np.array(list(special)), np.array(list(special.values()), np.uint32)
            data = np.insert(data[: cut[-1]].view(np.uint32), cut[rows] // 4, ids).view(np.uint8)
            more = np.zeros(len(cut), cut.dtype)
            more[rows + 1] = 4
            cut = cut + np.cumsum(more)
        self.chunks.add(keys, cut, data)


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return worker_own(("bpe", path), lambda: Encoder(path))


class Speller:
    """Ids as text, a space behind each: decimal numbers, and the labels that the arcs emit."""

    def __init__(self, labels: list[str]):
        self.numbers, self.labels = pa.array([f"{i} " for i in range(len(labels))]), pa.array([f"{x} " for x in labels])

    def spans(self, column: pa.Array, ids: np.ndarray, first: np.ndarray):
        """(text, bytes, whether the text ends there) in order, some 4 million ids at a time; the last space of a text is left out."""
        text = 0
        for a in range(0, len(ids), 1 << 22):
            some = ids[a : a + (1 << 22)]
            offsets, data = strings(column.take(pa.array(some)))
            view = memoryview(data)
            while text + 1 < len(first) and first[text] < a + len(some):
                low, high = max(int(first[text]), a) - a, min(int(first[text + 1]), a + len(some)) - a
                ends = first[text + 1] <= a + len(some)
                if high > low:
                    yield text, view[offsets[low] : offsets[high] - bool(ends)]
                if not ends:
                    break
                text += 1
