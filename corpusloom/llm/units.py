"""Exact encoding with a byte-level BPE of the tokenizers library, each distinct unit once.

A text is cut where the pre-tokenizer is certain to begin a new piece, whatever surrounds it:

* before a character of ASCII that follows an ASCII letter and is none itself,
* before white space that follows a character that is none,
* between punctuation or digits of ASCII and a letter or digit (but not after an apostrophe),
* after a lone white space other than the blank.

Between such cuts the ids don't depend on the rest of the text. Units are looked up by hash, with numpy
over the bytes of a whole Arrow batch, and every hit is compared byte for byte; the tokenizer sees
each unit that is new to the worker, many in one text: a blank and what follows it up to the next white
space is told from the next one by the blank, and units without white space are put on lines. A text
that holds an added token, such as ``<|endoftext|>``, goes to the tokenizer as a whole.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

_LETTER, _SPACE, _DIGIT, _PUNCT, _QUOTE, _HIGH, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _PUNCT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _QUOTE
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[128:] = _HIGH

#: Cut between neighbours of these classes: 1 always, 2 unless the first may end a wide space.
_PAIR = np.zeros((7, 7), np.uint8)
_PAIR[_LETTER, [_SPACE, _DIGIT, _PUNCT, _QUOTE]] = 1
_PAIR[[_DIGIT, _PUNCT, _QUOTE], _SPACE] = 1
_PAIR[_HIGH, _SPACE] = 2
_PAIR[_PUNCT, [_LETTER, _DIGIT]] = 1
_PAIR[_DIGIT, [_LETTER, _PUNCT, _QUOTE]] = 1
_PAIR = np.concatenate((_PAIR.ravel(), np.zeros(256 - 49, np.uint8)))

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPAN = 1 << 21
#: Spans of more bytes are hashed by BLAKE2 one by one, all others eight bytes a step, side by side.
_LONG = 256
#: Bytes of white space, or that may begin a character of white space.
_MAY_SPACE = np.zeros(256, np.uint8)
_MAY_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = 1
#: New units that the tokenizer gets in one text.
_JOINED = 100
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """Of every place, the eight bytes from there; zeros follow the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, never 0: lengths, then eight bytes after the other, each mixed in."""
    words = eights(raw)
    size = ends - starts
    hashes = size.astype(np.uint64) * _ODD + _M2


    def mixed(x: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        x = x ^ (words[at] & _FIRST[np.minimum(left, 8)])
        x *= _M1
        x ^= x >> np.uint64(32)
        x *= _ODD
        x ^= x >> np.uint64(29)
        return x

    hashes = mixed(hashes, starts, size)
    index = np.flatnonzero((size > 8) & (size <= _LONG))
    step = 8
    while len(index):
        own = size[index] - step
        hashes[index] = mixed(hashes[index], starts[index] + step, own)
        index = index[own > 8]
        step += 8
    for i in np.flatnonzero(size > _LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    hashes *= _M2
    hashes ^= hashes >> np.uint64(31)
    hashes |= np.uint64(1)
    return hashes


class HashIndex:
    """Open-addressing table from 64-bit hashes (never 0) to places."""

    def __init__(self):
        self.count = 0
        self.hashes = np.zeros(1 << 10, np.uint64)
        self.of = np.zeros(1 << 10, np.int32)
        self._sized(1 << 12)

    def _sized(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.places = np.zeros(slots, np.int32)
        self.shift = np.uint64(64 - slots.bit_length() + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is unknown."""
        mask = len(self.keys) - 1
        slot = ((hashes * _ODD) >> self.shift).astype(np.int64)
        key = self.keys[slot]
        places = np.where(key == hashes, self.places[slot], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & mask
            key, wanted = self.keys[at], hashes[left]
            hit = key == wanted
            places[left[hit]] = self.places[at[hit]]
            left = left[~hit & (key != 0)]
        return places

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Put in distinct hashes that aren't in the table."""
        n, stop = self.count, self.count + len(hashes)
        self.hashes, self.of = grown(self.hashes, stop), grown(self.of, stop)
        self.hashes[n:stop], self.of[n:stop] = hashes, places
        self.count = stop
        if stop * 2 > len(self.keys):
            self._sized(1 << (stop * 4).bit_length())
            n = 0
        hashes, places = self.hashes[n:stop], self.of[n:stop]
        mask = len(self.keys) - 1
        slot = ((hashes * _ODD) >> self.shift).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]
            won = self.keys[at] == hashes[left]  # of several for one slot the last has it
            self.places[at[won]] = places[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask


def grown(array: np.ndarray, need: int) -> np.ndarray:
    """The array, or a longer copy of at least ``need`` items."""
    return array if need <= len(array) else np.concatenate((array, np.zeros((max(need - len(array), len(array)), *array.shape[1:]), array.dtype)))


class UnitEncoder:
    """Encoder with a store of units; ``max_units`` and ``max_bytes`` bound its memory, not what it encodes."""

    def __init__(self, path: str, max_units: int = 400_000, max_bytes: int = 16 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for s, i in vocabulary.items() if s.startswith("Ġ")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.max_units, self.max_bytes = max_units, max_bytes
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.clashes: dict[bytes, int] = {}  # units whose hash is another one's
        self.count = self.used = self.filled = 0
        self.offsets, self.lengths = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.begins, self.sizes = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.int32)
        self.data = np.zeros(4096, np.uint8)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``raw`` one after another, and the number of ids of each."""
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts = np.flatnonzero(self._cuts(raw, offsets))
        pieces, lengths = [], []
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + _SPAN)))
            end = starts[b] if b < len(starts) else n
            ids, size = self._units(raw[starts[a] : end], starts[a:b] - starts[a])
            pieces.append(ids)
            lengths.append(size)
            a = b
        total = np.concatenate(([0], np.cumsum(np.concatenate(lengths), dtype=np.int64)))
        ids, edges = np.concatenate(pieces), total[np.searchsorted(starts, offsets)]
        whole = self._with_added(raw, offsets)
        if whole:
            parts = np.split(ids, edges[1:-1])
            for i in whole:
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(edges)

    def _with_added(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that hold an added token's wording."""
        data, found = raw.tobytes(), set()
        for token in self.added:
            wanted = token.encode()
            at = data.find(wanted)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(wanted) <= offsets[i + 1]:
                    found.add(i)
                    at = int(offsets[i + 1]) - 1
                at = data.find(wanted, at + 1)
        return sorted(found)

    @staticmethod
    def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        kind = np.frombuffer(raw.tobytes().translate(_CLASS.tobytes()), np.uint8)
        cut = np.zeros(len(raw), bool)
        if len(raw) > 1:
            pair = np.frombuffer((kind[:-1] * np.uint8(7) + kind[1:]).tobytes().translate(_PAIR.tobytes()), np.uint8)
            cut[1:] = pair == 1
            wide = np.flatnonzero(pair == 2)  # the place before the space
            if len(wide):
                two, three = raw[np.maximum(wide - 1, 0)], raw[np.maximum(wide - 2, 0)]
                cut[wide[(two != 0xC2) & ((three < 0xE1) | (three > 0xE3))] + 1] = True
        if len(raw) > 2:
            lone = (kind[1:-1] == _SPACE) & (raw[1:-1] != 32) & (kind[2:] < _HIGH) & (kind[2:] != _SPACE) & (kind[:-2] < _HIGH) & (kind[:-2] != _SPACE)
            cut[2:] |= lone
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        return cut

    def _units(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(starts[1:], len(raw))
        hashes = hash_spans(raw, starts, ends)
        if self.count > self.max_units or self.filled > self.max_bytes:
            self._clear()
        places = self.index.find(hashes)
        missing = np.flatnonzero(places < 0)
        data = None
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            data = raw.tobytes()
            self.index.add(fresh, self._learn([data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]))
            places[missing] = self.index.find(hashes[missing])
        other = self._unlike(raw, starts, ends - starts, places)
        if len(other):
            data = data or raw.tobytes()
            units = [data[s:e] for s, e in zip(starts[other].tolist(), ends[other].tolist())]
            new = list(dict.fromkeys(u for u in units if u not in self.clashes))
            self.clashes.update(zip(new, self._learn(new).tolist() if new else ()))
            places[other] = [self.clashes[u] for u in units]
        size = self.lengths[places]
        stop = np.cumsum(size, dtype=np.int32)
        index = np.repeat(self.offsets[places] - (stop - size), size)
        index += np.arange(len(index), dtype=np.int32)
        return self.ids.take(index), size

    def _unlike(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Units whose bytes aren't those of their place."""
        here, there = eights(raw), np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        begins = self.begins[places]
        differs = self.sizes[places] != sizes
        differs |= ((here[starts] ^ there[begins]) & _FIRST[np.minimum(sizes, 8)]) != 0
        index = np.flatnonzero((sizes > 8) & ~differs)
        long = sizes[index] > _LONG
        for i in index[long].tolist():
            differs[i] = not np.array_equal(raw[starts[i] : starts[i] + sizes[i]], self.data[begins[i] : begins[i] + sizes[i]])
        index = index[~long]
        step = 8
        while len(index):
            left = sizes[index] - step
            unlike = ((here[starts[index] + step] ^ there[begins[index] + step]) & _FIRST[np.minimum(left, 8)]) != 0
            differs[index[unlike]] = True
            index = index[~unlike & (left > 8)]
            step += 8
        return np.flatnonzero(differs)

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Encode new units and keep them; returns their places."""
        wide = np.array([len(u) for u in units], np.int32)
        raw, begins = np.frombuffer(b"".join(units), np.uint8), np.cumsum(wide, dtype=np.int64) - wide
        spaces = np.add.reduceat(_MAY_SPACE[raw], begins, dtype=np.int32)
        blank = raw[begins] == 32
        words, others = np.flatnonzero(blank & (spaces == 1) & (wide > 1)).tolist(), np.flatnonzero(~blank & (spaces == 0)).tolist()
        alone = np.flatnonzero(blank & (wide == 1)).tolist()
        for i in np.flatnonzero(spaces > blank).tolist():
            text = units[i].decode("utf-8")[int(blank[i]) :]
            (alone if text.split() != [text] else words if blank[i] else others).append(i)
        order, sizes, found = [], [], []
        for chosen, between in ((words, b""), (others, b"\n")):
            groups = [chosen[i : i + _JOINED] for i in range(0, len(chosen), _JOINED)]
            texts = [between.join([units[i] for i in g]).decode("utf-8") for g in groups]
            if between and self.line is None or any(t in x for t in self.added for x in texts):
                alone.extend(chosen)
                continue
            for group, x in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(x.ids, np.int32)
                if between:
                    line = ids == self.line
                    at = np.flatnonzero(line)
                    size = np.diff(at, prepend=-1, append=len(ids)) - 1
                    ids = ids[~line]
                else:
                    at = np.flatnonzero(self.opens[ids])
                    size = np.diff(at, append=len(ids))
                if len(size) == len(group) and size.min() > 0 and (between or at[0] == 0):
                    order.extend(group)
                    sizes.append(size)
                    found.append(ids)
                else:
                    alone.extend(group)
        for x in self.tokenizer.encode_batch_fast([units[i].decode("utf-8") for i in alone], add_special_tokens=False):
            found.append(np.array(x.ids, np.int32))
            sizes.append([len(found[-1])])
        order.extend(alone)
        size, wide = np.concatenate(sizes).astype(np.int32), wide[order]
        n, end, stop, full = self.count, self.count + len(units), self.used + int(size.sum()), self.filled + len(raw)
        self.offsets, self.lengths, self.ids = grown(self.offsets, end), grown(self.lengths, end), grown(self.ids, stop)
        self.begins, self.sizes, self.data = grown(self.begins, end), grown(self.sizes, end), grown(self.data, full + 8)
        self.lengths[n:end], self.sizes[n:end] = size, wide
        self.offsets[n:end] = self.used + np.cumsum(size) - size
        self.begins[n:end] = self.filled + np.cumsum(wide) - wide
        self.ids[self.used : stop] = np.concatenate(found)
        self.data[self.filled : full] = np.frombuffer(b"".join([units[i] for i in order]), np.uint8)
        self.count, self.used, self.filled = end, stop, full
        places = np.empty(len(units), np.int32)
        places[order] = np.arange(n, end, dtype=np.int32)
        return places


_STORE: dict[tuple, object] = {}


def worker_store(key: tuple, make):
    """What a worker keeps between tasks: one thing at a time, so that its memory is that of one."""
    if key not in _STORE:
        _STORE.clear()
        give_back()
        _STORE[key] = make()
    return _STORE[key]


def give_back() -> None:
    """Return freed memory to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def encoder(path: str, max_units: int = 400_000) -> UnitEncoder:
    """The worker's own encoder; it stays until another operator's store takes its place."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return worker_store(("encoder", path, max_units), lambda: UnitEncoder(path, max_units))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
