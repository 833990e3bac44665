"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Paragraphs are lines, and parts of longer lines: a line is cut after each word whose hash says so, one in
``PARAGRAPH_WORDS``, so that a word put in or left out changes the part around it and no other. In
scripts without blanks a character is a word. A digest is 64 bits of BLAKE2 of the paragraph, mixed
with how often it came before in the document. A sketch has three parts, and a
digest goes to one cell of each: the cell counts, and xors digests and their checks. Sketches of
two versions are subtracted cell by cell; a cell with one digest left gives it up, which frees other
cells, until nothing is left and all differing digests are known. If some stay, both versions are
sketched again in twice the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_parts
from .units import hash_spans

#: Words of a paragraph in a long line, on average.
PARAGRAPH_WORDS = 8
#: Cells of the fingerprint that is kept; comparisons grow beyond it where they must.
CELLS = 24
_TRIES = 16
_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_SEEDS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (x ^ seed) * _M1
    x ^= x >> _U(33)
    x *= _M2
    return x ^ (x >> _U(29))


def paragraphs(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the paragraphs of texts that begin at ``first``, without the line end or blank behind them."""
    begins = np.zeros(len(raw) + 1, bool)
    begins[first] = True
    begins[np.flatnonzero(raw == 10) + 1] = True
    # words end after blanks and line ends, and after characters of three bytes from U+3000 on
    ends = np.flatnonzero((raw == 32) | (raw == 10)) + 1
    wide = np.flatnonzero((raw >= 0xE3) & (raw <= 0xED)) + 3
    ends = np.unique(np.concatenate((ends, wide[wide <= len(raw)], first[1:], [len(raw)])))
    ends = ends[ends > 0]
    words = np.concatenate(([0], ends[:-1]))
    cut = ends[hash_spans(raw, words, ends) >> _U(1) & _U(PARAGRAPH_WORDS - 1) == 0]
    begins[cut] = True
    starts = np.flatnonzero(begins[:-1])
    stops = np.append(starts[1:], len(raw))
    stops -= (raw[stops - 1] == 10) | (raw[stops - 1] == 32)
    keep = stops > starts
    return starts[keep], stops[keep]


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document index (ascending) and digest of every paragraph; equal ones get different digests."""
    size = np.array([len(t) for t in texts], np.int64)
    data = b"".join(texts)
    raw = np.frombuffer(data, np.uint8)
    first = np.cumsum(size) - size
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = first[size > 0]
    starts, ends = paragraphs(raw, first)
    doc = np.flatnonzero(size > 0)[np.searchsorted(first, starts, "right") - 1]
    digest = np.frombuffer(b"".join([hashlib.blake2b(data[s:e], digest_size=8).digest() for s, e in zip(starts.tolist(), ends.tolist())]), "<u8")
    order = np.lexsort((digest, doc))
    doc, digest = doc[order], digest[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(doc)) - np.repeat(run, np.diff(np.append(run, len(doc))))
    return doc, _mix(digest + nth.astype(np.uint64) * _SEEDS[0], _SEEDS[3]) | _U(1)


class Sketches:
    """Sketches of several documents side by side: counts, key and check of (documents, cells)."""

    def __init__(self, documents: int, cells: int, salt: int = 0):
        self.cells = cells
        self.salt = _U(salt)
        self.count = np.zeros(documents * cells, np.int64)
        self.key = np.zeros(documents * cells, np.uint64)
        self.check = np.zeros(documents * cells, np.uint64)

    def places(self, doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
        third = self.cells // 3
        return np.concatenate([doc * self.cells + i * third + (_mix(digest + self.salt, _SEEDS[i]) % _U(third)).astype(np.int64) for i in range(3)])

    @staticmethod
    def checks(digest: np.ndarray) -> np.ndarray:
        return _mix(digest, _SEEDS[3]) >> _U(32)

    def add(self, doc: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> np.ndarray:
        at = self.places(doc, digest)
        np.add.at(self.count, at, np.tile(np.broadcast_to(sign, len(doc)), 3))
        np.bitwise_xor.at(self.key, at, np.tile(digest, 3))
        np.bitwise_xor.at(self.check, at, np.tile(self.checks(digest), 3))
        return at

    def minus(self, own: np.ndarray, other: np.ndarray) -> Sketches:
        """Differences of documents ``own`` less ``other``, pair by pair."""
        out = Sketches(len(own), self.cells)
        out.salt = self.salt
        for name, how in (("count", np.subtract), ("key", np.bitwise_xor), ("check", np.bitwise_xor)):
            x = getattr(self, name).reshape(-1, self.cells)
            setattr(out, name, how(x[own], x[other]).ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, digest and sign of all that can be recovered, and which documents came out whole."""
        found: list[tuple] = []
        at = np.arange(len(self.count))
        while len(at):
            at = at[(np.abs(self.count[at]) == 1) & (self.check[at] == self.checks(self.key[at]))]
            if not len(at):
                break
            doc = at // self.cells
            order = np.lexsort((self.key[at], doc))
            at, doc = at[order], doc[order]
            key = self.key[at]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            doc, key, sign = doc[new], key[new], self.count[at[new]]
            found.append((doc, key, sign))
            at = np.unique(self.add(doc, key, -sign))
        left = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(-1, self.cells).any(axis=1)
        doc, key, sign = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return doc, key, sign, ~left

    def strings(self, sizes: np.ndarray) -> list[str]:
        """Each sketch as text: number of digests, cells, and the cells in base64."""
        table = np.zeros((len(sizes), self.cells), [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        for name in ("count", "key", "check"):
            table[name] = getattr(self, name).reshape(-1, self.cells)
        return [f"{n}:{self.cells}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(sizes.tolist(), table)]


def differences(doc: np.ndarray, digest: np.ndarray, own: np.ndarray, other: np.ndarray, cells: int = CELLS, first: Sketches | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of documents the digests that only the one and only the other has.

    Pairs that a sketch doesn't bring out whole are tried again in twice the cells, with other places.
    """
    out: list = [None] * len(own)
    bounds = np.searchsorted(doc, np.arange(max(own.max(), other.max()) + 2)) if len(own) else None
    left = np.arange(len(own))
    for trial in range(_TRIES):
        if not len(left):
            return out
        if trial == 0 and first is not None:
            sketch, a, b = first, own, other
        else:
            used = np.unique(np.concatenate((own[left], other[left])))
            pick = np.concatenate([np.arange(bounds[u], bounds[u + 1]) for u in used])
            sketch = Sketches(len(used), cells, trial * 0x51ED2701)
            sketch.add(np.searchsorted(used, doc[pick]), digest[pick])
            a, b = np.searchsorted(used, own[left]), np.searchsorted(used, other[left])
        pair, key, sign, whole = sketch.minus(a, b).peel()
        order = np.argsort(pair, kind="stable")
        pair, key, sign = pair[order], key[order], sign[order]
        edge = np.searchsorted(pair, np.arange(len(left) + 1))
        for i in np.flatnonzero(whole).tolist():
            k, s = key[edge[i] : edge[i + 1]], sign[edge[i] : edge[i + 1]]
            out[left[i]] = (k[s > 0], k[s < 0])
        left = left[~whole]
        cells *= 2
    for i in left.tolist():  # two digests with the same three places each time: compared as they are
        x, y = (digest[bounds[d] : bounds[d + 1]] for d in (own[i], other[i]))
        out[i] = (np.setdiff1d(x, y), np.setdiff1d(y, x))
    return out


def likeness(n_own: int, n_other: int, differing: int) -> float:
    """Jaccard similarity of two digest sets from their sizes and symmetric difference."""
    both = n_own + n_other
    return 1.0 if both == 0 else (both - differing) / (both + differing)


def edit(text: str, after: str) -> str:
    """The text with its last quarter replaced by as many first characters of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_added", pa.int64()), ("n_removed", pa.int64())])


def _compare(keys: list, texts: list[str], after: str) -> pa.RecordBatch:
    n = len(texts)
    edited = [edit(t, u) for t, u in zip(texts, [*texts[1:], after])]
    data = [t.encode("utf-8", "surrogatepass") for t in (*texts, after, *edited)]
    doc, digest = paragraph_digests(data)
    sizes = np.bincount(doc, minlength=2 * n + 1)
    sketch = Sketches(2 * n + 1, CELLS)
    sketch.add(doc, digest)
    names = sketch.strings(sizes)
    own = np.arange(n)
    found = differences(doc, digest, np.tile(own, 2), np.concatenate((own + n + 1, own + 1)), CELLS, sketch)
    near = [[likeness(int(sizes[i]), int(sizes[j]), len(a) + len(b)) for i, j, (a, b) in zip(range(n), range(at, at + n), part)] for at, part in ((n + 1, found[:n]), (1, found[n:]))]
    columns = [keys, [len(t) for t in texts], [hashlib.sha256(x).hexdigest() for x in data[n + 1 :]], names[:n], names[n + 1 :], near[0], near[1], [len(b) for _, b in found[:n]], [len(a) for a, _ in found[:n]]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_chars: int = 1 << 20) -> DataFrame:
    """Fingerprint each document and its edited version, and compare it with that and with the next.

    Documents are in the order of id, and of one id by a hash of their text; after the last comes the
    first; a null id comes before all others and stays null; a null or empty text has no paragraph, and
    two such are alike (1.0). Repeated rows are documents of their own. Very long texts are whole, in
    the memory of one task. An empty table gives an empty result; other columns are ignored.
    ``n_added`` and ``n_removed`` count the recovered digests of the edit.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parted, order = ordered_parts(rows, "doc_id", "text")
    # The first document of a part also goes, marked, to the part before it: three longs a part on the driver.
    found = sorted((p, (k["_key"], k["_tie"])) for p, k in parted.groupBy("_part").agg(F.min(F.struct("_key", "_tie"))).collect())
    before = {k: found[i - 1][0] for i, (_, k) in enumerate(found)}
    back = order.part("_key", "_tie", before) if len(found) > 1 else F.when((F.col("_key") == found[0][1][0]) & (F.col("_tie") == found[0][1][1]), 0).otherwise(-1) if found else F.lit(-1)
    own = F.struct(F.col("_part").alias("p"), F.lit(False).alias("m"))
    homes = F.when(F.col("_back") >= 0, F.array(own, F.struct(F.col("_back").alias("p"), F.lit(True).alias("m")))).otherwise(F.array(own))
    laid = parted.withColumn("_back", back.cast("int")).withColumn("_home", F.explode(homes)).select("doc_id", "text", F.col("_home.p").alias("_p"), F.col("_home.m").alias("_m"), "_key", "_tie")
    laid = laid.repartitionById(order.parts, F.col("_p")).sortWithinPartitions("_p", "_m", "_key", "_tie", "text").select("doc_id", "text", "_p", "_m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[str] = []
        chars, part, closed = 0, None, True
        for batch in batches:
            for key, text, p, marked in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, closed = p, False
                if marked:
                    if not closed:
                        yield _compare(keys, texts, text)
                        keys, texts, chars, closed = [], [], 0, True
                    continue
                if chars >= group_chars:
                    yield _compare(keys, texts, text)
                    keys, texts, chars = [], [], 0
                keys.append(key)
                texts.append(text)
                chars += len(text)

    return laid.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_added long, n_removed long")
