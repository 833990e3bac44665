"""Near-duplicates by BagMinHash over multisets of word shingles.

Shingles are runs of five words (of all words, where there are fewer), and a shingle's weight is its
number of places. BagMinHash draws a signature from Poisson processes over time and weight: the
weight axis is halved into strips, (0, 1], (1, 2], (2, 4], .. with rates as wide, a strip's points
come in order of time until they can't lower any register, and a point counts where its weight, found
by going on down to an integer level, is at most the shingle's. Equal registers then estimate
sum(min) / sum(max) without bias, in about n + m log m points instead of n * m.

Equal word sequences are one text from the start. Band keys of the signatures give buckets. In each
bucket a centre is compared with all others, by exact overlap of the multisets; what links becomes a
component. A bucket whose members are then still in several components is open. Pairs of texts of
open buckets are found by prefixes: with a text's shingles in the order of their frequency, rare ones first,
two texts can only overlap enough if they share one before the weight that is left falls below
what the overlap asks for. So no bucket is compared all with all, whatever its size, and no pair of
open buckets that is similar enough is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import components
from .common import discard, materialize, string_buffers, text_runs
from .licenses import _BLANK
from .quality import _words
from .units import give_back, hash_spans

WORDS = 5
BANDS, ROWS = 25, 5
_U = np.uint64
_TABLE = np.frombuffer(_BLANK, np.uint8)
_M1, _M2, _STEP, _STRIP = (_U(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_SHORT = _U(0x2545F4914F6CDD1D)
_KEY_BITS = 52  # of a shingle, beside 12 for its document in a run
#: Texts of a shared shingle that are held against each other in one task; beyond it they are, block by block.
BLOCK = 4096
#: Parts of a centre's members.
PARTS = 64
#: Texts of a component's block; two blocks are compared in one task's memory.
GROUP = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _M1
    x = (x ^ (x >> _U(29))) * _M2
    return x ^ (x >> _U(32))


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 52-bit key and count of each distinct shingle, by document then key."""
    blank = _TABLE[raw]
    starts, ends, doc = _words(blank, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hash_spans(blank, starts, ends)
    n = len(h)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    left = words[doc] - (np.arange(n) - first[doc])  # words from here to the end of the document
    mixed, after = np.zeros(n, np.uint64), np.concatenate((h, np.zeros(width, np.uint64)))
    for k in range(width):
        mixed = mixed * _STEP + np.where(left > k, after[k : n + k], _U(0))
    at = np.flatnonzero((left >= width) | ((words[doc] < width) & (left == words[doc])))
    key = _mix(np.where(left[at] < width, mixed[at] + _SHORT, mixed[at])) >> _U(64 - _KEY_BITS)
    key |= doc[at].astype(np.uint64) << _U(_KEY_BITS)
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> _U(_KEY_BITS)).astype(np.int64), key & _U((1 << _KEY_BITS) - 1), count


def signatures(doc: np.ndarray, key: np.ndarray, count: np.ndarray, documents: int, size: int) -> np.ndarray:
    """BagMinHash registers (documents, size): times of the first points, infinite without shingles."""
    registers = np.full(documents * size, np.inf)
    most = np.full(documents, np.inf)
    strips = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # the last strip of each
    for strip in range(int(strips.max(initial=0)) + 1):
        pick = strips >= strip
        if not pick.any():
            continue
        d, weight = doc[pick], count[pick]
        state = _mix(key[pick] + _U(strip * int(_STRIP) & 0xFFFFFFFFFFFFFFFF))
        base = 0 if strip == 0 else 1 << (strip - 1)
        wide = 1 if strip == 0 else base
        time = np.zeros(len(d))
        while len(d):
            state = state + _STEP
            r = _mix(state)
            time = time - np.log(((r >> _U(20)).astype(np.float64) + 0.5) * 2.0**-44) / wide
            go = time < most[d]
            if not go.all():
                d, state, time, weight, r = d[go], state[go], time[go], weight[go], r[go]
            at = d * size + ((r & _U(0xFFFFF)) * _U(size) >> _U(20)).astype(np.int64)
            if wide > 1 or base:
                level = base + 1 + ((_mix(r + _STRIP) >> _U(24)) * _U(wide) >> _U(40)).astype(np.int64)
                ok = level <= weight
                np.minimum.at(registers, at[ok], time[ok])
            else:
                np.minimum.at(registers, at, time)
            if len(d):
                seen = np.flatnonzero(np.bincount(d, minlength=documents))
                most[seen] = registers.reshape(documents, size)[seen].max(axis=1)
                go = time < most[d]
                d, state, time, weight = d[go], state[go], time[go], weight[go]
    return registers.reshape(documents, size)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each document and band, different between bands."""
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1).astype(np.uint64) * _STRIP, bits.shape[:2]).copy()
    for k in range(rows):
        out = _mix(out * _STEP + bits[:, :, k])
    return out.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted keys, counts)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _multisets(column: pa.Array, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    raw, offsets = string_buffers(column)
    out = []
    for a, b in _groups(offsets):
        doc, key, count = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        edge = np.searchsorted(doc, np.arange(b - a + 1))
        out += [(key[lo:hi], count[lo:hi]) for lo, hi in zip(edge, edge[1:])]
    return out


_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def multisets(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, and the shingles of the text: sorted keys and counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _multisets(batch.column(2), width)
            for a in range(0, len(found), 1000):
                part = found[a : a + 1000]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), batch.column(1).slice(a, len(part)), pa.array([k.tobytes() for k, _ in part], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in part], pa.binary())], schema=_SETS)

    return texts.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, keys binary, counts binary")


def _sets_of(texts: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """Stored shingles of the members' texts.

    Members are a small part of all texts, so a Bloom filter of their ids, which Spark makes at run time, leaves
    out most others before they are shuffled; the settings for that are as before afterwards.
    """
    conf = texts.sparkSession.conf
    n = members.count()
    wanted = {"bloomFilter.enabled": "true", "bloomFilter.creationSideThreshold": "1GB", "bloomFilter.applicationSideScanSizeThreshold": "0", "bloomFilter.expectedNumItems": str(min(4_000_000, max(1, n))), "bloomFilter.numBits": str(min(1 << 26, max(1 << 20, 16 * n)))}
    before = {k: conf.get(f"spark.sql.optimizer.runtime.{k}", None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(f"spark.sql.optimizer.runtime.{k}", v)
        # the filter is made of a side that a condition makes smaller, which this one stands for
        some = members.where(F.col("doc_id") >= F.lit(-(1 << 63)))
        return materialize(multisets(texts.join(some, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]), width), "near-sets")
    finally:
        for k, v in before.items():
            conf.unset(f"spark.sql.optimizer.runtime.{k}") if v is None else conf.set(f"spark.sql.optimizer.runtime.{k}", v)


def _read_set(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in text_runs(offsets, 1 << 20):
        for lo in range(a, b, 4096):
            yield lo, min(b, lo + 4096)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("words", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _digest(data: bytes) -> bytes | None:
    """Key of a text: of its words, or of its bytes if it has none; null for an empty text."""
    words = data.translate(_BLANK).split()
    if not words and not data:
        return None
    return hashlib.blake2b(b" ".join(words) if words else data, digest_size=16, person=b"words" if words else b"bytes").digest()


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hash of the text, key of the word sequence, number of shingles (0: no words) and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(2))
            for a, b in _groups(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                doc, key, count = shingles(part, at, width)
                keys = band_keys(signatures(doc, key, count, b - a, bands * rows), bands, rows)
                data, at = part.tobytes(), at.tolist()
                digests = [_digest(data[s:e]) for s, e in zip(at, at[1:])]
                total = np.bincount(doc, count, b - a).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(total), lists], schema=_SIGNED)
            give_back()

    return _named(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, words binary, n long, bands array<long>")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash and text: what names a row of documents, as an id may come with several texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 2000) -> DataFrame:
    """Inner join of rows with one row a key, safe for keys that a large part of the rows has.

    Keys of more than ``total / share`` rows number ``share`` at most for each time that a row is
    counted, so their broadcast is bounded; all other keys are joined by shuffling.
    """
    limit = max(1000, total // share)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    many = rows.join(hot, keys)
    few = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(*keys)), keys, "left_anti").join(groups.where(F.col(size) <= limit), keys)
    return many.unionByName(few)


_LINKS = pa.schema([(x, pa.int64()) for x in ("a_id", "a_hash", "b_id", "b_hash")] + [("similarity", pa.float64())])


def _verify(least: float):
    """Overlap of each member with its centre; rows come by centre and part, the centre's own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, centre = None, None
        for batch in batches:
            found = []
            for c, c_hash, m, m_hash, leads, keys, counts in zip(*(x.to_pylist() for x in batch.columns)):
                if leads:
                    here, centre = (c, c_hash), _read_set(keys, counts)
                elif (c, c_hash) != here:
                    raise ValueError(f"the shingles of {c} are missing")
                else:
                    same = overlap(centre, _read_set(keys, counts))
                    if same >= least:
                        found.append((m, m_hash, c, c_hash, same))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), _LINKS)], schema=_LINKS)

    return run


def _links(found: DataFrame) -> DataFrame:
    node = lambda x: F.struct(F.col(f"{x}_id").alias("doc_id"), F.col(f"{x}_hash").alias("text_hash")).alias(x)
    return found.select(node("a"), node("b"), "similarity")


_LINKED = "a_id long, a_hash long, b_id long, b_hash long, similarity double"


def _with_centres(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Links among pairs (node, centre), each a struct of doc_id and text_hash: a, b, similarity.

    A centre's shingles go once to each of ``PARTS`` parts of its members, a member's once to each centre.
    """
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    members = salted.select("centre", "part", F.col("node").alias("own"), F.lit(False).alias("leads"))
    centres = salted.select("centre", "part", F.col("centre").alias("own"), F.lit(True).alias("leads")).distinct()
    asked = members.unionByName(centres).select("centre", "part", "leads", F.col("own.doc_id").alias("doc_id"), F.col("own.text_hash").alias("text_hash"))
    laid = sets.join(asked, ["doc_id", "text_hash"]).repartition("centre", "part").sortWithinPartitions("centre", "part", F.desc("leads"))
    found = laid.select("centre.doc_id", "centre.text_hash", F.col("doc_id").alias("m"), F.col("text_hash").alias("m_hash"), "leads", "keys", "counts")
    return _links(found.mapInArrow(_verify(least), _LINKED))


def _verify_blocks(least: float):
    """Overlap of the listed pairs of two blocks; of texts that are linked already within the two none is compared again."""

    def compare(members: list) -> list[tuple]:
        known = {node: _read_set(keys, counts) for node, _, keys, counts in members}
        label = {node: node for node in known}

        def root(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        found = []
        for node, partners, _, _ in members:
            for p in partners or ():
                other = (p["doc_id"], p["text_hash"])
                x, y = root(node), root(other)
                if x != y:
                    same = overlap(known[node], known[other])
                    if same >= least:
                        found.append((*node, *other, same))
                        label[x] = y
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, members = None, []
        for batch in batches:
            found = []
            for group, doc, hash_, partners, keys, counts in zip(*(x.to_pylist() for x in batch.columns)):
                if group != here:
                    found += compare(members)
                    here, members = group, []
                members.append(((doc, hash_), partners, keys, counts))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), _LINKS)], schema=_LINKS)
        found = compare(members)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), _LINKS)], schema=_LINKS)

    return run


def _in_blocks(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Links among pairs (node, centre) with the blocks that they are in (block, block2): a, b, similarity.

    Shingles go once to each pair of blocks, however many pairs of texts that has.
    """
    grouped = pairs.withColumn("group", F.xxhash64("block", "block2"))
    left = grouped.groupBy("group", "node").agg(F.collect_list("centre").alias("partners"))
    right = grouped.select("group", F.col("centre").alias("node")).distinct().withColumn("partners", F.lit(None).cast(left.schema["partners"].dataType))
    asked = left.unionByName(right).groupBy("group", "node").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    asked = asked.select("group", "partners", F.col("node.doc_id").alias("doc_id"), F.col("node.text_hash").alias("text_hash"))
    laid = sets.join(asked, ["doc_id", "text_hash"]).repartition("group").sortWithinPartitions("group")
    return _links(laid.select("group", "doc_id", "text_hash", "partners", "keys", "counts").mapInArrow(_verify_blocks(least), _LINKED))


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """A row a distinct shingle: node, key, count."""
    fields = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("shingles", pa.list_(pa.struct([("key", pa.int64()), ("count", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read_set(k, c) for k, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            edge = np.cumsum([0, *(len(k) for k, _ in found)])
            keys, counts = (np.concatenate([x[i] for x in found] or [np.zeros(0)]).astype(np.int64) for i in (0, 1))
            items = pa.StructArray.from_arrays([pa.array(keys), pa.array(counts)], ["key", "count"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), items)], schema=fields)

    rows = sets.select("doc_id", "text_hash", "keys", "counts").mapInArrow(run, "doc_id long, text_hash long, shingles array<struct<key:long,count:long>>")
    return rows.select(F.struct("doc_id", "text_hash").alias("node"), F.explode("shingles").alias("s")).select("node", "s.key", "s.count")


_PAIRS = pa.schema([(x, pa.int64()) for x in ("a_id", "a_hash", "b_id", "b_hash", "block", "block2")])


def _prefix_matches(least: float):
    """Pairs of texts with one shingle in both prefixes that fit each other; rows come by key and blocks."""
    share = least / (1 + least) - 1e-9

    def matches(rows: np.ndarray, rest: np.ndarray) -> np.ndarray:
        side, doc, hash_, own, block, n, short = rows.T
        out = []
        small = np.flatnonzero(short)
        for at in range(0, len(rows), 512):
            i = np.arange(at, min(len(rows), at + 512))[:, None]
            fits = (n[small] <= n[i]) & (n[small] >= n[i] * (least - 1e-9)) & (own[small] != own[i])
            fits &= np.minimum(rest[small], rest[i]) >= (n[small] + n[i]) * share
            fits &= (n[small] < n[i]) | (doc[small] < doc[i]) | ((doc[small] == doc[i]) & (hash_[small] < hash_[i]))
            if side.any():  # of two blocks only pairs of one text of each: each block also meets itself
                fits &= side[small] != side[i]
            x, y = np.nonzero(fits)
            x, y = x + at, small[y]
            out.append(np.column_stack((doc[x], hash_[x], doc[y], hash_[y], block[x], block[y])))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_rows, held_rest = [], [], []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """All groups that are whole; the last one may go on in the next batch."""
            if not held_keys:
                return
            keys, rows, rest = np.concatenate(held_keys), np.concatenate(held_rows), np.concatenate(held_rest)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            stop = len(edges) - 1 if last else len(edges) - 2
            found = [m for a, b in zip(edges[:stop], edges[1 : stop + 1]) if b - a > 1 and len(m := matches(rows[a:b], rest[a:b]))]
            cut = edges[stop]
            held_keys[:], held_rows[:], held_rest[:] = [keys[cut:]], [rows[cut:]], [rest[cut:]]
            if found:
                table = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], schema=_PAIRS)

        for batch in batches:
            columns = [np.asarray(c).astype(np.int64) for c in batch.columns]
            held_keys.append(np.column_stack(columns[:3]))
            held_rows.append(np.column_stack(columns[3:10]))
            held_rest.append(columns[10])
            yield from flush(False)
        yield from flush(True)

    return run


def prefix_pairs(sets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Pairs (node, centre) of different labels that may overlap by ``least``, with their blocks: no other pair does.

    ``sets`` has a row a shingle of a node: node, key, count; ``labels`` node, hashes of its label and of
    its block (own, block), and its weight n. In the order of frequency, then key, the first shingle
    that two texts share bounds their overlap by the weight from there on, which must reach
    least / (1 + least) of their weights' sum. For the smaller of two texts that is more than for the
    larger one, so its prefix is shorter. Only texts with one shingle in both prefixes are looked at.
    """
    total = sets.count()
    often = materialize(sets.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "near-often")
    known = join_groups(sets, often, ["key"], "often", total)
    # shingles of one text only come first in the order and are in no pair: what counts is their weight
    before = W.partitionBy("node").orderBy("often", "key").rowsBetween(W.unboundedPreceding, -1)
    rest = known.withColumn("rest", F.sum("count").over(W.partitionBy("node")) - F.coalesce(F.sum("count").over(before), F.lit(0))).join(labels, "node")
    short = (F.col("rest") >= F.col("n") * (2 * least / (1 + least) - 1e-9)).cast("int").alias("short")
    prefix = rest.where(F.col("rest") >= F.col("n") * (least - 1e-9)).select("key", F.col("node.doc_id").alias("doc_id"), F.col("node.text_hash").alias("text_hash"), "own", "block", "n", short, "rest")
    prefix = materialize(prefix, "near-prefixes")
    hot = prefix.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK).select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id", "text_hash"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0))))
    met = prefix.join(hot, "key", "left").withColumn("one", own).withColumn("two", other)
    laid = met.select("key", F.least("one", "two").alias("i"), F.greatest("one", "two").alias("j"), (F.col("one") > F.col("two")).cast("int").alias("side"), "doc_id", "text_hash", "own", "block", "n", "short", "rest")
    laid = laid.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = laid.mapInArrow(_prefix_matches(least), "a_id long, a_hash long, b_id long, b_hash long, block long, block2 long").distinct()
    node = lambda x: F.struct(F.col(f"{x}_id").alias("doc_id"), F.col(f"{x}_hash").alias("text_hash"))
    out = materialize(found.select(node("a").alias("node"), node("b").alias("centre"), "block", "block2"), "near-candidates")
    discard(often, prefix)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row a document: doc_id, text_hash, class_id, is_first, copy_of, link_id and similarity.

    ``class_id`` is the smallest id among the documents that links of ``least`` or more connect;
    ``is_first`` marks the row that has it. ``copy_of`` is the smallest id with the same words;
    ``link_id`` is the text that this one, or the one that it is a copy of, was found most similar to among
    those compared, and ``similarity`` their overlap; both are null where there is no such text.

    Words are lower-case runs of digits, ASCII letters and characters beyond ASCII, so texts that
    differ in other characters only are equal. Texts without words are copies if they are equal; an
    empty or null text is a class of its own. A row is named by id and text: rows of one id with
    different texts may be in different classes, and repeated rows give repeated rows of one class. A
    null id gives nulls and links nothing; very long texts count whole; other columns are ignored; an
    empty table gives no rows. A pair of similarity 0.8 shares a bucket with probability 1 - 5e-5, and a
    closer pair more surely.
    """
    node = F.struct("doc_id", "text_hash")
    signed = materialize(sign(docs, id_col, text_col, width, bands, rows), "near-signed")
    named = signed.where("words IS NOT NULL")
    found = named.groupBy("words").agg(F.min(F.struct("doc_id", "text_hash", "n", "bands")).alias("r"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(found.select("words", F.struct("r.doc_id", "r.text_hash").alias("node"), F.col("r.n").alias("n"), F.col("r.bands").alias("bands"), "copies"), "near-texts")
    labels, links = _link(_named(docs, id_col, text_col), reps.where("n > 0").select("node", "n", "bands"), least, width)
    both = links.select("a", "b", "similarity").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b.doc_id").alias("link_id"))).alias("x")).select("node", "x.link_id", (-F.col("x.s")).alias("similarity"))
    classes = reps.select("words", "node", "copies").join(labels, "node", "left").join(best, "node", "left")
    classes = materialize(classes.select("words", F.coalesce("label", "node").alias("label"), F.col("node.doc_id").alias("copy_of"), "link_id", "similarity", "copies"), "near-classes")
    total = reps.agg(F.sum("copies")).first()[0] or 0
    discard(reps, labels, links)
    of = join_groups(named.select("doc_id", "text_hash", "words"), classes, ["words"], "copies", total)
    of = of.select("doc_id", "text_hash", F.col("label.doc_id").alias("class_id"), (node == F.col("label")).alias("is_first"), "copy_of", "link_id", "similarity")
    unlinked = F.lit(None).cast("long").alias("link_id"), F.lit(None).cast("double").alias("similarity")
    alone = signed.where("words IS NULL").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(True).alias("is_first"), F.col("doc_id").alias("copy_of"), *unlinked)
    none = F.lit(None).cast("long")
    nameless = docs.where(F.col(id_col).isNull()).select(none.alias("doc_id"), none.alias("text_hash"), none.alias("class_id"), F.lit(None).cast("boolean").alias("is_first"), none.alias("copy_of"), *unlinked)
    return of.unionByName(alone).unionByName(nameless)


def _link(texts: DataFrame, reps: DataFrame, least: float, width: int) -> tuple[DataFrame, DataFrame]:
    """Component label of every distinct text that has a link, and the links: (node, label), (a, b, similarity)."""
    banded = reps.select("node", "n", F.explode("bands").alias("key"))
    # one order for all buckets, so that texts that share several have one centre
    pick = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node"), F.col("n")))
    buckets = materialize(banded.groupBy("key").agg(pick.alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"), "size"), "near-buckets")
    total = reps.count()
    shared = materialize(join_groups(banded, buckets, ["key"], "size", total), "near-shared")
    sized = F.least("n", "centre_n") >= F.lit(least) * F.greatest("n", "centre_n")
    members = materialize(shared.select(F.col("node.doc_id").alias("doc_id"), F.col("node.text_hash").alias("text_hash")).distinct(), "near-members")
    sets = _sets_of(texts, members, width)
    pairs = shared.where((F.col("node") != F.col("centre")) & sized).select("node", "centre").distinct()
    links = materialize(_with_centres(sets, pairs, least), "near-links")
    first = components(links.select("a", "b"))

    # buckets whose members are still in several components
    placed = materialize(shared.select("key", "node", "n").join(first, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("own")), "near-placed")
    differ = (F.min("own.doc_id") != F.max("own.doc_id")) | (F.min("own.text_hash") != F.max("own.text_hash"))
    open_ = materialize(placed.groupBy("key").agg(differ.alias("open"), F.count(F.lit(1)).alias("size")).where("open").select("key", "size"), "near-open")
    nodes = materialize(join_groups(placed, open_, ["key"], "size", total).select("node", "own", "n").distinct(), "near-open-texts")
    discard(buckets, shared, members, placed, open_)
    if nodes.isEmpty():
        discard(sets)
        return first, links
    blocks = nodes.groupBy("own").agg(F.count(F.lit(1)).alias("size"))
    of_own = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP))
    labels = materialize(join_groups(nodes, blocks, ["own"], "size", total).select("node", F.xxhash64("own").alias("own"), "n", F.xxhash64("own", of_own).alias("block")), "near-labels")
    wanted = nodes.select(F.col("node.doc_id").alias("doc_id"), F.col("node.text_hash").alias("text_hash"))
    rows = materialize(_shingle_rows(sets.join(wanted, ["doc_id", "text_hash"])), "near-shingles")
    candidates = prefix_pairs(rows, labels, least)
    discard(nodes, rows, labels)
    more = materialize(_in_blocks(sets, candidates, least), "near-more-links")
    discard(candidates, sets)
    if more.isEmpty():
        return first, links
    return components(first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more.select("a", "b"))), links.unionByName(more)


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, its first; rows without an id stay.

    Columns of ``docs`` may have any name. Of repeated rows of one id and text the one stays whose
    columns, as JSON, come first.
    """
    names = {c.lower() for c in docs.columns}

    def fresh(name: str) -> str:
        while name in names:
            name += "_"
        return name

    key, hash_, nth = fresh("_nd_id"), fresh("_nd_hash"), fresh("_nd_nth")
    own = lambda df: df.select(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_))
    named = docs.select("*", F.col(id_col).cast("long").alias(key), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(hash_))
    kept = named.join(own(classes.where("NOT is_first")).distinct(), [key, hash_], "left_anti")
    twice = own(classes.where("is_first")).groupBy(key, hash_).count().where("count > 1").drop("count")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return kept.select(*columns)
    order = F.to_json(F.struct(*columns))
    of = kept.join(twice, [key, hash_]).withColumn(nth, F.row_number().over(W.partitionBy(key, hash_).orderBy(order))).where(F.col(nth) == 1)
    return kept.join(twice, [key, hash_], "left_anti").select(*columns).union(of.select(*columns))
