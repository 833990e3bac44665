"""Quality classifier: supervised subword embeddings.

A document's features are its words, pairs of neighbouring words, and the character n-grams (3 to 5,
with word bounds) of its words, each hashed to a bucket with a learned vector. The vectors are
averaged over the document, and a softmax over a linear map gives the classes. Buckets and map are
trained together by plain stochastic gradient descent in numpy, on a bounded sample of labelled rows.

The map is linear, so scoring needs only the product of a bucket's vector with the map: two numbers a
bucket. A worker keeps these sums for the words it has met, up to a bound of its memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, text_runs
from .units import HashIndex, give_back, grown, hash_spans, worker_store

BITS = 18
#: Passes over the training rows, the same for any number of them.
EPOCHS = 12
#: Labelled rows that the model is fitted on at most, and bytes of their texts.
TRAINING_ROWS, TRAINING_BYTES = 4000, 64 << 20
_U = np.uint64
_SEEDS = [_U(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ _SEEDS[seed]) * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(32)
    return ((h * _U(0xC4CEB9FE1A85EC53)) >> _U(64 - BITS)).astype(np.int64)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the runs without white space."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    begins = inside[1:-1] & ~inside[:-2]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(raw)]
    begins[bounds] = inside[1:-1][bounds]
    starts = np.flatnonzero(begins)
    spaces = np.flatnonzero(~inside[1:])  # the places after which no word goes on, the end too
    ends = spaces[np.searchsorted(spaces, starts)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, np.minimum(ends, offsets[doc + 1]), doc


def _ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word index and bucket of every character n-gram of the words, word bounds included."""
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # characters to the end of the word
    h = text * _SEEDS[4]
    out_word, out_bucket = [], []
    for n in range(2, 6):
        h = h[:-1] * _U(0x100000001B3) + text[n - 1 :]
        if n >= 3:
            at = np.flatnonzero(left[: len(h)] >= n)
            out_word.append(word[at])
            out_bucket.append(_bucket(h[at], n - 2))
    return np.concatenate(out_word), np.concatenate(out_bucket)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document (ascending) and bucket of every feature; for training."""
    starts, ends, doc = _words(raw, offsets)
    h = hash_spans(raw, starts, ends)
    data = raw.tobytes()
    word, gram = _ngrams([data[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]) if len(starts) else (np.zeros(0, np.int64),) * 2
    same = np.flatnonzero(doc[1:] == doc[:-1])
    docs = np.concatenate((doc, doc[word], doc[same]))
    buckets = np.concatenate((_bucket(h, 0), gram, _pairs(h, same)))
    order = np.argsort(docs, kind="stable")
    return docs[order], buckets[order]


def _pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _bucket(h[first] * _U(3) + h[first + 1] * _U(0x9E3779B97F4A7C15), 4)


@dataclass
class Model:
    """For each bucket its share of every class's logit, and the biases."""

    classes: tuple[int, ...]
    weights: np.ndarray  # (2 ** BITS, classes) float32
    bias: np.ndarray


def train(texts: Sequence[str], labels: Sequence[int], dimensions: int = 10, epochs: int = EPOCHS, rate: float = 10.0, batch: int = 8, seed: int = 11) -> Model:
    """Fit on whole texts in a fixed number of epochs.

    Without rows the model is indifferent; with one class it is sure."""
    classes = tuple(sorted(set(labels))) or (0, 1)
    k, rng = len(classes), np.random.default_rng(seed)
    if k == 1 or not len(texts):
        return Model(classes, np.zeros((1 << BITS, k), np.float32), np.zeros(k))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(texts), 50):
        data = [t.encode("utf-8", "surrogatepass") for t in texts[at : at + 50]]
        doc, bucket = features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        # one entry for each document and bucket, with its share of the document
        key, count = np.unique((doc << BITS) | bucket, return_counts=True)
        doc, total = key >> BITS, np.bincount(doc, minlength=len(data))
        buckets, shares = (key & ((1 << BITS) - 1)).astype(np.int32), (count / total[doc]).astype(np.float32)
        edge = np.searchsorted(doc, np.arange(len(data) + 1)).tolist()
        rows += [(buckets[lo:hi], shares[lo:hi]) for lo, hi in zip(edge, edge[1:])]
    y = np.searchsorted(classes, labels)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << BITS, dimensions)).astype(np.float32)
    out = np.zeros((dimensions, k), np.float32)
    bias = np.log(np.maximum(np.bincount(y, minlength=k), 1) / max(1, len(y))).astype(np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = [i for i in order[at : at + batch] if len(rows[i][0])]
            lr = rate * max(0.05, 1 - done / steps)
            done += batch
            hidden = np.array([rows[i][1] @ vectors[rows[i][0]] for i in pick]).reshape(len(pick), dimensions)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ out.T
            out -= lr / batch * (hidden.T @ p)
            bias -= 0.1 * lr / batch * p.sum(axis=0)
            for i, g in zip(pick, back):  # within a row buckets are distinct
                vectors[rows[i][0]] -= lr * rows[i][1][:, None] * g
    return Model(classes, vectors @ out, bias.astype(np.float64))


class Scorer:
    """Logits of documents; sums of the words it has met are kept, up to ``max_words``."""

    def __init__(self, model: Model, max_words: int = 150_000):
        self.model, self.max_words = model, max_words
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.sums = np.zeros((1024, len(self.model.classes)), np.float64)
        self.counts = np.zeros(1024, np.int64)

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        starts, ends, doc = _words(raw, offsets)
        if not len(starts):
            return np.tile(self.model.bias, (n, 1))
        h = hash_spans(raw, starts, ends)
        if self.index.count > self.max_words:
            self._clear()
        places = self.index.find(h)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            fresh, first = np.unique(h[missing], return_index=True)
            at = missing[first]
            data = raw.tobytes()
            word, gram = _ngrams([data[s:e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            lo, hi = self.index.count, self.index.count + len(fresh)
            self.sums, self.counts = grown(self.sums, hi), grown(self.counts, hi)
            for c in range(self.sums.shape[1]):
                self.sums[lo:hi, c] = np.bincount(word, self.model.weights[gram, c], len(fresh)) + self.model.weights[_bucket(fresh, 0), c]
            self.counts[lo:hi] = np.bincount(word, minlength=len(fresh)) + 1
            self.index.add(fresh, np.arange(lo, hi, dtype=np.int32))
            places[missing] = self.index.find(h[missing])
        same = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = _pairs(h, same)
        total = np.bincount(doc, self.counts[places], n) + np.bincount(doc[same], minlength=n)
        weights = self.model.weights
        logit = [(np.bincount(doc, self.sums[places, c], n) + np.bincount(doc[same], weights[pairs, c], n)) / np.maximum(total, 1) for c in range(weights.shape[1])]
        return np.column_stack(logit) + self.model.bias


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", positive: int = 1, keep: bool = False, score_col: str = "score") -> DataFrame:
    """Probability of the class ``positive`` as ``score_col``, beside the id, or all columns with ``keep``.

    Only the text decides. A null, empty or blank text gets the bias alone, the share of the class
    among the training rows; very long texts count whole; repeated rows get equal scores; a model
    without the class gives 0, one with no other class 1, and one of no rows 0.5; an empty table gives
    no rows. With ``keep``, ``score_col`` may not be a column of ``docs``, in any letter case.
    """
    if keep and score_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {score_col!r}: name another one for the score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(column: pa.Array) -> np.ndarray:
        m = shared.value
        scorer = worker_store(("scorer", id(m)), lambda: Scorer(m))
        raw, offsets = string_buffers(column)
        out = []
        for a, b in text_runs(offsets, 1 << 20):
            z = scorer.logits(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            out.append(p[:, m.classes.index(positive)] if positive in m.classes else np.zeros(len(p)))
        give_back()
        return np.concatenate(out) if out else np.zeros(0)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(scores(text), pa.float64())

    value = score(F.col(text_col).cast("string"))
    return docs.withColumn(score_col, value) if keep else docs.select(F.col(id_col).cast("long").alias("doc_id"), value.alias(score_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAINING_ROWS, max_bytes: int = TRAINING_BYTES) -> list[tuple[int, str, int]]:
    """Id, text and label of the rows to learn from: not held out, at most ``max_rows`` by a hash of the id.

    Of these, in the order of the hash, all texts that fit into ``max_bytes`` together, whole; a text that
    doesn't is passed over. Of several texts of one id the smallest counts, and each of its labels. The
    bounds hold for any input: tasks send their own first rows only, then sizes, then the chosen texts.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    order: dict[int, list[int]] = {}
    for row in chosen.collect():
        order.setdefault(row["_id"], []).append(row["_label"])
    if not order:
        return []
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    wanted = lambda ids: texts.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "_id long")), "_id")
    sizes = {r["_id"]: r["n"] for r in wanted(order).groupBy("_id").agg(F.max(F.octet_length("_text")).alias("n")).collect()}
    ids, used = [], 0
    for i in order:
        if i in sizes and used + sizes[i] <= max_bytes:
            ids.append(i)
            used += sizes[i]
    found = {r["_id"]: r["_text"] for r in wanted(ids).groupBy("_id").agg(F.min("_text").alias("_text")).collect()} if ids else {}
    return sorted((i, found[i], label) for i in ids for label in order[i])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAINING_ROWS, max_bytes: int = TRAINING_BYTES, **options) -> Model:
    """Train on a bounded number of labelled rows (see ``training_rows``), in numpy on the driver."""
    rows = training_rows(docs, labels, label_col, id_col, text_col, max_rows, max_bytes)
    model = train([t for _, t, _ in rows], [y for _, _, y in rows], **options)
    give_back()
    return model
