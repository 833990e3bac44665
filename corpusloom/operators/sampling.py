"""Sampling, mixing by ratio, packing in order, and masking."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import sliced
from ..storage import materialize
from .numbering import number_rows
from .profile import percentiles


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of seed and keys, the same on every engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def random_sample(df: DataFrame, id_col: str, factor: float = 0.5, seed: int = 0) -> DataFrame:
    return df.where(uniform(seed, F.col(id_col)) <= factor)


def stepwise(perplexity: Column, boundaries: tuple[float, float, float], factor: float = 1.5e5) -> Column:
    """Chance of keeping: factor over the width of the quartile that the perplexity is in."""
    a, b, c = boundaries
    return F.when(perplexity <= a, factor / a).when(perplexity <= b, factor / (b - a)).when(perplexity <= c, factor / (c - b)).otherwise(factor / (10 * c))


def gaussian(perplexity: Column, middle: float, width: float = 4.5, factor: float = 0.78) -> Column:
    z = (perplexity - middle) / middle
    return factor * F.exp(-(1 / width) * z * z)


def perplexity_sample(df: DataFrame, id_col: str, chance: Column, seed: int = 0) -> DataFrame:
    return df.where(uniform(seed, F.col(id_col)) <= chance)


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """The three exact quartile boundaries."""
    return percentiles(df, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@dataclass(frozen=True)
class SamplingArguments:
    """How a corpus is sampled: none, random, step or gauss, with the quartile boundaries as text "a,b,c"."""

    method: str = "none"
    boundaries: str = "536394.99320948,662247.50212365,919250.87225178"
    factor: float | None = None
    width: float = 4.5

    def bounds(self) -> tuple[float, float, float]:
        a, b, c = (float(x) for x in self.boundaries.split(","))
        return a, b, c

    def chance(self, perplexity: Column) -> Column:
        """Chance that a row is kept."""
        if self.method == "none":
            return F.lit(1.0)
        if self.method == "random":
            return F.lit(0.5 if self.factor is None else self.factor)
        if self.method == "step":
            return stepwise(perplexity, self.bounds(), 1.5e5 if self.factor is None else self.factor)
        if self.method == "gauss":
            return gaussian(perplexity, self.bounds()[1], self.width, 0.78 if self.factor is None else self.factor)
        raise ValueError(f"unknown method {self.method!r}")


def shuffled(df: DataFrame, id_col: str, n: int, seed: int = 2021) -> DataFrame:
    """The first ``n`` rows of a random order."""
    return df.withColumn("_u", uniform(seed, F.col(id_col))).orderBy("_u", id_col).limit(n).drop("_u")


def per_bucket(df: DataFrame, id_col: str, value: str, width: float = 100.0, highest: float = 1000.0, cap: int = 100, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each bucket of values, those up to ``highest`` only."""
    bucket = (F.floor(F.col(value) / width) * width).alias("bucket")
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("_u", id_col))
    return df.select("*", bucket, uniform(seed, F.col(id_col)).alias("_u")).where(F.col("bucket") <= highest).withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r", "_u")


_RANGES = 4096


def mix_by_ratio(df: DataFrame, id_col: str, source: str, ratios: Mapping[str, float], default: float = 1.0, seed: int = 42) -> DataFrame:
    """int(n * ratio) rows of each source, those of the smallest hashes; equal ones go by id.

    Rows are counted by source and range of the hash, and only the range that a source's cut falls into is
    sorted, of ids alone. Rows themselves aren't moved: each is held against its source's cut.
    """
    ratio = F.lit(default)
    for name, value in ratios.items():
        ratio = F.when(F.col("_s") == name, F.lit(value)).otherwise(ratio)
    u = uniform(seed, F.col(id_col))
    narrow = materialize(df.select(F.col(source).alias("_s"), F.col(id_col).alias("_id"), u.alias("_u")).withColumn("_r", F.floor(F.col("_u") * _RANGES).cast("int")), "mix-hashes")
    counts = materialize(narrow.groupBy("_s", "_r").agg(F.count(F.lit(1)).alias("_k")), "mix-counts")
    wanted = counts.groupBy("_s").agg(F.sum("_k").alias("_n")).select("_s", F.floor(F.col("_n") * ratio).alias("_want"))
    upto = counts.withColumn("_upto", F.sum("_k").over(W.partitionBy("_s").orderBy("_r"))).join(wanted, "_s")
    cut = upto.where((F.col("_upto") >= F.col("_want")) & (F.col("_want") > 0)).groupBy("_s").agg(F.min(F.struct("_r", (F.col("_want") - F.col("_upto") + F.col("_k")).alias("_left"))).alias("c")).select("_s", "c.*")
    inner = narrow.join(cut, ["_s", "_r"]).withColumn("_nth", F.row_number().over(W.partitionBy("_s").orderBy("_u", "_id")))
    last = materialize(inner.where(F.col("_nth") == F.col("_left")).select(F.col("_s"), F.col("_u").alias("_cut"), F.col("_id").alias("_cut_id")), "mix-cuts")
    joined = df.withColumn("_s", F.col(source)).join(F.broadcast(last) if last.limit(10_001).count() <= 10_000 else last, "_s")
    return joined.where((u < F.col("_cut")) | ((u == F.col("_cut")) & (F.col(id_col) <= F.col("_cut_id")))).select(*df.columns)


def strided(df: DataFrame, id_col: str, n: int, k: int) -> DataFrame:
    """Shard ``k`` of ``n``: every n-th row in the order of the id."""
    return number_rows(df, id_col, name="_r").where(F.col("_r") % n == k).drop("_r")


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """min(n, rows) rows of a random order."""
    return shuffled(df, id_col, n, seed)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in an order; fewer where there are fewer."""
    return df.orderBy(order).limit(n)


def batch_splits(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows of whole batches of ``size`` in an order, with ``batch`` and ``place``; the rest of the last one is dropped."""
    numbered = number_rows(df, order, name="_r")
    whole = df.count() // size * size
    return numbered.where(F.col("_r") < whole).withColumn("batch", F.floor(F.col("_r") / size)).withColumn("place", F.col("_r") % size).drop("_r")


def pack_sequences(df: DataFrame, id_col: str, tokens: Column, length: int, batch: int = 1000) -> DataFrame:
    """Tokens of each batch of rows one after another, cut to ``length``; a batch's rest is dropped.

    Rows are numbered by ``id_col // batch``: batch, seq, tokens.
    """
    rows = df.select(F.floor(F.col(id_col) / batch).alias("batch"), F.col(id_col).alias("_id"), F.posexplode(tokens).alias("_pos", "token"))
    at = F.row_number().over(W.partitionBy("batch").orderBy("_id", "_pos")) - 1
    cut = rows.withColumn("_at", at).withColumn("seq", F.floor(F.col("_at") / length))
    packed = cut.groupBy("batch", "seq").agg(F.array_sort(F.collect_list(F.struct("_at", "token"))).alias("t"))
    return packed.where(F.size("t") == length).select("batch", "seq", F.transform("t", lambda x: x["token"]).alias("tokens"))


def mask_tokens(ids: Column, row: Column, mask_id: int, vocabulary: int, special: tuple[int, ...] = (), chance: float = 0.15, seed: int = 0) -> Column:
    """Masked-language-model inputs: of chosen tokens 80 % are masked, 10 % random; labels -100 elsewhere."""

    def both(tokens: list, key: list) -> list[tuple]:
        out = []
        for t, k in zip(tokens, key):
            rng = np.random.default_rng([seed, int(k)])
            t = np.asarray(t if t is not None else [], np.int64)
            pick = (rng.random(len(t)) < chance) & ~np.isin(t, special)
            how = rng.random(len(t))
            new = np.where(pick & (how < 0.8), mask_id, np.where(pick & (how >= 0.9), rng.integers(0, vocabulary, len(t)), t))
            out.append((new.tolist(), np.where(pick, t, -100).tolist()))
        return out

    return sliced("ids array<int>, labels array<int>", both)(ids, row)
