"""Exact, line-level and SimHash deduplication."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import sliced
from ..storage import materialize
from .components import components


def anti_join_hot(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int, share: int = 2000) -> DataFrame:
    """Rows whose key isn't among ``keys`` (one row a key, with how many rows have it in ``size``).

    Keys of more than ``total / share`` rows are fewer than ``share``, so they are broadcast and their
    rows go without being moved; what is left has no hot key and is joined by shuffling.
    """
    limit = max(1000, total // share)
    cold = rows.join(F.broadcast(keys.where(F.col(size) > limit).select(*on)), on, "left_anti")
    return cold.join(keys.where(F.col(size) <= limit).select(*on), on, "left_anti")


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int, share: int = 2000) -> DataFrame:
    """Inner join with one row a key, in the same way."""
    limit = max(1000, total // share)
    hot = F.broadcast(keys.where(F.col(size) > limit))
    few = rows.join(F.broadcast(keys.where(F.col(size) > limit).select(*on)), on, "left_anti").join(keys.where(F.col(size) <= limit), on)
    return rows.join(hot, on).unionByName(few)


def document_key(text: Column) -> Column:
    """SHA-256 of the text without blanks."""
    return F.sha2(F.replace(text, F.lit(" "), F.lit("")).cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", key: Column | None = None) -> DataFrame:
    """The row of the smallest id for each key.

    Only ids and keys are shuffled to find what goes; rows that stay aren't moved by key.
    """
    keyed = docs.select(F.col(id_col), (document_key(F.col(text)) if key is None else key).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(id_col).alias(id_col))
    return docs.join(first.select(id_col), id_col, "left_semi")


def duplicate_fraction(docs: DataFrame, text: str = "text") -> DataFrame:
    keys = docs.groupBy(document_key(F.col(text)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("distinct_documents"), (1 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_fraction"))


def duplicate_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.groupBy(F.md5(F.col(text).cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line: id, pos, line and its normalized key."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("h", T.line_key(F.col("line")))


def sentence_frame(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line, with its place."""
    return docs.select(F.col(id_col), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "sentence"))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """Key of every line and whether two documents have it; within ``group`` if that is given."""
    by = [group] if group else []
    per_doc = lines(docs.select(*by, id_col, text), id_col, text) if not by else docs.select(*by, id_col, F.explode(F.split(text, "\n")).alias("line")).withColumn("h", T.line_key(F.col("line")))
    return per_doc.select(*by, id_col, "h").distinct().groupBy(*by, "h").agg((F.count(F.lit(1)) > 1).alias("duplicate"))


def merge_hashes(*sets: DataFrame) -> DataFrame:
    """Union of hash sets; a key in two of them is a duplicate."""
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return out.groupBy("h").agg(((F.count(F.lit(1)) > 1) | F.max("duplicate")).alias("duplicate"))


def _rebuild(docs: DataFrame, kept: DataFrame, id_col: str, text: str, keep_empty: bool) -> DataFrame:
    parts = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    new = parts.select(id_col, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("_text"), F.transform("_l", lambda x: x["pos"]).alias("line_ids"))
    out = docs.join(new, id_col, "left" if keep_empty else "inner")
    n = lambda c: F.when(F.length(c) > 0, F.size(F.split(c, "\n"))).otherwise(0)
    return out.select(
        *[c for c in docs.columns if c != text],
        F.coalesce("_text", F.lit("")).alias(text),
        F.coalesce(F.size("line_ids"), F.lit(0)).alias("nlines"),
        F.length(F.coalesce("_text", F.lit(""))).alias("length"),
        n(F.col(text)).alias("original_nlines"),
        F.length(text).alias("original_length"),
        F.coalesce("line_ids", F.array().cast("array<int>")).alias("line_ids"),
    )


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """Two passes: lines that several documents have go everywhere; within a document the first copy stays.

    With ``group`` only documents of one group are held against each other. Documents without a line
    left go. A line counts once a document before anything is shuffled; keys that a large part of
    the documents has are few and broadcast, all others are joined by shuffling.
    """
    by = [group] if group else []
    first = docs.select(*by, id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("h", T.line_key(F.col("line"))).groupBy(*by, id_col, "h").agg(F.min(F.struct("pos", "line")).alias("x")).select(*by, id_col, "h", "x.*")
    first = materialize(first, "first-lines")
    shared = materialize(first.groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-lines")
    return _rebuild(docs, anti_join_hot(first, shared, [*by, "h"], "n", first.count()).drop(*by), id_col, text, keep_empty=False)


def keep_first_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_empty: bool = False) -> DataFrame:
    """One pass: of all lines with a key the first stays, in the order of id and position."""
    first = lines(docs, id_col, text).groupBy("h").agg(F.min(F.struct(id_col, "pos", "line")).alias("x")).select("x.*")
    return _rebuild(docs, first, id_col, text, keep_empty)


def first_of_groups(rows: DataFrame, group: str, id_col: str, order: Column, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, then by id; ids are unique within a group.

    Only ids are ranked, in rounds: first within parts of a group, then what is left of eight parts
    together, so no task ranks more than some ``n`` ids at once. Rows themselves stay where they are,
    unless ids are too many to be broadcast.
    """
    total = rows.count()
    if total <= n:
        return rows
    left, parts = rows.select(group, id_col, order.alias("_o"), F.xxhash64(id_col).alias("_p")), -(-total // (20 * n))
    while True:
        by = [F.pmod("_p", F.lit(parts))] if parts > 1 else []
        left = left.withColumn("_r", F.row_number().over(W.partitionBy(group, *by).orderBy("_o", id_col))).where(F.col("_r") <= n).drop("_r")
        if parts <= 1:
            break
        parts = -(-parts // 8)
    left = materialize(left.select(group, id_col), "first-of-groups")
    same = rows.select(*rows.columns, F.col(group).alias("_g"), F.col(id_col).alias("_k"))
    chosen = left.select(F.col(group).alias("_h"), F.col(id_col).alias("_l"))
    few = left.limit(500_001).count() <= 500_000
    return same.join(F.broadcast(chosen) if few else chosen, F.col("_g").eqNullSafe(F.col("_h")) & F.col("_k").eqNullSafe(F.col("_l")), "left_semi").select(*rows.columns)


def boilerplate_lines(
    docs: DataFrame, group: str, id_col: str = "doc_id", text: str = "text", sample: int = 10_000, share: float = 0.01, least: int = 10, seed: int | None = 42, distinct: bool = True, pages_once: bool = True, bound: str = "greatest"
) -> DataFrame:
    """Lines of a site that more sampled pages have than a bound: group, line, n.

    The bound is the greatest (or ``least``) of ``least`` and ``share`` of the pages. ``sample`` is the
    operator's own: a hash of the id chooses the pages of each group, or without ``seed`` their order.
    ``distinct`` counts a line once a page; ``pages_once`` counts equal pages once.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col)).cast("binary")) if seed is not None else F.lit("")
    pages = first_of_groups(docs.select(group, id_col, text), group, id_col, order, sample)
    if pages_once:
        pages = pages.groupBy(group, text).agg(F.min(id_col).alias(id_col))
    of = F.transform(F.split(text, "\n"), T.strip)
    counts = pages.select(group, F.explode(F.array_distinct(of) if distinct else of).alias("line")).groupBy(group, "line").agg(F.count(F.lit(1)).alias("n"))
    total = pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages"))
    limit = getattr(F, bound)(F.lit(float(least)), F.col("pages") * share)
    return counts.join(total, group).where(F.col("n") > limit).select(group, "line", "n")


def drop_boilerplate(docs: DataFrame, skip: DataFrame, group: str, id_col: str = "doc_id", text: str = "text", least_chars: int = 32) -> DataFrame:
    """Documents without the lines to skip; those of ``least_chars`` or fewer that are left go.

    A group's lines to skip are collected to one map, so documents aren't taken apart: there are at most
    some for each hundred lines of the sampled pages.
    """
    lines_ = skip.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("line", F.lit(True)))).alias("_skip"))
    kept = lambda m: F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: ~F.coalesce(F.map_contains_key(m, x), F.lit(False)))
    new = T.strip(F.array_join(T.let(F.col("_skip"), kept), "\n"))
    joined = docs.join(F.broadcast(lines_) if lines_.count() <= 1000 else lines_, group, "left")
    return joined.withColumn("_text", new).where(F.length("_text") > least_chars).select(*[F.col("_text").alias(text) if c == text else F.col(c) for c in docs.columns])


def keep_one_of_frequent(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = 10_000, share: float = 0.01, least: int = 10, seed: int = 42, apply: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Of lines that many pages have only the first copy, in the order of id and place, stays; also those lines.

    Lines are stripped. Pages count as often as they come. ``apply`` says which rows are filtered (all by
    default); other rows stay as they are and don't count as a first copy.
    """
    every = docs.withColumn("_all", F.lit(1))
    skip = boilerplate_lines(every, "_all", id_col, text, sample, share, least, seed, pages_once=False).select("line", "n")
    skip = materialize(skip, "frequent-lines")
    on = F.lit(True) if apply is None else apply
    each = docs.where(on).select(id_col, F.posexplode(F.transform(F.split(text, "\n"), T.strip)).alias("pos", "line"))
    frequent = each.join(F.broadcast(skip.select("line")), "line", "left_semi") if skip.count() <= 10_000 else each.join(skip.select("line"), "line", "left_semi")
    first = frequent.groupBy("line").agg(F.min(F.struct(id_col, "pos")).alias("f")).select("line", f"f.{id_col}", "f.pos")
    # of a document only its later copies are marked, so all other lines stay where they are
    later = frequent.join(first.select(id_col, "pos", F.lit(True).alias("first")), [id_col, "pos"], "left").where("first IS NULL").groupBy(id_col).agg(F.collect_set("pos").alias("_later"))
    lines_ = F.transform(F.split(text, "\n"), lambda x, i: F.struct(T.strip(x).alias("line"), i.alias("i")))
    kept = F.transform(F.filter(lines_, lambda x: ~F.coalesce(F.array_contains("_later", x["i"]), F.lit(False))), lambda x: x["line"])
    new = F.when(on, T.strip(F.array_join(kept, "\n"))).otherwise(F.col(text))
    out = docs.join(later, id_col, "left").select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns])
    return out, skip


def first_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", spare: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines stripped, empty ones out, of all others the first copy stays; rows may become empty, and stay.

    ``spare`` says which rows are left as they are. Also the lines that come more than once, with how often.
    """
    free = F.lit(False) if spare is None else F.coalesce(spare, F.lit(False))
    each = docs.where(~free).select(id_col, F.posexplode(F.transform(F.split(text, "\n"), T.strip)).alias("pos", "line")).where("line <> ''")
    counts = materialize(each.groupBy("line").agg(F.min(F.struct(id_col, "pos")).alias("f"), F.count(F.lit(1)).alias("n")), "line-copies")
    kept = counts.select(f"f.{id_col}", "f.pos", "line").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    new = F.when(free, F.col(text)).otherwise(F.coalesce(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("")))
    out = docs.join(kept, id_col, "left").select(*[new.alias(text) if c == text else F.col(c) for c in docs.columns])
    return out, counts.where("n > 1").select("line", "n")


def latest(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last row of each key by ``order``, then the smallest ``tie``."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), tie))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


# -- SimHash -----------------------------------------------------------------


def _simhash(tokens: list[str]) -> int:
    if not tokens:
        return 0
    raw = b"".join([hashlib.md5(t.encode()).digest()[:8] for t in tokens])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="big").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(tokens)).view(">i8")[0])


def simhash(text: Column, window: int = 6, whole_windows: bool = False) -> Column:
    """64-bit SimHash over windows of words, of MD5's first eight bytes each.

    Unless ``whole_windows``, the last window is left out, so short texts have no token and hash 0.
    """

    def hashes(texts: list) -> list[int]:
        out = []
        for t in texts:
            w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
            out.append(_simhash([" ".join(w[i : i + window]) for i in range(max(0, len(w) - window + whole_windows))]))
        return out

    return sliced("long", hashes)(F.lower(text))


def hamming_pairs(hashes: DataFrame, most: int = 4, blocks: int = 6, hash_col: str = "h") -> DataFrame:
    """Pairs of distinct hashes within ``most`` differing bits: a, b, distance.

    Of ``blocks`` blocks of bits at least ``blocks - most`` are equal, so each choice of that many is an
    equi-join on a hash of those; what the hash brings together by chance fails the count of bits.
    """
    width = [(64 * i // blocks, 64 * (i + 1) // blocks) for i in range(blocks)]
    part = lambda c, i: F.shiftrightunsigned(c, width[i][0]).bitwiseAND(F.lit((1 << (width[i][1] - width[i][0])) - 1))
    distinct = hashes.select(F.col(hash_col).alias("h")).distinct()
    keys = F.array(*(F.xxhash64(F.lit(n), *(part(F.col("h"), i) for i in chosen)) for n, chosen in enumerate(combinations(range(blocks), blocks - most))))
    keyed = distinct.select("h", F.explode(keys).alias("k"))
    # Spark takes the keys for as few as the hashes and would send them all through the driver: no broadcast
    joined = keyed.select("k", F.col("h").alias("a")).hint("merge").join(keyed.select("k", F.col("h").alias("b")), "k").where("a < b")
    return joined.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance")).where(F.col("distance") <= most).distinct()


def hash_clusters(pairs: DataFrame, hashes: DataFrame, id_col: str = "doc_id", hash_col: str = "h", include_exact: bool = False) -> DataFrame:
    """Cluster of each document: the smallest hash of its component, null without a neighbour.

    Documents that share one hash and have no other neighbour have none either, unless ``include_exact``.
    """
    label = components(pairs, "a", "b").withColumnRenamed("node", hash_col).withColumnRenamed("label", "cluster")
    out = hashes.join(label, hash_col, "left")
    if include_exact:
        twice = hashes.groupBy(hash_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n").withColumn("_twice", F.lit(True))
        out = out.join(twice, hash_col, "left").withColumn("cluster", F.coalesce("cluster", F.when(F.col("_twice"), F.col(hash_col))))
    return out.select(id_col, hash_col, "cluster")


def cluster_report(clusters: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of clusters of each size, and the longest text among them."""
    sizes = clusters.where(F.col("cluster").isNotNull()).join(docs.select(id_col, F.length(text).alias("_n")), id_col).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max("_n").alias("longest"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"), F.max("longest").alias("longest"))


def distance_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("distance").agg(F.count(F.lit(1)).alias("n"))


def distance_examples(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """A few document pairs of each distance, with both texts: those of the smallest ids."""
    rank = F.row_number().over(W.partitionBy("distance").orderBy("id_a", "id_b"))
    few = F.broadcast(pairs.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r"))
    one = docs.select(F.col(id_col).alias("id_a"), F.col(text).alias("text_a"))
    two = docs.select(F.col(id_col).alias("id_b"), F.col(text).alias("text_b"))
    return two.join(one.join(few, "id_a"), "id_b").select("distance", "id_a", "id_b", "text_a", "text_b")


def document_pairs(pairs: DataFrame, hashes: DataFrame, id_col: str = "doc_id", hash_col: str = "h", include_exact: bool = False) -> DataFrame:
    """Unordered document pairs of matching hashes: id_a < id_b, distance."""
    left = hashes.select(F.col(hash_col).alias("a"), F.col(id_col).alias("x"))
    right = hashes.select(F.col(hash_col).alias("b"), F.col(id_col).alias("y"))
    out = pairs.join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "distance")
    if include_exact:
        same = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(0).alias("distance"))
        out = out.unionByName(same)
    return out.distinct()


def representative_pairs(pairs: DataFrame, hashes: DataFrame, id_col: str = "doc_id", hash_col: str = "h") -> DataFrame:
    """All document pairs of matching or equal hashes without writing each out: id_a < id_b, distance.

    The smallest id of a hash stands for its documents. A row of distance 0 gives a member of id_a's
    hash; any other row stands for all pairs of a document of id_a's hash and one of id_b's. So there is
    a row a document or a pair of hashes at most, however many documents share one.
    """
    first = hashes.groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("x"))
    near = pairs.join(first.select(F.col("h").alias("a"), "x"), "a").join(first.select(F.col("h").alias("b"), F.col("x").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "distance")
    same = hashes.select(F.col(hash_col).alias("h"), F.col(id_col).alias("y")).join(first, "h").where("x < y")
    return near.unionByName(same.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(0).alias("distance")))


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` characters: windows of 1, 2, 4, .. are joined to those."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    join = lambda a, b: (k := (a[: len(b)] ^ (a[: len(b)] >> np.uint64(29))) * mix + b) ^ (k >> np.uint64(32))
    part, span, key, have = codes.astype(np.uint64) * mix, 1, None, 0
    while span <= width:
        if width & span:
            key = part if key is None else join(key, part[have:])
            have += span
        part, span = join(part, part[span:]), span * 2
    return key[: max(0, len(codes) - width + 1)]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """Ranges of characters whose windows of ``width`` occur at least twice in the corpus: id, begin, end.

    Overlapping windows are merged into one range. First only those hashes of half as wide windows are
    shuffled that are least among ``width - width // 2 + 1`` neighbours: every window of ``width`` has
    such a pick, and equal windows have the same, so documents without a pick that comes twice have no repeat.
    What may have one then sends all its windows as 8-byte hashes; a hash that comes twice is a repeat.
    """
    half = max(1, width // 2)
    reach = width - half + 1
    names = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.length("t") >= width)

    def windows(t: str, wide: int = width) -> np.ndarray:
        return _hashes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), wide).view(np.int64)

    def picks(texts: list) -> list:
        out = []
        for t in texts:
            h = windows(t, half)
            view = np.lib.stride_tricks.sliding_window_view(h, min(reach, len(h)))
            out.append(h[np.unique(view.argmin(axis=1) + np.arange(len(view)))])
        return out

    picks = sliced("array<long>", picks, 20)
    picked = names.select("id", F.explode(picks("t")).alias("w"))
    twice = materialize(picked.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "picked-windows")
    some = materialize(join_hot(picked, twice, ["w"], "n", twice.agg(F.sum("n")).first()[0] or 0).select("id").distinct(), "repeating-documents")

    def all_windows(batches):
        """Windows of a text as they are made, one text after another: never an object a window."""
        for batch in batches:
            for key, t in zip(batch["id"].to_pylist(), batch["t"]):
                w = windows(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), key)), pa.array(w), pa.array(np.arange(len(w), dtype=np.int32))], ["id", "w", "pos"])

    rows = materialize(names.join(some, "id", "left_semi").mapInArrow(all_windows, "id long, w long, pos int"), "windows")
    shared = materialize(rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-windows")
    hit = join_hot(rows, shared, ["w"], "n", rows.count()).select("id", "pos")
    order = W.partitionBy("id").orderBy("pos")
    start = F.when(F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(width + 1)) > width, 1).otherwise(0)
    island = hit.withColumn("_s", start).withColumn("_i", F.sum("_s").over(order))
    return island.groupBy("id", "_i").agg(F.min("pos").alias("begin"), (F.max("pos") + width).alias("end")).select(F.col("id").alias(id_col), "begin", "end")
