"""Mixing sources to target weights, with DataFrame functions only.

Weights go down a tree, by default domain, language, source. At each node the budget is shared among its
children in proportion to weight, but none gets more than its subtree holds; what one can't use
goes to its siblings, and leaves the node only when all of them are full. This is exact water
filling: children in order of capacity over weight, one running sum. Each leaf then gives whole
epochs and a prefix of one more, in a seeded order of its own for every epoch.

A prefix ends before the document that would cross its leaf's budget. What is left over so is a shortage
too: at every node, from the leaves' parents up to the root, the leaves below it that have the
shortest crossing documents take these while the node's remainders last. So the whole misses its
target by less than one document.

Prefixes are cut by sums over 4,096 ranges of the order hash, then within the one range that the
cut falls into, so that no task sorts a whole leaf. Texts aren't shuffled: a row is kept or not by
its hash against its leaf's cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

_RANGES = 12  # bits of the order hash that name its range
_BITS = 60
#: Leaves that are broadcast at most; a longer table of cuts is joined by shuffling, each leaf in ``SALTS`` parts.
BROADCAST_LEAVES = 10_000
SALTS = 64
_FIRST = -(1 << 63)


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """60 bits of md5 over seed, epoch and id."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def word_tokens(text: Column) -> Column:
    """Number of runs without blank, tab or line end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \t\n\r]+")).cast("long")


def _weight(weights: Mapping, name: Column) -> Column:
    out = F.lit(float(weights.get(None, 1.0)))
    for key, value in weights.items():
        if key is not None:
            out = F.when(name == key, F.lit(float(value))).otherwise(out)
    return out


def _fill(children: DataFrame, parents: Sequence[str]) -> DataFrame:
    """Add ``alloc``: the share of ``budget`` of each child by ``weight``, at most its ``cap``."""
    group = W.partitionBy(*parents)
    live = F.when(F.col("weight") > 0, F.col("weight"))
    order = group.orderBy(F.col("ratio").asc_nulls_last(), "child")
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum(F.coalesce(live, F.lit(0.0))).over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = (
        children.withColumn("ratio", F.col("cap") / live)
        .withColumn("level", F.try_divide(F.col("budget") - before, open_))
        .withColumn("level", F.when(F.col("ratio") > F.col("level"), F.greatest("level", F.lit(0.0))))
        .withColumn("level", F.max("level").over(group))
    )
    return ranked.withColumn("alloc", F.when(F.col("ratio").isNull(), F.lit(0.0)).otherwise(F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))).drop("ratio", "level")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping], budget: Column, max_epochs: int) -> DataFrame:
    """Add ``alloc`` to leaves (levels, tokens), the tokens that each may give, and ``live``: no weight above it is 0."""
    live = F.lit(True)
    for name, own in zip(levels, weights):
        live = live & (_weight(own, F.col(name)) > 0)
    caps = leaves.withColumn("live", live).withColumn("cap", F.when(F.col("live"), F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    above = caps.agg(budget.cast("double").alias("alloc")).withColumn("_root", F.lit(0))
    for depth in range(1, len(levels) + 1):
        path, up = list(levels[:depth]), ["_root", *levels[: depth - 1]]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("_root", F.lit(0)).withColumn("child", F.col(path[-1])).withColumn("weight", _weight(weights[depth - 1], F.col(path[-1])))
        # each table is of nodes, so these joins are small; levels are never null here
        above = _fill(nodes.join(above.withColumnRenamed("alloc", "budget"), up), up).select("_root", *path, "alloc")
    return caps.drop("cap").join(above.drop("_root"), list(levels))


def mix_sources(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Sequence[Mapping],
    fraction: float = 0.5,
    max_epochs: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    epoch_col: str = "epoch",
) -> DataFrame:
    """Rows of ``docs`` that the target mixture holds, with all their columns and ``epoch_col``.

    ``levels`` maps the tree's level names to columns, root first; ``weights`` gives a mapping from
    node name to weight for each level (key None: every other name, 1 by default). The budget is
    ``fraction`` of all tokens. A row comes once for each epoch that it is part of.

    A null level counts as the empty name, a null or empty text has no tokens, a null id sorts first;
    rows of one id and leaf are kept or left together; a leaf without tokens gives one epoch; a weight
    of 0 gives nothing, and its share goes to its siblings; a text longer than its leaf's budget is
    taken only if remainders pay for it; an empty table gives an empty result. Columns of ``docs`` may
    have any name but ``epoch_col`` and those that start with ``_mix_``.
    """
    if epoch_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {epoch_col!r}: name another one for the epochs")
    names = [f"_mix_{k}" for k in levels]
    tokens = word_tokens(F.col("text")) if tokens is None else tokens
    keyed = docs.select("*", *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())), F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("_mix_id"))
    narrow = materialize(keyed.select(*names, "_mix_id", tokens.alias("_mix_tokens")), "mix-tokens")
    plan = materialize(_plan(narrow, names, weights, fraction, max_epochs, seed), "mix-plan")
    discard(narrow)
    if _small(plan):
        hashed = keyed.join(F.broadcast(plan), names)
    else:  # a leaf may hold a large part of all rows
        salted = plan.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hashed = keyed.withColumn("_mix_salt", F.pmod(F.xxhash64("_mix_id"), F.lit(SALTS)).cast("int")).join(salted, [*names, "_mix_salt"])
    own, key, cut, cut_id = order_hash(seed, F.col("_mix_full"), F.col("_mix_id")), F.col("_mix_id"), F.col("_mix_cut"), F.col("_mix_cut_id")
    within = (own < cut) | ((own == cut) & ((key < cut_id) | ((key == cut_id) & F.col("_mix_taken"))))
    times = F.col("_mix_full") + F.coalesce(within, F.lit(False)).cast("int")
    return hashed.withColumn("_mix_times", times).where("_mix_times > 0").select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(0), F.col("_mix_times") - 1)).alias(epoch_col))


def _small(plan: DataFrame) -> bool:
    return plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES


def _plan(narrow: DataFrame, names: list[str], weights: Sequence[Mapping], fraction: float, max_epochs: int, seed: int) -> DataFrame:
    """A row a leaf: whole epochs, hash and id of the next one's crossing document, and whether that is taken too."""
    leaves = materialize(narrow.groupBy(*names).agg(F.sum("_mix_tokens").alias("tokens")), "mix-leaves")
    budgets = leaf_budgets(leaves, names, weights, F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * fraction), max_epochs)
    size, given = F.greatest("tokens", F.lit(1)), F.when(F.col("tokens") > 0, F.floor(F.col("alloc") + 1e-6)).otherwise(0)
    full = F.when(F.col("tokens") > 0, F.floor(given / size)).when(F.col("live"), 1).otherwise(0).cast("int")
    plan = budgets.select(*names, full.alias("_mix_full"), F.when((F.col("tokens") > 0) & F.col("live") & (full < max_epochs), given % size).cast("long").alias("_mix_rest"), given.cast("long").alias("_mix_given"))
    plan = materialize(plan, "mix-budgets")
    small = _small(plan)
    part = plan.where("_mix_rest IS NOT NULL").drop("_mix_given")
    rows = narrow.join(F.broadcast(part) if small else part, names).withColumn("_h", order_hash(seed, F.col("_mix_full"), F.col("_mix_id"))).withColumn("_range", F.shiftright("_h", _BITS - _RANGES))
    sums = rows.groupBy(*names, "_mix_rest", "_range").agg(F.sum("_mix_tokens").alias("_sum"))
    upto = sums.withColumn("_upto", F.sum("_sum").over(W.partitionBy(*names).orderBy("_range")))
    # the first range that goes beyond the rest; those before it are whole
    cut = upto.where(F.col("_upto") > F.col("_mix_rest")).groupBy(*names).agg(F.min(F.struct("_range", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("c")).select(*names, "c.*")
    cut = materialize(cut, "mix-cuts")
    inner = rows.join(F.broadcast(cut) if small else cut, [*names, "_range"]).groupBy(*names, "_mix_rest", "_before", "_h", "_mix_id").agg(F.sum("_mix_tokens").alias("_size"))
    run = inner.withColumn("_run", F.col("_before") + F.sum("_size").over(W.partitionBy(*names).orderBy("_h", "_mix_id").rowsBetween(W.unboundedPreceding, 0)))
    crossing = run.where(F.col("_run") > F.col("_mix_rest")).groupBy(*names).agg(F.min(F.struct("_h", "_mix_id", "_size", (F.col("_mix_rest") - F.col("_run") + F.col("_size")).alias("_left"))).alias("x")).select(*names, "x.*")
    crossing = materialize(crossing, "mix-crossing")
    asked = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * fraction)).first()[0]
    given_out = plan.agg(F.coalesce(F.sum("_mix_given"), F.lit(0))).first()[0]
    taken = _redistribute(crossing, names, int(asked - given_out)).select(*names, F.col("_h").alias("_mix_cut"), F.col("_mix_id").alias("_mix_cut_id"), F.col("_taken").alias("_mix_taken"))
    return plan.join(taken, names, "left").select(*names, "_mix_full", "_mix_cut", "_mix_cut_id", F.coalesce("_mix_taken", F.lit(False)).alias("_mix_taken"))


def _redistribute(crossing: DataFrame, names: Sequence[str], fractions: int) -> DataFrame:
    """Add ``_taken`` to leaves (``_size`` of the crossing document, ``_left`` of the budget): siblings first, then ancestors."""
    out = crossing.withColumn("_taken", F.lit(False))
    for depth in range(len(names) - 1, -1, -1):
        group = W.partitionBy(*names[:depth]) if depth else W.partitionBy(F.lit(0))
        used = F.when(F.col("_taken"), F.col("_size")).otherwise(0)
        pool = F.sum(F.col("_left") - used).over(group) + (0 if depth else fractions)
        asked = F.sum(F.when(F.col("_taken"), 0).otherwise(F.col("_size"))).over(group.orderBy("_size", *names).rowsBetween(W.unboundedPreceding, 0))
        out = out.withColumn("_taken", F.col("_taken") | (asked <= pool))
    return out


#: Production mixture of the documents: where a source belongs, and the weights at each level.
DOMAIN = {"src0": "crawl", **{f"src{i}": "books" for i in range(1, 10)}}
WEIGHTS = ({"crawl": 0.3, "books": 0.4, "forum": 0.3}, {"en": 3.0, None: 1.0}, {})


def domain(source: Column) -> Column:
    return F.when(source == "src0", "crawl").when(source.rlike("^src[1-9]$"), "books").otherwise("forum")


def production_levels() -> dict[str, Column]:
    return {"domain": domain(F.coalesce(F.col("source"), F.lit(""))), "lang": F.col("lang"), "source": F.col("source")}


def mixture_sql(fraction: float, max_epochs: int, seed: int, docs: str = "documents", columns: str = "doc_id, epoch, domain, lang, source, n_tokens") -> str:
    """DuckDB SQL for the production mixture over ``docs``."""

    def fill(name: str, parent: str, key: str, weight: str, above: str) -> str:
        ps = f"{parent}, " if parent else ""
        using = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
        own = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_n AS (SELECT {ps}{key}, sum(cap) AS cap, any_value({weight})::DOUBLE AS w FROM leaf GROUP BY ALL),
{name}_r AS (SELECT n.*, budget, cap / w AS ratio, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM {name}_n n {using} WINDOW o AS ({own} ORDER BY cap / w, {key})),
{name}_l AS (SELECT *, max(CASE WHEN ratio > lv THEN greatest(lv, 0) END) OVER ({own}) AS level FROM {name}_r),
{name} AS (SELECT {ps}{key}, least(cap, coalesce(w * level, cap)) AS budget FROM {name}_l)"""

    return f"""
WITH d AS (SELECT *, coalesce(lang, '') AS l_, coalesce(source, '') AS s_, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(coalesce(source, ''), '^src[1-9]$') THEN 'books' ELSE 'forum' END AS d_,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens FROM {docs}),
leaf AS (SELECT d_, l_, s_, sum(n_tokens)::DOUBLE AS tokens, (sum(n_tokens) * {max_epochs})::DOUBLE AS cap FROM d GROUP BY ALL),
root AS (SELECT floor(sum(tokens) * {fraction}) AS budget FROM leaf),
{fill("domains", "", "d_", "CASE d_ WHEN 'crawl' THEN 0.3 WHEN 'books' THEN 0.4 ELSE 0.3 END", "root").strip()},{fill("langs", "d_", "l_", "CASE l_ WHEN 'en' THEN 3.0 ELSE 1.0 END", "domains")},{fill("sources", "d_, l_", "s_", "1.0", "langs")},
plan AS (SELECT d_, l_, s_, CASE WHEN tokens > 0 THEN floor(budget + 1e-6) ELSE 0 END::BIGINT AS given, CASE WHEN tokens > 0 THEN floor(floor(budget + 1e-6) / greatest(tokens, 1)) ELSE 1 END::BIGINT AS f_,
  CASE WHEN tokens > 0 THEN floor(budget + 1e-6) % greatest(tokens, 1) END::BIGINT AS rest FROM leaf JOIN sources USING (d_, l_, s_)),
ordered AS (SELECT d.*, coalesce(doc_id, {_FIRST}) AS id_, f_, rest, ('0x' || substr(md5('{seed}|' || f_ || '|' || coalesce(doc_id, {_FIRST})), 1, 15))::BIGINT AS h_ FROM d JOIN plan USING (d_, l_, s_)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY d_, l_, s_ ORDER BY h_, id_) AS run FROM ordered),
crossing AS (SELECT d_, l_, s_, min({{'h': h_, 'i': id_}}) FILTER (run > rest) AS at_, min(run) FILTER (run > rest) - coalesce(max(run) FILTER (run <= rest), 0) AS size, any_value(rest) - coalesce(max(run) FILTER (run <= rest), 0) AS rem
  FROM summed WHERE rest IS NOT NULL AND f_ < {max_epochs} GROUP BY ALL),
one AS (SELECT *, sum(size) OVER (PARTITION BY d_, l_ ORDER BY size, s_) <= sum(rem) OVER (PARTITION BY d_, l_) AS k1 FROM crossing),
two AS (SELECT *, k1 OR sum(CASE WHEN k1 THEN 0 ELSE size END) OVER (PARTITION BY d_ ORDER BY size, l_, s_) <= sum(rem - CASE WHEN k1 THEN size ELSE 0 END) OVER (PARTITION BY d_) AS k2 FROM one),
three AS (SELECT *, k2 OR sum(CASE WHEN k2 THEN 0 ELSE size END) OVER (ORDER BY size, d_, l_, s_) <= sum(rem - CASE WHEN k2 THEN size ELSE 0 END) OVER () + (SELECT budget FROM root) - (SELECT sum(given) FROM plan) AS k3 FROM two),
timed AS (SELECT o.*, f_ + CASE WHEN at_ IS NOT NULL AND ((h_, id_) < (at_.h, at_.i) OR (k3 AND h_ = at_.h AND id_ = at_.i)) THEN 1 ELSE 0 END AS times FROM ordered o LEFT JOIN three USING (d_, l_, s_))
SELECT {columns} FROM (SELECT * REPLACE (s_ AS source, l_ AS lang), d_ AS domain, unnest(range(0, times))::INTEGER AS epoch FROM timed)"""
