"""Profiles of columns: presence, labels, histograms, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..storage import materialize


def percentiles(df: DataFrame, value: str, at: dict[str, float], group: str | None = None, accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles with interpolation, a column each (and the group): no task holds all values.

    Approximate ones bracket each exact one; of the values in a bracket those that differ are counted, of
    those below it only how many they are. Nulls are left out.
    """
    margin = 2 / accuracy
    own = F.lit(0) if group is None else F.col(group)
    rows = df.select(own.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    near = lambda q: F.percentile_approx("_v", F.lit(min(1.0, max(0.0, q))), accuracy)
    edges = [e for i, q in enumerate(at.values()) for e in (near(q - margin).alias(f"_lo{i}"), near(q + margin).alias(f"_hi{i}"))]
    stats = materialize(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), *edges), "brackets")
    small = stats.limit(10_001).count() <= 10_000
    met = rows.join((F.broadcast(stats) if small else stats).withColumnRenamed("_g", "_k"), F.col("_g").eqNullSafe(F.col("_k")))
    # ranks may fall one beside a bracket, so the nearest values on both sides of it are kept too
    side = lambda i: F.when(F.col("_v") < F.col(f"_lo{i}"), -1).when(F.col("_v") > F.col(f"_hi{i}"), 1).otherwise(0)
    seen = F.array(*(F.struct(F.lit(i).alias("i"), side(i).alias("side"), F.when(side(i) == 0, F.col("_v")).alias("v")) for i in range(len(at))))
    counts = met.select("_g", "_n", "_v", F.explode(seen).alias("x")).groupBy("_g", "_n", "x.i", "x.side", "x.v").agg(F.count(F.lit(1)).alias("k"), F.max("_v").alias("most"), F.min("_v").alias("least"))
    counts = counts.withColumn("v", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))
    upto = counts.withColumn("_upto", F.sum("k").over(W.partitionBy("_g", "i").orderBy("side", "v")))
    place = F.element_at(F.array(*map(F.lit, at.values())), F.col("i") + 1) * (F.col("_n") - 1)
    at_rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col("v")))
    found = upto.groupBy("_g", "i").agg(at_rank(F.floor(place)).alias("a"), at_rank(F.ceil(place)).alias("b"), F.first(place - F.floor(place)).alias("f"))
    wide = found.groupBy("_g").agg(*(F.max(F.when(F.col("i") == i, F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))).alias(name) for i, name in enumerate(at)))
    return wide.withColumnRenamed("_g", group) if group else wide.drop("_g")


def describe(df: DataFrame) -> DataFrame:
    """One row a column: how often it is present, mean length of strings, mean, least and most of numbers."""
    rows = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        text = c if isinstance(field.dataType, T.StringType) else F.lit(None).cast("string")
        number = c.cast("double") if isinstance(field.dataType, T.NumericType) else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(field.name).alias("name"), F.count(c).alias("seen"), F.avg(F.length(text)).alias("mean_length"), F.avg(number).alias("mean"), F.min(number).alias("least"), F.max(number).alias("most")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def top_values(df: DataFrame, column: str, n: int = 100, least: int = 5) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "value").limit(n)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, weight: Column | None = None, cumulative: bool = False) -> DataFrame:
    """Counts of equal bins; the last one is closed, values outside are left out."""
    v = F.col(value)
    at = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    out = df.where((v >= lo) & (v <= hi)).groupBy(at.alias("bin")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    return out.withColumn("n", F.sum("n").over(W.orderBy("bin"))) if cumulative else out


def automatic_bins(df: DataFrame, value: str) -> DataFrame:
    """Number of bins by the wider of Sturges' and the Freedman-Diaconis rule."""
    v = F.col(value)
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).join(F.broadcast(percentiles(df, value, {"q1": 0.25, "q3": 0.75})), F.lit(True))
    sturges = (F.col("hi") - F.col("lo")) / (F.log2("n") + 1)
    fd = 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return s.select("n", "lo", "hi", F.greatest(F.ceil((F.col("hi") - F.col("lo")) / width), F.lit(1)).cast("int").alias("bins"))


def bar_chart(rows: list[tuple[int, float]], edges: list[float], width: int = 80) -> str:
    """Text bars; bins like the one before are left out."""
    most = max((n for _, n in rows), default=0)
    out, before = [], None
    for k, n in rows:
        bar = round(width * n / most) if most else 0
        if bar != before:
            out.append(f"{edges[k]:8.3f} " + "*" * bar + f" {n:g}")
        before = bar
    return "\n".join(out)


def checksum(df: DataFrame) -> DataFrame:
    """Order-free checksum: rows, and the sum of the first 8 hexadecimal digits of each row's MD5."""
    row = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("long")).alias("checksum"))


def display_stats(df: DataFrame, columns: list[str], top: int = 100, least: int = 5, longest: int = 100) -> DataFrame:
    """A row a column: share of rows that have it, mean length, and its most frequent values with their counts.

    Values are listed where they are short on average and one comes more than once.
    """
    out, total = None, df.count()
    for name in columns:
        text = F.col(f"`{name}`").cast("string")
        counts = df.where(text.isNotNull()).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "value").limit(top)
        whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen"), F.floor(F.sum(F.length("value") * F.col("n")) / F.sum("n")).alias("mean_length"), F.max("n").alias("most"))
        lists = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value"))).alias("v"))
        row = whole.join(F.broadcast(lists), F.lit(True)).select(
            F.lit(name).alias("name"), (F.col("seen") / max(1, total)).alias("share"), F.col("mean_length").cast("long").alias("mean_length"),
            F.when((F.col("mean_length") < longest) & (F.col("most") > 1), F.array_join(F.transform("v", lambda x: F.concat(x["value"], F.lit(":"), (-x["k"]).cast("string"))), " ")).alias("top"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def observed(df: DataFrame, name: str, text: str = "text"):
    """The table, and what is counted of it as it passes: rows and characters, without a pass of its own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters")), seen


def step_statistics(before: DataFrame, after: DataFrame, text: str = "text") -> DataFrame:
    """Rows and characters before and after a step, and the share of each that it kept."""
    count = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias(f"{p}_chars"))
    both = count(before, "in").join(F.broadcast(count(after, "out")), F.lit(True))
    return both.withColumn("rows_kept", F.try_divide("out_rows", "in_rows")).withColumn("chars_kept", F.try_divide("out_chars", "in_chars"))


def totals_and_unique(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value, and different values: values are counted before they are told apart."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("k"))
    return counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"))


def checksum_by(df: DataFrame, by: str) -> DataFrame:
    """``checksum`` of the rows of each value, as of the files of an output."""
    row = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(df.columns)))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("long")).alias("checksum"))
