"""Columns made of others, and steps of a pipeline over them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapper(f: Callable[[DataFrame], DataFrame], *args, **options) -> Callable[[DataFrame], DataFrame]:
    """A function of a table as a step for ``DataFrame.transform`` or ``compose``."""
    return lambda df: f(df, *args, **options)


def compose(*steps: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
    """Steps one after another; None steps are passed over."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df if step is None else step(df)
        return df

    return run


def drop_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Without these columns; a table that would have none has no rows."""
    left = df.drop(*columns)
    return left if left.columns else left.limit(0)


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that have a text."""
    return df.where(F.col(text).isNotNull())


def only(df: DataFrame, *columns: str) -> DataFrame:
    """These columns alone, in this order; those that aren't there are passed over."""
    return df.select(*(c for c in columns if c in df.columns))


def meta(columns: Sequence[str], as_json: bool = False) -> Column:
    """The columns packed into one struct, or its JSON."""
    packed = F.struct(*columns)
    return F.to_json(packed) if as_json else packed


def pdf_url(mime: Column, url: Column) -> Column:
    """The address of a PDF, null for anything else."""
    return F.when(mime == "application/pdf", url)


def depth_of(name: Column) -> Column:
    """Depth of a crawl by its name: ``seed`` 0, ``.._depth_k`` k, null for any other."""
    return F.when(name == "seed", 0).otherwise(F.nullif(F.regexp_extract(name, r"_depth_(\d+)$", 1), F.lit("")).cast("int"))


def deepest(names: Sequence[str]) -> str:
    """The deepest of crawl names."""
    return max(names, key=lambda n: 0 if n == "seed" else int(n.rsplit("_", 1)[1]))


def lookup(rows: DataFrame, known: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Columns of the one row of ``known`` with each row's key, under new names.

    A key that isn't there, or is there twice, fails the job.
    """
    one = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(new) for c, new in columns.items()))
    found = rows.join(one, key, "left")
    said = F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" has "), F.coalesce(F.col("_n"), F.lit(0)).cast("string"), F.lit(" rows"))
    checked = F.when(F.coalesce(F.col("_n"), F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return found.where(checked).drop("_n")


def without_empties(array: Column) -> Column:
    """The items that are neither null nor empty."""
    return F.filter(array, lambda x: x.isNotNull() & (x != ""))
