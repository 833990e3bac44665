"""Sinks and layouts: JSON lines, partitions by value, byte-bounded shards, minified metadata."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.numbering import running_total
from ..storage import open_fs


def parse_size(size: str | int) -> int:
    """Bytes of "4G", "200M", "10K" or "17"."""
    units = {"B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}
    text = str(size).strip().upper()
    return int(float(text[:-1]) * units[text[-1]]) if text[-1] in units else int(text)


def shard_count(df: DataFrame, column: str, most: str | int) -> int:
    """Shards of at most ``most`` bytes of a column; one at least."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // parse_size(most)))


def write_jsonl(df: DataFrame, path: str, column: str | None = None, most: str | int | None = None, compression: str = "gzip") -> None:
    """JSON lines; with ``most`` in files of about so many bytes of ``column``."""
    out = df.repartition(shard_count(df, column, most)) if most else df
    out.write.option("compression", compression).json(path)


def split_by(df: DataFrame, columns: Sequence[str], path: str, fmt: str = "json") -> None:
    """One folder a value; rows without a value go. A column that isn't there is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(missing)
    kept = df
    for c in columns:
        kept = kept.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    kept.write.partitionBy(*columns).format(fmt).save(path)


def partition_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def groups_by_size(files: DataFrame, size: str, order: str, target: int) -> DataFrame:
    """Number consecutive files so that each group has about ``target`` bytes: column ``group``."""
    return running_total(files, size, order, name="group").withColumn("group", F.floor(F.col("group") / target))


def shard_rows(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(id_col), F.lit(shards)))


def split_html(df: DataFrame, mime: str) -> tuple[DataFrame, DataFrame]:
    """HTML rows without archive bytes, and all others."""
    html = F.coalesce(F.col(mime) == "text/html", F.lit(False))
    return df.where(html).drop("compressed_warc"), df.where(~html)


def minify(docs: DataFrame, url: str = "url", digest: str = "digest", segment: str = "cc_segment", lang: str = "language", score: str = "language_score", bucket: str = "bucket", perplexity: str = "perplexity", line_ids: str = "line_ids") -> DataFrame:
    """What is needed to build a mined document again."""
    return docs.select(
        F.col(url).alias("url"), F.col(digest).alias("digest"), F.col(segment).alias("cc_segment"), F.col(lang).alias("language"),
        F.round(score, 2).alias("language_score"), F.col(bucket).alias("bucket"), F.round(perplexity, 1).alias("perplexity"), T.line_ids_base64(F.col(line_ids)).alias("line_ids"),
    )


# -- files and names ---------------------------------------------------------------


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Data files of a folder, in order."""
    system, where = _hadoop(spark, folder)
    return sorted(s.getPath().toString() for s in system.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def relocate(spark: SparkSession, folder: str, target: str) -> list[str]:
    """Move the files of a folder; what is there already stays, so a run that was cut off can be run again."""
    system, to = _hadoop(spark, target)
    system.mkdirs(to)
    jvm, out = spark.sparkContext._jvm, []
    for path in list_files(spark, folder):
        there = jvm.org.apache.hadoop.fs.Path(to, path.rsplit("/", 1)[1])
        if system.exists(there):
            system.delete(jvm.org.apache.hadoop.fs.Path(path), False)
        elif not system.rename(jvm.org.apache.hadoop.fs.Path(path), there):
            raise OSError(f"{path} can't be moved to {target}")
        out.append(there.toString())
    return out


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder was written whole."""
    system, where = _hadoop(spark, folder.rstrip("/") + "/_SUCCESS")
    return system.exists(where)


def write_once(df: DataFrame, folder: str, fmt: str = "parquet", **options) -> bool:
    """Write unless the folder was written whole before; it appears under its name only when it is complete."""
    spark = df.sparkSession
    if exists(spark, folder):
        return False
    temporary = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    df.write.format(fmt).options(**options).save(temporary)
    system, where = _hadoop(spark, folder)
    if system.exists(where):  # what a run that was cut off has left
        system.delete(where, True)
    if not system.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(temporary), where):
        raise OSError(f"{folder} can't be put in place")
    return True


def write_rolled(df: DataFrame, pattern: str, column: str, most: str | int = "4G") -> list[str]:
    """JSON lines in files of at most about ``most`` bytes of a column, named by a pattern such as ``out/part_????.json.gz``.

    The question marks become the number of the file. Returns the names.
    """
    spark, (folder, _, name) = df.sparkSession, pattern.rpartition("/")
    marks = name.count("?")
    if "?" * marks not in name or not marks:
        raise ValueError("the pattern needs one run of question marks")
    temporary = f"{folder}/.{uuid.uuid4().hex}"
    df.repartition(shard_count(df, column, most)).write.option("compression", "gzip" if name.endswith(".gz") else "none").json(temporary)
    system, where = _hadoop(spark, temporary)
    jvm, out = spark.sparkContext._jvm, []
    for i, path in enumerate(list_files(spark, temporary)):
        target = f"{folder}/{name.replace('?' * marks, str(i).zfill(marks))}"
        if not system.rename(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)):
            raise OSError(f"{target} can't be written")
        out.append(target)
    system.delete(where, True)
    return out


# -- what is written ------------------------------------------------------------------


def write_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """One column of text, a line a row, compressed as it is written."""
    df.write.option("compression", compression).text(path)


def by_seed(df: DataFrame, path: str, seed: str = "seed_id", banned: Sequence[int] = (), fmt: str = "parquet") -> None:
    """One folder a seed in one pass over the rows; banned seeds go."""
    split_by(df.where(~F.col(seed).isin(list(banned))) if banned else df, [seed], path, fmt)


def merge_seed(spark: SparkSession, paths: Sequence[str], seed: str, value: int) -> DataFrame:
    """Rows of one seed from several sets of seed folders; only that seed's folders are read, and each row is checked."""
    out = None
    for path in paths:
        rows = spark.read.parquet(path).where(F.col(seed) == value)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    checked = F.when(F.col(seed) == value, F.lit(True)).otherwise(F.raise_error(F.lit("a row of another seed")).cast("boolean"))
    return out.where(checked)


def export_matches(pairs: DataFrame, clusters: DataFrame, texts: DataFrame, folder: str) -> None:
    """Matches and clusters as tab-separated tables with a header; ids of documents in a cluster and texts as plain lists."""
    pairs.write.option("sep", "\t").option("header", True).csv(f"{folder}/matches")
    clusters.write.option("sep", "\t").option("header", True).csv(f"{folder}/clusters")
    clusters.where(F.col("cluster").isNotNull()).select(clusters.columns[0]).write.csv(f"{folder}/ids")
    texts.select(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("text")).write.text(f"{folder}/texts")


def write_floats(df: DataFrame, column: str, path: str) -> None:
    """A column as single precision numbers."""
    df.select(F.col(column).cast("float").alias(column)).write.parquet(path)


def seed_lines(docs: DataFrame, path: str, text: str = "text", least: int = 32) -> None:
    """JSON lines of the rows whose text has more than ``least`` characters."""
    docs.where(F.length(text) > least).write.option("compression", "gzip").json(path)


def write_shards(df: DataFrame, path: str, order: str, column: str, most: str | int) -> int:
    """Byte-bounded shards of consecutive rows, a folder ``shard=i`` each; returns their number."""
    shards = shard_count(df, column, most)
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    sized = running_total(df.withColumn("_bytes", F.coalesce(F.octet_length(column), F.lit(0))), "_bytes", order, name="_before").drop("_bytes")
    sized.withColumn("shard", F.least(F.floor(F.col("_before") * shards / max(1, total)), F.lit(shards - 1)).cast("int")).drop("_before").write.partitionBy("shard").parquet(path)
    return shards


def write_records(df: DataFrame, folder: str, id_col: str, data: str) -> DataFrame:
    """Binary values one after another in a file a task: id, warc_filename, warc_record_offset, warc_record_length.

    A task that is run again writes its file anew, which appears whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        name = f"part-{task:06d}.bin"
        system, path = open_fs(f"{folder}/{name}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        temporary, at = f"{path}.{uuid.uuid4().hex}.tmp", 0
        with system.open_output_stream(temporary, compression=None) as out:
            for pdf in batches:
                rows = []
                for key, value in zip(pdf[id_col], pdf[data]):
                    out.write(value)
                    rows.append((key, name, at, len(value)))
                    at += len(value)
                yield pd.DataFrame(rows, columns=[id_col, "warc_filename", "warc_record_offset", "warc_record_length"])
        system.move(temporary, path)

    return df.select(id_col, data).mapInPandas(run, f"{id_col} long, warc_filename string, warc_record_offset long, warc_record_length long")


def pack_meta(df: DataFrame, columns: Sequence[str], name: str = "meta") -> DataFrame:
    """Columns packed into one of JSON, beside the others."""
    return df.select(*(c for c in df.columns if c not in columns), F.to_json(F.struct(*columns)).alias(name))


def size_report(df: DataFrame, mime: str | Column, data: str) -> DataFrame:
    """Rows and bytes of HTML and of all else."""
    html = F.coalesce((F.col(mime) if isinstance(mime, str) else mime) == "text/html", F.lit(False))
    return df.groupBy(html.alias("html")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(data)), F.lit(0)).alias("bytes"))
