"""Readers of corpora: crawl dumps and their segments, encyclopedia dumps, tagged directories, joined metadata."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling


def list_dumps(index_page: str) -> list[str]:
    """Names of the dumps that an index page links to, in order, each once."""
    return list(dict.fromkeys(re.findall(r"CC-MAIN-(\d{4}-\d{2})", index_page)))


def dump_segments(packed: bytes) -> list[str]:
    """Paths in a gzip list of segments."""
    return [line for line in gzip.decompress(packed).decode().split("\n") if line]


def segments(spark: SparkSession, dumps: Sequence[str], fetch: Callable[[str], bytes], url: str = "https://data.commoncrawl.org/crawl-data/CC-MAIN-{}/wet.paths.gz") -> DataFrame:
    """dump and segment of the lists that ``fetch`` brings for each dump; a list is a few MB."""
    return spark.createDataFrame([(d, s) for d in dumps for s in dump_segments(fetch(url.format(d)))], "dump string, segment string")


def read_segment_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """dump and segment of lists that lie in a folder for each dump: ``../CC-MAIN-2019-09/wet.paths.gz``."""
    lines = spark.read.text(paths).select(F.regexp_extract(F.col("_metadata.file_path"), r"CC-MAIN-([0-9-]+)/", 1).alias("dump"), F.col("value").alias("segment"))
    return lines.where("segment <> ''")


def normalised_sample(docs: DataFrame, n: int = 10_000, id_col: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """Normalised texts of the first ``n`` rows of a random order, as a line each."""
    chosen = sampling.shuffled(docs.select(id_col, text), id_col, n, seed)
    return chosen.select(id_col, T.normalize(F.col(text)).alias(text))


def read_cirrus(spark: SparkSession, paths: str | list[str], n: int | None = None, case: bool = False) -> DataFrame:
    """Opening texts of a search dump of an encyclopedia, normalised, those that are empty left out.

    The dump has two lines an article, of which one names it only. ``n`` rows at most, in any order.
    """
    rows = spark.read.schema("title string, opening_text string").json(paths)
    out = rows.where(F.coalesce("opening_text", F.lit("")) != "").select("title", T.normalize(F.col("opening_text"), case=case).alias("text")).where("text <> ''")
    return out.limit(n) if n is not None else out


def joined_paragraphs(metadata: DataFrame, documents: DataFrame, keys: Sequence[str] = ("segment", "digest"), title: str = "title", text: str = "raw_content") -> DataFrame:
    """A row a paragraph that metadata names: keys, pos, language, score, paragraph.

    ``metadata`` has line_ids, languages and scores, arrays of one length. A document's first paragraph is
    its title. Numbers out of range are passed over.
    """
    lines = F.concat(F.array(F.coalesce(F.col(title), F.lit(""))), F.split(F.col(text), "\n"))
    joined = metadata.join(documents.select(*keys, lines.alias("_lines")), list(keys))
    each = joined.select(*keys, "_lines", F.posexplode(F.arrays_zip("line_ids", "languages", "scores")).alias("pos", "z")).where((F.col("z.line_ids") >= 0) & (F.col("z.line_ids") < F.size("_lines")))
    return each.select(*keys, "pos", F.col("z.languages").alias("language"), F.col("z.scores").alias("score"), F.element_at("_lines", (F.col("z.line_ids") + 1).cast("int")).alias("paragraph"))


def read_directory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """url and tags of a directory in RDF/XML: the steps of each page's topic below the top."""
    pages = spark.read.option("lineSep", "</ExternalPage>").text(paths)
    url = F.regexp_extract("value", r'<ExternalPage about="([^"]*)"', 1)
    topic = F.regexp_extract("value", r"<topic>\s*(.*?)\s*</topic>", 1)
    plain = url
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return pages.select(plain.alias("url"), F.array_distinct(F.filter(F.slice(F.split(topic, "/"), 2, 1000), lambda t: t != "")).alias("tags")).where("url <> ''")


def tags_by(pages: DataFrame, key: Column) -> DataFrame:
    """key and the tags that all pages of it have, by counting: no list of a key's pages is made."""
    keyed = pages.select(key.alias("key"), "tags").where("key IS NOT NULL AND key <> ''")
    total = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = keyed.select("key", F.explode("tags").alias("tag")).groupBy("key", "tag").agg(F.count(F.lit(1)).alias("k"))
    return shared.join(total, "key").where("k = n").groupBy("key").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def tagged_corpus(docs: DataFrame, pages: DataFrame, url: str = "url", text: str = "text", least: int = 200) -> DataFrame:
    """Lines for training a classifier: ``__label__`` tags of the address or else of its host, and the text.

    Texts without tags or of ``least`` characters or fewer are left out; lower case, in one line.
    """
    own = tags_by(pages, F.col("url")).select(F.col("key").alias("_url"), F.col("tags").alias("own"))
    host = tags_by(pages, T.url_host(F.col("url"))).select(F.col("key").alias("_host"), F.col("tags").alias("of_host"))
    joined = docs.withColumn("_url", F.col(url)).withColumn("_host", T.url_host(F.col(url))).join(own, "_url", "left").join(host, "_host", "left")
    tags = F.coalesce("own", "of_host")
    line = F.concat_ws(" ", F.array_join(F.transform(tags, lambda t: F.concat(F.lit("__label__"), F.replace(F.lower(t), F.lit(" "), F.lit("_")))), " "), F.lower(F.replace(F.col(text), F.lit("\n"), F.lit(" "))))
    return joined.where((F.size(tags) > 0) & (F.length(text) > least)).select(url, line.alias("line"))


def read_split(spark: SparkSession, paths: str | list[str], keep: Column | None = None) -> DataFrame:
    """text, timestamp and url of JSON lines, plain or gzip; ``keep`` samples them as they are read."""
    rows = spark.read.schema("text string, timestamp string, url string").json(paths)
    return rows if keep is None else rows.where(keep)


def sentence_rows(docs: DataFrame, n: int = 10_000, id_col: str = "doc_id", text: str = "text", labels: str = "labels", by: str = "sentence", seed: int = 0) -> DataFrame:
    """Documents, or their lines, with the first label or NONE: the first ``n`` of a random order."""
    label = F.coalesce(F.try_element_at(F.col(labels), F.lit(1)).cast("string"), F.lit("NONE")).alias("label")
    rows = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "text"), label) if by == "sentence" else docs.select(id_col, F.lit(0).alias("pos"), F.col(text).alias("text"), label)
    return rows.withColumn("_u", sampling.uniform(seed, F.col(id_col), F.col("pos"))).orderBy("_u", id_col, "pos").limit(n).drop("_u")


def query_dataset(found: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows behind the results of a search, with their scores."""
    return docs.join(F.broadcast(found), id_col)


def union_with_provenance(parts: Mapping[str, tuple[DataFrame, Sequence[str]]], lang: str) -> DataFrame:
    """Texts of several sources, fields of a row joined by line ends: text and meta (langid, source, row)."""
    out = None
    for source, (df, fields) in parts.items():
        rows = df.select(F.concat_ws("\n", *(F.col(f).cast("string") for f in fields)).alias("text"), F.struct(F.lit(lang).alias("langid"), F.lit(source).alias("source")).alias("meta")).where("text <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out
