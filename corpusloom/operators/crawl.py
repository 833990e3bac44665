"""Crawl index joins, link frontiers, and HTML to text."""

from __future__ import annotations

import gzip
import re
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import sliced
from ..storage import materialize
from .dedup import join_hot


def seed_join(index: DataFrame, seeds: DataFrame, domain: str = "domain", key: str = "surt") -> DataFrame:
    """Index rows below a seed: equal registered domain, and the seed's key is a prefix of the row's.

    Prefixes of each different key, of those lengths that seeds have, are joined by equality, so no row
    is held against all seeds of its domain. A prefix that many keys have is counted first; the keys
    below such a seed are dealt over as many tasks as they need.
    """
    s = seeds.select(F.col(domain).alias("_d"), F.col(key).alias("seed_key"), "seed_id")
    sizes = sorted(r[0] for r in s.select(F.length("seed_key").alias("n")).distinct().collect() if r[0] is not None)  # as many as a key has characters
    if not sizes:
        return index.join(s, F.lit(False)).drop("_d")
    keys = index.select(F.col(domain).alias("_d"), F.col(key).alias("_k")).distinct()
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("_k"))
    prefixes = keys.select("_d", "_k", F.explode(F.transform(fits, lambda n: F.substr("_k", F.lit(1), n))).alias("seed_key"))
    counts = prefixes.groupBy("_d", "seed_key").agg(F.count(F.lit(1)).alias("_n")).hint("merge").join(s.select("_d", "seed_key").distinct(), ["_d", "seed_key"], "left_semi")
    counts = materialize(counts, "seed-keys")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    part = F.ceil(F.col("_n") / max(1000, total // 2000)).cast("int")
    below = join_hot(prefixes, counts, ["_d", "seed_key"], "_n", total).withColumn("_part", F.pmod(F.xxhash64("_k"), part).cast("int"))
    dealt = s.join(counts, ["_d", "seed_key"]).withColumn("_part", F.explode(F.sequence(F.lit(0), part - 1))).drop("_n")
    pairs = below.select("_d", "_k", "seed_key", "_part").hint("merge").join(dealt, ["_d", "seed_key", "_part"]).drop("_part")
    return index.join(pairs.hint("merge"), (F.col(domain) == F.col("_d")) & (F.col(key) == F.col("_k"))).drop("_d", "_k")


def url_join(index: DataFrame, urls: DataFrame) -> DataFrame:
    return index.join(urls.select("url").distinct(), "url", "left_semi")


def coverage(found: DataFrame, by: str, url: str, size: Column, kind: str) -> DataFrame:
    """Rows, distinct addresses, bytes, and a map of kinds with their counts, by site."""
    total = found.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(url).alias("urls"), F.sum(size).alias("bytes"))
    kinds = found.groupBy(by, kind).agg(F.count(F.lit(1)).alias("k")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "k")))).alias("kinds"))
    return total.join(kinds, by)


def merge_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    merged = df.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "key").limit(top)


def hrefs(html: Column) -> Column:
    """Addresses of the anchors of a page, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1)))


def external_links(html: Column, domain: Column) -> Column:
    """Absolute links, or such that begin with www, that don't name the domain."""
    return F.filter(hrefs(html), lambda u: u.rlike("^(?:https?://|www)") & ~F.contains(u, domain))


def frontier(pages: DataFrame, url: str, links: str) -> DataFrame:
    """Linked addresses that aren't pages yet."""
    found = pages.select(F.explode(links).alias("url")).distinct()
    return found.join(pages.select(F.col(url).alias("url")), "url", "left_anti")


def link_ids(pages: DataFrame, id_col: str, url: str, links: str, time: str) -> DataFrame:
    """Ids of the latest pages behind each page's links, in order; unknown links are left out."""
    latest = pages.groupBy(F.col(url).alias("_url")).agg(F.max_by(id_col, F.struct(time, id_col)).alias("_to"))
    out = pages.select(F.col(id_col), F.posexplode(links).alias("_pos", "_url")).join(latest, "_url")
    ids = out.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_to"))), lambda x: x["_to"]).alias("external_ids"))
    return pages.select(id_col).join(ids, id_col, "left").select(id_col, F.coalesce("external_ids", F.array().cast("array<bigint>")).alias("external_ids"))


def union_depths(*depths: DataFrame) -> DataFrame:
    """Crawls of several depths one below another, with their depth; missing columns are null."""
    out = None
    for depth, df in enumerate(depths):
        df = df.withColumn("depth", F.lit(depth))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


class _Extractor(HTMLParser):
    """Text of a page, its title, and spans of the tags that are kept."""

    SKIP = frozenset("script style header iframe footer form noscript template".split())
    BLOCK = frozenset("p div section table ul ol dl li tr h1 h2 h3 h4 h5 h6 br article main blockquote pre td th dt dd".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.size = 0
        self.skip: list[str] = []
        self.title: list[str] = []
        self.in_title = self.in_head = False
        self.open: list[tuple[str, int]] = []
        self.spans: list[tuple[str, int, int]] = []

    def _put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag not in self.VOID:
                self.skip.append(tag)
        elif tag in self.SKIP:
            self.skip.append(tag)
        elif tag == "title":
            self.in_title = True
        elif tag == "head":
            self.in_head = True
        else:
            if tag in self.BLOCK:
                self._put("\n")
            if tag not in self.VOID:
                self.open.append((tag, self.size))

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
        elif tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False
        elif any(t == tag for t, _ in self.open):
            while True:
                name, start = self.open.pop()
                self.spans.append((name, start, self.size))
                if name == tag:
                    break
            if tag in self.BLOCK:
                self._put("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip and not self.in_head:
            self._put(re.sub(r"\s+", " ", data))


def _text(html: str | None, least: int) -> tuple:
    if html is None:
        return None, None, [], 0, None
    try:
        parser = _Extractor()
        parser.feed(html)
        parser.close()
        text = "".join(parser.parts)
        lines = [re.sub(r" +", " ", x).strip() for x in text.split("\n")]
        text = "\n".join(x for x in lines if x)
        if len(text) < least:
            text = ""
        return text, unescape("".join(parser.title)).strip() or None, [{"key": k, "start": a, "end": b} for k, a, b in parser.spans], 0, None
    except Exception as error:  # noqa: BLE001 - the row tells what went wrong
        return None, None, [], 1, repr(error)


PAGE = "text string, title string, spans array<struct<key:string,start:int,end:int>>, error int, error_comment string"


def html_text(html: Column, least: int = 0) -> Column:
    """Struct of text, title, spans of kept tags, and whether and how a row failed.

    Scripts, styles, headers, footers, frames and forms go with their content; blocks and line breaks
    become line ends. A row that fails says so and doesn't stop the others.
    """

    return sliced(PAGE, lambda column: [_text(x, least) for x in column])(html)


def characters_by_language(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    return docs.groupBy(lang).agg(F.sum(F.length(text)).alias("characters"), F.count(F.lit(1)).alias("documents"))


def clean_seeds(urls: DataFrame, url: str = "url") -> DataFrame:
    """Seeds with host, domain and sort key, one of each key: that of the first address."""
    s = urls.select(F.col(url).alias("link"), T.url_host(F.col(url)).alias("host"), T.surt(F.col(url)).alias("surt")).withColumn("domain", T.registered_domain(F.col("host")))
    n = F.row_number().over(W.partitionBy("surt").orderBy("link"))
    return s.withColumn("_n", n).where("_n = 1").drop("_n")


def classify_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    """Counts of log lines by kind of failure."""
    low = F.lower(F.col(line))
    kind = F.when(low.contains("out of memory") | low.contains("oom"), "memory").when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("error") | low.contains("exception"), "error").otherwise("fine")
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def crawl_tables(index: DataFrame, seeds: DataFrame, path: str, crawls: str, by: str = "seed") -> DataFrame:
    """Index rows of the seeds (or addresses) in the crawls that a pattern chooses, stored by crawl and subset, gzip.

    One query for all crawls: the pattern chooses partitions, and each crawl is a folder of the output.
    """
    chosen = index.where(F.col("crawl").rlike(f"^(?:{crawls})$"))
    found = seed_join(chosen, seeds) if by == "seed" else url_join(chosen, seeds)
    found.write.partitionBy("crawl", "subset").option("compression", "gzip").mode("overwrite").parquet(path)
    return index.sparkSession.read.parquet(path)


def crawls_of(spark: SparkSession, path: str) -> DataFrame:
    """Partitions of a stored index: crawl and subset; no file of data is read."""
    return spark.read.parquet(path).select("crawl", "subset").distinct()


def task_slice(files: Sequence[str], task: int, tasks: int) -> list[str]:
    """The files of one of several tasks, in order: consecutive ones, as even as can be."""
    n = -(-len(files) // max(1, tasks))
    return list(files)[task * n : (task + 1) * n]


def links_of(pages: DataFrame, link: str, *columns: str) -> DataFrame:
    """A row a link: how many pages have it, and lists of their values, each in order."""
    return pages.groupBy(link).agg(F.count(F.lit(1)).alias("n"), *(F.array_sort(F.collect_list(c)).alias(c) for c in columns))


def languages_by_prefix(found: DataFrame, lang: str = "languages") -> DataFrame:
    """Rows of each primary language, that with which a row's list of languages begins."""
    return found.groupBy(T.primary_language(F.col(lang)).alias("language")).agg(F.count(F.lit(1)).alias("n"))


# -- archives to HTML -----------------------------------------------------------------------


def _records(data: bytes):
    """Type, header fields and block of each record of a WARC file's bytes."""
    at = 0
    while (start := data.find(b"WARC/1.", at)) >= 0:
        end = re.compile(rb"\r?\n\r?\n").search(data, start)
        if end is None:
            raise ValueError("a record without an end of its header")
        fields = {}
        for line in data[start : end.start()].decode("utf-8", "replace").splitlines()[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        if end.end() + size > len(data):
            raise ValueError("a record is cut off")
        yield fields.get("warc-type", ""), fields, data[end.end() : end.end() + size]
        at = end.end() + size


def _charset(head: bytes, body: bytes) -> str:
    found = re.search(rb"(?i)content-type:[^\r\n]*charset=[\"']?([\w-]+)", head) or re.search(rb"(?i)<meta[^>]*charset=[\"']?([\w-]+)", body[:2048])
    name = found[1].decode("ascii") if found else "utf-8"
    try:
        "".encode(name)
    except LookupError:
        return "utf-8"
    return name


def _html(data: bytes | None, mime: str | None) -> tuple:
    if data is None or mime not in ("text/html", "application/xhtml+xml"):
        return None, None
    try:
        raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        block = next((b for kind, _, b in _records(raw) if kind == "response"), None)
        if block is None:
            return None, "no response"
        end = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
        head, body = (block[: end.start()], block[end.end() :]) if end else (b"", block)
        if re.search(rb"(?i)content-encoding:\s*gzip", head):
            body = gzip.decompress(body)
        return body.decode(_charset(head, body), "replace"), None
    except Exception as error:  # noqa: BLE001 - the row tells what went wrong
        return None, repr(error)


def warc_html(data: Column, mime: Column) -> Column:
    """Struct of html, from the first response of a WARC record's bytes, and html_error; both null for what isn't HTML.

    The character set is that of the HTTP head, else of the page, else UTF-8; bytes that aren't in it are replaced.
    """

    return sliced("html string, html_error string", lambda column, kinds: [_html(x, k) for x, k in zip(column, kinds)])(data, mime)


def preprocess_pages(rows: DataFrame, data: str = "compressed_warc", mime: str = "content_mime_detected", url: str = "url", domain: str = "domain") -> DataFrame:
    """Rows with html and its error, links out of the site, and the address if it is a PDF; bytes go."""
    from .projections import pdf_url

    found = rows.withColumn("_h", warc_html(F.col(data), F.col(mime)))
    links = F.when(F.col("_h.html").isNotNull(), external_links(F.col("_h.html"), F.col(domain)))
    return found.select(*(c for c in rows.columns if c != data), F.col("_h.html").alias("html_str"), F.col("_h.html_error").alias("html_error"), links.alias("external_urls"), pdf_url(F.col(mime), F.col(url)).alias("pdf_url"))
