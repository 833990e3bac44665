"""Registered queries of the library's operators, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import crawl, dedup, filters, language, numbering, pii, profile, projections, sampling, search
from .plans import pipelines
from .sources import readers, sinks
from .storage import materialize, shared_path, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages"))


def on_text(name: str, f: Callable, sql: str, out: str = "out") -> None:
    """A query of one text function over all documents."""
    query(name, f"SELECT doc_id, {sql} AS {out} FROM documents")(lambda s, d: docs(s, d).select("doc_id", f(F.col("text")).alias(out)))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- SQL twins of the text functions --------------------------------------------

_ASCII = q(filters._ASCII_SPECIAL)
_CTRL = r"'[\x00-\x1F\x7F-\x{9F}]'"
_WS = r"[\s\x0B\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _replace_punct(x: str) -> str:
    x = f"translate({x}, {q(T.PUNCT)}, {q(T.PUNCT_ASCII)})"
    for sign, text in T.PUNCT_LONG.items():
        x = f"replace({x}, {q(sign)}, {q(text)})"
    return x


def _zero(x: str) -> str:
    return rf"regexp_replace({x}, '\p{{Nd}}', '0', 'g')"


def _key(x: str) -> str:
    return f"substr(sha1(regexp_replace(translate({_zero(f'lower({_strip(x)})')}, {q(T.PUNCT_ALL)}, ''), {_CTRL}, '', 'g')), 1, 16)"


def _normalize(x: str) -> str:
    inner = _replace_punct(_zero(f"strip_accents(lower({_strip(x)}))"))
    return f"regexp_replace({inner}, {_CTRL}, '', 'g')"


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\n\\t]'), lambda w: w <> '')"


def _words(x: str) -> str:
    return f"list_filter(list_transform({_split(x)}, lambda w: trim(w, {_ASCII})), lambda w: w <> '')"


def _grams(words: str, n: int, joiner: str = " ") -> str:
    return f"list_transform(range(1, greatest(len({words}) - {n - 2}, 1)), lambda i: array_to_string({words}[i : i + {n - 1}], '{joiner}'))"


on_text("f01_remove_non_printing", T.remove_non_printing, f"regexp_replace(text, {_CTRL}, '', 'g')")
on_text("f02_uniform_whitespace", T.uniform_whitespace, f"translate(text, {q(T.ODD_SPACES)}, '{' ' * len(T.ODD_SPACES)}')")
on_text("f03_digits_to_zero", T.digits_to_zero, _zero("text"))
on_text("f04_replace_punct", T.replace_unicode_punct, _replace_punct("text"))
on_text("f05_remove_punct", T.remove_unicode_punct, f"translate(text, {q(T.PUNCT_ALL)}, '')")
on_text("f06_strip_accents", T.strip_accents, "strip_accents(text)")
on_text("f07_normalize", T.normalize, _normalize("text"))
on_text("f08_normalization", T.normalization, _replace_punct(_zero(f"translate(lower({_strip(f'regexp_replace(text, {_CTRL}, {q(str())}, {q(chr(103))})')}), {q(T.ODD_SPACES)}, '{' ' * len(T.ODD_SPACES)}')")))
on_text("f09_normalize_for_dedup", T.normalize_for_dedup, f"regexp_replace(translate({_zero(f'lower({_strip(chr(116) + chr(101) + chr(120) + chr(116))})')}, {q(T.PUNCT_ALL)}, ''), {_CTRL}, '', 'g')")
on_text("f13_split_words", lambda c: F.array_join(T.split_words(c), "|"), f"array_to_string({_split('text')}, '|')")
on_text("f14_strip_characters", lambda c: T.strip_characters(c, filters._ASCII_SPECIAL), f"trim(text, {_ASCII})")
on_text("f15_words", lambda c: F.array_join(T.words(c, True, filters._ASCII_SPECIAL), "|"), f"array_to_string({_words('lower(text)')}, '|')")
on_text("f16_word_ngrams", lambda c: F.array_join(T.ngrams(T.split_words(c), 2), "|"), f"array_to_string({_grams(_split('text'), 2)}, '|')")
on_text("f17_split_and_merge", lambda c: T.drop_words(c, lambda w: F.lit(True)), r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: array_to_string(list_filter(list_transform(string_split(s, chr(9)), lambda t: array_to_string(list_filter(string_split(t, ' '), lambda w: w <> ''), ' ')), lambda t: t <> ''), chr(9))), lambda s: s <> ''), chr(10))")
_KEEP_BAD = " AND ".join(f"NOT contains(trim(w, {_ASCII}), '{b}')" for b in T.BAD_SUBSTRINGS)
_NEST = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: array_to_string(list_filter(list_transform(string_split(s, chr(9)), lambda t: array_to_string(list_filter(string_split(t, ' '), lambda w: w <> '' AND {}), ' ')), lambda t: t <> ''), chr(9))), lambda s: s <> ''), chr(10))"
on_text("f18_drop_bad_words", lambda c: T.drop_bad_words(c, filters._ASCII_SPECIAL), _NEST.format(_KEEP_BAD))
on_text("f19_drop_long_words", lambda c: T.drop_long_words(c, 25, filters._ASCII_SPECIAL), _NEST.format(f"(length(w) <= 25 OR (trim(w, {_ASCII}) <> '' AND length(trim(w, {_ASCII})) <= 25))"))
on_text("f22_sentences", lambda c: F.array_join(T.sentences(c), "|"), r"regexp_replace(text, '([.!?．。]\s)([^\s])', '\1|\2', 'g')")
on_text("f23_normalize_context", T.normalize_context, f"lower({_strip(f'regexp_replace(text, {q(_WS + chr(43))}, {q(chr(32))}, {q(chr(103))})')})")
on_text("f25_line_hashes", T.line_hashes32, f"base64(unhex(array_to_string(list_transform(string_split(text, chr(10)), lambda l: substr({_key('l')}, 1, 8)), '')))")
on_text("f26_line_ids", lambda c: T.line_ids_base64(F.sequence(F.lit(0), F.size(F.split(c, "\n")) - 1)), "base64(unhex(array_to_string(list_transform(range(0, len(string_split(text, chr(10)))), lambda i: printf('%02X%02X', i % 256, i // 256)), '')))")
on_text("f32_substring_text", T.one_line, "replace(text, chr(10), ' ')")


@query("f10_spacing")
def _(s, d):
    return docs(s, d).select("doc_id", T.spacing_for_tokens(F.col("text"), "en").alias("en"), T.spacing_for_tokens(F.col("text"), "fr").alias("fr"))


@query("f24_line_keys", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, {_key('line')} AS h, count(*) AS n FROM l GROUP BY ALL")
def _(s, d):
    return dedup.lines(docs(s, d)).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"))


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_DOMAIN = rf"CASE WHEN regexp_matches({_HOST}, '[^.]+\.(com?|org|net|ac|gov|edu)\.[a-z]{{2}}$') THEN regexp_extract({_HOST}, '([^.]+\.(?:com?|org|net|ac|gov|edu)\.[a-z]{{2}})$', 1) ELSE regexp_extract({_HOST}, '([^.]+\.[^.]+)$', 1) END"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1)"
_SURT = rf"array_to_string(list_reverse(string_split(regexp_replace({_HOST}, '^www\d*\.', ''), '.')), ',') || ')' || CASE WHEN {_PATH} = '' THEN '/' ELSE lower({_PATH}) END"


@query("f28_url_parts", f"SELECT page_id, {_HOST} AS host, {_DOMAIN} AS domain, {_SURT} AS surt FROM pages")
def _(s, d):
    u = F.col("url")
    return pages(s, d).select("page_id", T.url_host(u).alias("host"), T.registered_domain(T.url_host(u)).alias("domain"), T.surt(u).alias("surt"))


@query("f29_html_lang", r"""SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]*?\blang\s*=\s*["'']?([A-Za-z0-9-]+)', 1), '') AS lang FROM pages""")
def _(s, d):
    return pages(s, d).select("page_id", T.html_lang(F.col("html")).alias("lang"))


@query("f31_sentence_frame", "SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS sentence FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def _(s, d):
    return dedup.sentence_frame(docs(s, d))


# -- readers and sinks -----------------------------------------------------------


@query("s01_k01_json_lines", "SELECT doc_id, text, lang FROM documents")
def _(s, d):
    path = shared_path(s, "jsonl")
    sinks.write_jsonl(docs(s, d).select("doc_id", "text", "lang"), path, "text", "1M")
    return readers.read_jsonl(s, path, "doc_id long, text string, lang string").drop("_corrupt_record")


@query("s07_wet", "SELECT doc_id, length(text)::INTEGER AS length, text AS raw_content FROM (SELECT doc_id, regexp_replace(text, '\\n+$', '') AS text FROM documents) WHERE length(text) >= 300")
def _(s, d):
    path = shared_path(s, "wet")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: http://host.example/"), F.col("doc_id"), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n\r\ntitle\n"), F.col("text"), F.lit("\n"))
    docs(s, d).select(head.alias("value")).write.text(path)
    found = readers.read_wet(s, path + "/*.txt", 300)
    return found.select(F.substring_index("url", "/", -1).cast("long").alias("doc_id"), "length", "raw_content")


@query("s08_shard_segments", "SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS r, count(*) OVER () AS n FROM pages) WHERE r >= 1 * n // 3 AND r < 2 * n // 3")
def _(s, d):
    return readers.shard_segments(pages(s, d).select("page_id"), "page_id", 1, 3)


@query("s15_index_partition", "SELECT page_id, url FROM pages WHERE page_id % 3 = 0")
def _(s, d):
    path = shared_path(s, "index")
    rows = pages(s, d).select("page_id", "url", F.lit("CC-1").alias("crawl"), F.when(F.col("page_id") % 3 == 0, "warc").otherwise("robotstxt").alias("subset"))
    rows.write.partitionBy("crawl", "subset").parquet(path)
    return readers.read_index(s, path).select("page_id", "url")


@query("s18_seed_list", "SELECT url AS link, (row_number() OVER (ORDER BY url) - 1)::INTEGER AS seed_id FROM pages")
def _(s, d):
    path = shared_path(s, "seeds")
    pages(s, d).select(F.col("url").alias("link")).write.option("header", True).csv(path)
    return readers.read_seeds(s, path)


@query("k04_split_by_value", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def _(s, d):
    path = shared_path(s, "split")
    sinks.split_by(docs(s, d).select("doc_id", "lang", "source"), ["lang", "source"], path)
    return sinks.partition_counts(s.read.schema("doc_id long, lang string, source string").json(path), "lang", "source")


@query("k05_groups_by_size", "SELECT doc_id, floor((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) / 50000)::BIGINT AS \"group\" FROM documents")
def _(s, d):
    return sinks.groups_by_size(docs(s, d).select("doc_id", "n_chars"), "n_chars", "doc_id", 50_000).select("doc_id", "group")


@query("k07_shard_rows", "SELECT shard, count(*) AS n FROM (SELECT doc_id % 7 AS shard FROM documents) GROUP BY 1")
def _(s, d):
    return sinks.shard_rows(docs(s, d), "doc_id", 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("k08_shard_count", "SELECT greatest(1, ceil(sum(strlen(text)) / 10000))::BIGINT AS shards FROM documents")
def _(s, d):
    return s.range(1).select(F.lit(sinks.shard_count(docs(s, d), "text", 10_000)).cast("long").alias("shards"))


@query("k14_minify", "SELECT doc_id, printf('%.2f', round(n_chars / 7.0, 2)) AS score, base64(unhex(array_to_string(list_transform(range(0, len(string_split(text, chr(10)))), lambda i: printf('%02X%02X', i % 256, i // 256)), ''))) AS line_ids FROM documents")
def _(s, d):
    x = docs(s, d).select("doc_id", F.col("doc_id").alias("url"), F.lit("").alias("digest"), F.lit("").alias("cc_segment"), F.col("lang").alias("language"), (F.col("n_chars") / 7).alias("language_score"), F.lit("all").alias("bucket"), F.lit(1.0).alias("perplexity"), F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1).alias("line_ids"))
    return sinks.minify(x).select(F.col("url").alias("doc_id"), F.format_string("%.2f", "language_score").alias("score"), "line_ids")


# -- projections --------------------------------------------------------------------


@query("p01_select", "SELECT doc_id || chr(9) || lang || chr(9) || replace(text, chr(10), ' N3WL1N3 ') || chr(9) AS value FROM documents")
def _(s, d):
    return pipelines.select_columns(docs(s, d), ["doc_id", "lang", "text", "missing"])


@query("p02_where", "SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 500")
def _(s, d):
    return pipelines.run_chain(docs(s, d), [["where", "{lang} = 'fr'", "{n_chars} > 500"]]).select("doc_id")


@query("p03_tsv", "SELECT p_partkey AS id, p_retailprice AS price, p_name AS name FROM part")
def _(s, d):
    lines = table(s, d, "part").select(F.concat_ws("\t", "p_partkey", "p_retailprice", "p_name").alias("value"))
    return readers.parse_tsv(lines, "id%i\tprice%f\tname")


@query("p06_remove_small", "SELECT doc_id FROM documents WHERE length(text) >= 300")
def _(s, d):
    return pipelines.run_chain(docs(s, d), [["small", "text", "300"]]).select("doc_id")


@query("p09_meta_json", """SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS meta FROM documents""")
def _(s, d):
    return docs(s, d).select("doc_id", projections.meta(["lang", "source"], as_json=True).alias("meta"))


@query("p10_row_id", "SELECT page_id, (row_number() OVER (ORDER BY url, page_id) - 1)::BIGINT AS row_id FROM pages")
def _(s, d):
    return numbering.number_rows(pages(s, d).select("page_id", "url"), "url", "page_id").select("page_id", "row_id")


@query("p12_depth", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 0 WHEN 3 THEN NULL ELSE page_id % 4 * 11 END::INTEGER AS depth FROM pages")
def _(s, d):
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.lit("seed")).when(k == 3, F.lit("other")).otherwise(F.concat(F.lit("intermediate_depth_"), (k * 11).cast("string")))
    return pages(s, d).select("page_id", projections.depth_of(name).alias("depth"))


# -- filters ------------------------------------------------------------------------

_STOP = "CASE lang " + " ".join(f"WHEN '{k}' THEN len(list_filter({_words('lower(text)')}, lambda w: list_contains([{', '.join(q(x) for x in sorted(set(v.split())))}], w)))" for k, v in filters.STOPWORDS.items()) + " END"
_N = f"len({_words('lower(text)')})"
_CHAR_REP = """(SELECT doc_id, sum(c) FILTER (rn <= least(floor(sqrt(u)), u - r)) / sum(c)::DOUBLE AS ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS rn, count(*) OVER (PARTITION BY doc_id) AS u, count(*) FILTER (c > 1) OVER (PARTITION BY doc_id) AS r FROM (
    SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(length(text) - 8, 1)), lambda i: substr(text, i, 10))) AS g FROM documents) GROUP BY ALL)) GROUP BY 1)"""
_WORD_REP = f"""(SELECT doc_id, coalesce(sum(c) FILTER (c > 1), 0) / sum(c)::DOUBLE AS ratio FROM (
  SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest({_grams('w', 5)}) AS g FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents)) GROUP BY ALL) GROUP BY 1)"""
_SPECIAL = r"CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[\p{P}\p{S}\p{Z}\p{Cf}0-9\t\n\r\f\x0B]', '', 'g'))) / length(text)::DOUBLE ELSE 0 END"
_METRICS = f"""SELECT doc_id, lang, len({_words('text')})::BIGINT AS number_words, round(coalesce(c.ratio, 0), 6) AS character_repetition, round(coalesce(w.ratio, 0), 6) AS word_repetition,
  round({_SPECIAL}, 6) AS special_ratio, round(CASE WHEN {_N} > 0 THEN least({_STOP} / {_N}::DOUBLE, 1) ELSE 0 END, 6) AS stop_ratio
FROM documents LEFT JOIN {_CHAR_REP} c USING (doc_id) LEFT JOIN {_WORD_REP} w USING (doc_id)"""


def _measured(s, d):
    m = filters.metrics(docs(s, d))
    return m.select("doc_id", "lang", "number_words", *(F.round(c, 6).alias(c) for c in ("character_repetition", "word_repetition", "special_ratio", "stop_ratio")))


query("q01_q06_metrics", _METRICS)(_measured)


def _bound(name: str) -> str:
    own = " ".join(f"WHEN '{k}' THEN {getattr(v, name)}" for k, v in filters.CUTOFFS.items())
    return f"CASE lang {own} ELSE {getattr(filters.Cutoffs(), name)} END"


_REASON = "CASE " + " ".join(f"WHEN {m} {'<' if least else '>'} {_bound(c)} THEN '{n}'" for n, m, c, least in filters.CHECKS if m in ("number_words", "character_repetition", "word_repetition", "special_ratio", "stop_ratio")) + " END"


@query("q09_discard_reason", f"SELECT doc_id, {_REASON} AS discard_reason FROM ({_METRICS})")
def _(s, d):
    m = _measured(s, d)
    return m.select("doc_id", filters.discard_reason(m.columns, F.col("lang")).alias("discard_reason"))


@query("q12_discard_analysis", f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS share FROM (SELECT {_REASON} AS reason FROM ({_METRICS})) GROUP BY 1")
def _(s, d):
    m = _measured(s, d)
    return filters.discard_analysis(m.withColumn("discard_reason", filters.discard_reason(m.columns, F.col("lang"))))


@query("q09_all_checks")
def _(s, d):
    return pipelines.verdicts(docs(s, d)).select("doc_id", "discard_reason")


@query("q12_all_checks")
def _(s, d):
    return filters.discard_analysis(pipelines.verdicts(docs(s, d)))


@query(
    "q13_outlier_histogram",
    """WITH m AS (SELECT median(n_chars::DOUBLE) AS med FROM documents), x AS (SELECT median(abs(n_chars - med)) AS mad FROM documents, m),
k AS (SELECT n_chars::DOUBLE AS v FROM documents, m, x WHERE med = 0 OR abs(n_chars - med) < 9 * mad), e AS (SELECT min(v) AS lo, max(v) AS hi FROM k)
SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM k, e GROUP BY 1""",
)
def _(s, d):
    return filters.outlier_histogram(docs(s, d), "n_chars")


@query("q15_zipf", f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('lower(text)')}) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def _(s, d):
    return filters.zipf(docs(s, d))


@query("q20_modify_documents", "SELECT doc_id, CASE WHEN lang IN ('en', 'es') THEN " + _NEST.replace("text", "y").format("(length(w) <= 25 OR (trim(w, ASC) <> '' AND length(trim(w, ASC)) <= 25))".replace("ASC", _ASCII)) + " WHEN lang = 'fr' THEN " + _NEST.replace("text", "y").format("(length(w) <= 45 OR (trim(w, ASC) <> '' AND length(trim(w, ASC)) <= 45))".replace("ASC", _ASCII)) + f" ELSE t END AS text FROM (SELECT *, {_NEST.replace('text', 't').format(_KEEP_BAD)} AS y FROM (SELECT doc_id, lang, translate({_strip('text')}, {q(T.ODD_SPACES)}, '{' ' * len(T.ODD_SPACES)}') AS t FROM documents))")
def _(s, d):
    return filters.modify_documents(docs(s, d)).select("doc_id", "text")


# -- deduplication --------------------------------------------------------------------


@query("d01_exact_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY replace(text, ' ', '') ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(s, d):
    return dedup.exact_dedup(docs(s, d)).select("doc_id")


_LINES = f"lines AS (SELECT doc_id, (generate_subscripts(l, 1) - 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), keyed AS (SELECT *, {_key('line')} AS h FROM lines)"


@query("d03_line_hashes", f"WITH {_LINES} SELECT h, count(DISTINCT doc_id) > 1 AS duplicate FROM keyed GROUP BY 1")
def _(s, d):
    return dedup.line_hashes(docs(s, d))


@query("d04_merge_hashes", f"WITH {_LINES}, a AS (SELECT h, count(DISTINCT doc_id) > 1 AS dup FROM keyed WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT h, count(DISTINCT doc_id) > 1 AS dup FROM keyed WHERE doc_id % 2 = 1 GROUP BY 1) SELECT h, count(*) > 1 OR bool_or(dup) AS duplicate FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def _(s, d):
    x = docs(s, d)
    return dedup.merge_hashes(dedup.line_hashes(x.where("doc_id % 2 = 0")), dedup.line_hashes(x.where("doc_id % 2 = 1")))


@query("d05_drop_shared_lines", f"WITH {_LINES}, f AS (SELECT h FROM keyed GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), k AS (SELECT doc_id, h, min(pos) AS pos, arg_min(line, pos) AS line FROM keyed WHERE h NOT IN (SELECT h FROM f) GROUP BY 1, 2) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*)::INTEGER AS nlines FROM k GROUP BY 1")
def _(s, d):
    return dedup.drop_shared_lines(docs(s, d)).select("doc_id", "text", "nlines")


@query("d06_keep_first_lines", f"WITH {_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS r FROM keyed) SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*)::INTEGER AS nlines FROM k WHERE r = 1 GROUP BY 1")
def _(s, d):
    return dedup.keep_first_lines(docs(s, d)).select("doc_id", "text", "nlines")


@query("d08_group_line_hashes", f"WITH {_LINES} SELECT source, h, count(DISTINCT doc_id) > 1 AS duplicate FROM keyed JOIN documents USING (doc_id) GROUP BY ALL")
def _(s, d):
    return dedup.line_hashes(docs(s, d), group="source")


_BOILER = f"""pages AS (SELECT source, text, min(doc_id) AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10000 GROUP BY 1, 2),
skip AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}))) AS line FROM pages) JOIN (SELECT source, count(*) AS pages FROM pages GROUP BY 1) USING (source)
  GROUP BY source, line, pages HAVING count(*) > greatest(10.0, pages * 0.01))"""


@query("d09_boilerplate_lines", f"WITH {_BOILER} SELECT * FROM skip")
def _(s, d):
    return dedup.boilerplate_lines(docs(s, d), "source")


@query("d12_drop_boilerplate", f"WITH {_BOILER}, l AS (SELECT source, doc_id, (generate_subscripts(l, 1) - 1) AS pos, unnest(l) AS line FROM (SELECT source, doc_id, list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}) AS l FROM documents)) SELECT * FROM (SELECT doc_id, {_strip('string_agg(line, chr(10) ORDER BY pos)')} AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM skip WHERE skip.source = l.source AND skip.line = l.line) GROUP BY 1) WHERE length(text) > 32")
def _(s, d):
    x = docs(s, d)
    return dedup.drop_boilerplate(x, dedup.boilerplate_lines(x, "source"), "source").select("doc_id", "text")


_SIMHASH = f"""w AS (SELECT doc_id, {_split('lower(text)')} AS w FROM documents), t AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 5), lambda i: ('0x' || substr(md5(array_to_string(w[i : i + 5], ' ')), 1, 16))::UBIGINT)) AS k FROM w WHERE len(w) > 6),
b AS (SELECT doc_id, ({' + '.join(f"CASE WHEN 2 * sum((k >> {i}) & 1) > count(*) THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))}) AS v FROM t GROUP BY 1),
sim AS (SELECT doc_id, coalesce(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END, 0)::BIGINT AS h FROM documents LEFT JOIN b USING (doc_id))"""
_HAMMING = "hs AS (SELECT DISTINCT h FROM sim), hp AS (SELECT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM hs a JOIN hs b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 4)"
_REP_PAIRS = "f AS (SELECT h, min(doc_id) AS x FROM sim GROUP BY 1), rp AS (SELECT least(p.x, r.x) AS id_a, greatest(p.x, r.x) AS id_b, distance FROM hp JOIN f p ON p.h = a JOIN f r ON r.h = b UNION ALL SELECT x, doc_id, 0 FROM sim JOIN f USING (h) WHERE x < doc_id)"


@query("d15_simhash", f"WITH {_SIMHASH} SELECT * FROM sim")
def _(s, d):
    return docs(s, d).select("doc_id", dedup.simhash(F.col("text")).alias("h"))


def _hashes(s, d):
    return materialize(docs(s, d).select("doc_id", dedup.simhash(F.col("text")).alias("h")), "simhash")


@query("d16_hamming_pairs", f"WITH {_SIMHASH}, {_HAMMING} SELECT * FROM hp")
def _(s, d):
    return dedup.hamming_pairs(_hashes(s, d))


@query("d17_document_pairs", f"WITH {_SIMHASH}, {_HAMMING} SELECT DISTINCT least(x.doc_id, y.doc_id) AS id_a, greatest(x.doc_id, y.doc_id) AS id_b, distance FROM hp JOIN sim x ON x.h = a JOIN sim y ON y.h = b")
def _(s, d):
    h = _hashes(s, d)
    return dedup.document_pairs(dedup.hamming_pairs(h), h)


@query("d17_simhash_pairs", f"WITH {_SIMHASH}, {_HAMMING}, {_REP_PAIRS} SELECT * FROM rp")
def _(s, d):
    h = _hashes(s, d)
    return dedup.representative_pairs(dedup.hamming_pairs(h), h)


@query("d18_distance_histogram", f"WITH {_SIMHASH}, {_HAMMING}, {_REP_PAIRS} SELECT distance, count(*) AS n FROM rp GROUP BY 1")
def _(s, d):
    h = _hashes(s, d)
    return dedup.distance_histogram(dedup.representative_pairs(dedup.hamming_pairs(h), h))


@query("d18_distance_examples", f"WITH {_SIMHASH}, {_HAMMING}, {_REP_PAIRS}, e AS (SELECT *, row_number() OVER (PARTITION BY distance ORDER BY id_a, id_b) AS r FROM rp) SELECT distance, id_a, id_b, x.text AS text_a, y.text AS text_b FROM e JOIN documents x ON x.doc_id = id_a JOIN documents y ON y.doc_id = id_b WHERE r <= 3")
def _(s, d):
    h = _hashes(s, d)
    return dedup.distance_examples(dedup.representative_pairs(dedup.hamming_pairs(h), h), docs(s, d))


@query(
    "d19_components",
    """WITH RECURSIVE e AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey ELSE o_orderkey - o_orderkey % 7 + (o_orderkey % 7 * 5) % 7 END AS b FROM orders), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS node FROM both_),
r(node, reach) AS (SELECT node, node FROM n UNION SELECT both_.b, reach FROM r JOIN both_ ON both_.a = r.node WHERE reach < both_.b + 100000)
SELECT node, min(reach) AS label FROM r GROUP BY 1""",
)
def _(s, d):
    from .operators.components import components

    e = table(s, d, "orders").select(F.col("o_orderkey").alias("a"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey ELSE o_orderkey - o_orderkey % 7 + (o_orderkey % 7 * 5) % 7 END").alias("b"))
    return components(e)


_CLUSTERS = f"WITH RECURSIVE {_SIMHASH}, {_HAMMING}, e AS (SELECT a, b FROM hp UNION SELECT b, a FROM hp), r(node, reach) AS (SELECT a, a FROM e UNION SELECT e.b, reach FROM r JOIN e ON e.a = r.node), cl AS (SELECT node, min(reach) AS label FROM r GROUP BY 1)"


@query("d20_near_clusters", f"{_CLUSTERS} SELECT doc_id, h, label AS cluster FROM sim LEFT JOIN cl ON node = h")
def _(s, d):
    return pipelines.near_dedup(docs(s, d))


@query("d20_cluster_report", f"{_CLUSTERS}, c AS (SELECT label, count(*) AS size, max(length(text))::INTEGER AS longest FROM sim JOIN cl ON node = h JOIN documents USING (doc_id) GROUP BY 1) SELECT size, count(*) AS clusters, max(longest) AS longest FROM c GROUP BY 1")
def _(s, d):
    x = docs(s, d)
    return dedup.cluster_report(pipelines.near_dedup(x), x)


@query("d20_with_exact", f"{_CLUSTERS}, tw AS (SELECT h FROM sim GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, sim.h AS h, coalesce(label, tw.h) AS cluster FROM sim LEFT JOIN cl ON node = sim.h LEFT JOIN tw ON tw.h = sim.h")
def _(s, d):
    h = _hashes(s, d)
    return dedup.hash_clusters(dedup.hamming_pairs(h), h, include_exact=True)


@query(
    "d21_repeated_windows",
    """WITH c AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 48), lambda i: {'p': i - 1, 'w': substr(text, i, 50)})) AS x FROM documents WHERE length(text) >= 50), r AS (SELECT x.w AS w FROM c GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT doc_id, x.p AS p FROM c WHERE x.w IN (SELECT w FROM r)), g AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS s FROM h), i AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g)
SELECT doc_id, min(p)::INTEGER AS begin, (max(p) + 50)::INTEGER AS end FROM i GROUP BY doc_id, k""",
)
def _(s, d):
    return dedup.repeated_windows(docs(s, d)).withColumn("begin", F.col("begin").cast("int")).withColumn("end", F.col("end").cast("int"))


@query("d22_latest_capture", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def _(s, d):
    return dedup.latest(table(s, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("d23_seed_dedup", f"SELECT link, surt FROM (SELECT url AS link, {_SURT} AS surt, row_number() OVER (PARTITION BY {_SURT} ORDER BY url) AS r FROM pages) WHERE r = 1")
def _(s, d):
    return crawl.clean_seeds(pages(s, d)).select("link", "surt")


@query("d24_sentence_dedup", f"WITH {_LINES} SELECT h, min(doc_id) AS doc_id FROM keyed GROUP BY 1")
def _(s, d):
    return dedup.lines(docs(s, d)).groupBy("h").agg(F.min("doc_id").alias("doc_id"))


@query("d25_duplicate_counts", "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return dedup.duplicate_counts(docs(s, d))


# -- personal data ----------------------------------------------------------------------


@query("i01_mask_pii")
def _(s, d):
    return docs(s, d).select("doc_id", pii.mask_pii(F.col("text"), F.col("lang"), "any").alias("text"))


@query("i03_entities")
def _(s, d):
    return pii.entities(docs(s, d), lang=F.col("lang"), country="any")


@query("i13_tasks")
def _(s, d):
    return pii.tasks(s)


_EMAIL = r"[\p{L}\p{N}\p{M}_.=-]+@[\p{L}\p{N}\p{M}_.-]+\.[\p{L}\p{N}\p{M}_]{2,3}"


@query("i16_mask_emails", r"SELECT doc_id, regexp_replace(text, '[\p{L}\p{N}\p{M}_.=-]+@[\p{L}\p{N}\p{M}_.-]+\.[\p{L}\p{N}\p{M}_]{2,3}', '<EMAIL_ADDRESS>', 'g') AS text FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", pii.mask_emails(F.col("text")).alias("text"))


_OCT = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"


@query(
    "i17_ip_addresses",
    rf"""WITH v AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '\b(?:{_OCT}\.){{3}}{_OCT}\b'))) AS v FROM documents), p AS (SELECT doc_id, v, unnest(string_split(text, v)) AS part, generate_subscripts(string_split(text, v), 1) AS i, len(string_split(text, v)) AS n FROM v),
b AS (SELECT doc_id, v, i, part, lead(part) OVER (PARTITION BY doc_id, v ORDER BY i) AS after, n FROM p)
SELECT doc_id, v AS value, count(*) AS n FROM b WHERE i < n AND (regexp_matches(lower(right(regexp_replace(part, '\s+', ' ', 'g'), 16)), '\bip\b') OR regexp_matches(lower(left(regexp_replace(after, '\s+', ' ', 'g'), 16)), '\bip\b')) GROUP BY 1, 2""",
)
def _(s, d):
    return pii.entities(docs(s, d), lang="en", types=("IP_ADDRESS",)).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("i31_anonymise")
def _(s, d):
    return docs(s, d).select("doc_id", pii.anonymise(F.col("text"), F.col("lang")).alias("a")).select("doc_id", "a.text", F.size("a.entities").alias("n"))


# -- crawl ----------------------------------------------------------------------------------


_HREFS = r"""list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']+)["'']', 1))"""


def _index(s, d):
    u = F.col("url")
    return pages(s, d).select("page_id", "url", "html", T.url_host(u).alias("host"), T.surt(u).alias("surt")).withColumn("domain", T.registered_domain(F.col("host")))


_INDEX = f"SELECT page_id, url, html, {_HOST} AS host, {_SURT} AS surt, {_DOMAIN} AS domain FROM pages"


@query("c01_seed_join", f"WITH i AS ({_INDEX}), s AS (SELECT page_id AS seed_id, domain, left(surt, length(surt) - 3) AS surt FROM i) SELECT i.page_id, s.seed_id FROM i JOIN s ON i.domain = s.domain AND starts_with(i.surt, s.surt)")
def _(s, d):
    i = _index(s, d)
    seeds = i.select(F.col("page_id").alias("seed_id"), "domain", F.expr("left(surt, length(surt) - 3)").alias("surt"))
    return crawl.seed_join(i, seeds).select("page_id", "seed_id")


@query("c02_url_join", f"SELECT DISTINCT page_id FROM pages WHERE url IN (SELECT replace(unnest({_HREFS}), '#', '') FROM pages UNION ALL SELECT url FROM pages)")
def _(s, d):
    p = pages(s, d)
    links = p.select(F.explode(crawl.hrefs(F.col("html"))).alias("url")).select(F.replace("url", F.lit("#"), F.lit("")).alias("url"))
    return crawl.url_join(p, links.unionByName(p.select("url"))).select("page_id")


@query("c05_coverage", f"SELECT {_DOMAIN} AS site, count(*) AS n, count(DISTINCT url) AS urls, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def _(s, d):
    return crawl.coverage(_index(s, d).withColumn("lang", T.html_lang(F.col("html"))).withColumnRenamed("domain", "site"), "site", "url", F.octet_length("html"), "lang").select("site", "n", "urls", "bytes")


@query("c06_merge_counts", r"""SELECT nullif(regexp_extract(html, '(?i)<html[^>]*?\blang\s*=\s*["'']?([A-Za-z0-9-]+)', 1), '') AS key, count(*) AS n FROM pages WHERE key IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 10""")
def _(s, d):
    found = _index(s, d).withColumn("lang", T.html_lang(F.col("html"))).where("lang IS NOT NULL").withColumnRenamed("domain", "site")
    return crawl.merge_counts(crawl.coverage(found, "site", "url", F.octet_length("html"), "lang"), "kinds")


@query("c07_frontier", f"SELECT DISTINCT u AS url FROM (SELECT unnest({_HREFS}) AS u FROM pages) WHERE u NOT IN (SELECT url FROM pages)")
def _(s, d):
    return crawl.frontier(pages(s, d).withColumn("links", crawl.hrefs(F.col("html"))), "url", "links")


@query("c08_link_ids", f"SELECT page_id, to_id, count(*) AS n FROM (SELECT page_id, unnest({_HREFS}) AS u FROM pages) JOIN (SELECT url AS u, max(page_id) AS to_id FROM pages GROUP BY 1) USING (u) GROUP BY ALL")
def _(s, d):
    p = pages(s, d).withColumn("links", crawl.hrefs(F.col("html"))).withColumn("time", F.lit(0))
    ids = crawl.link_ids(p, "page_id", "url", "links", "time")
    return ids.select("page_id", F.explode("external_ids").alias("to_id")).groupBy("page_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


@query("c09_union_depths", "SELECT page_id, (page_id % 3)::INTEGER AS depth FROM pages")
def _(s, d):
    p = pages(s, d).select("page_id")
    return crawl.union_depths(*(p.where(F.col("page_id") % 3 == k) for k in range(3)))


@query("c10_external_links", rf"SELECT page_id, len(list_filter({_HREFS}, lambda u: regexp_matches(u, '^(?:https?://|www)') AND NOT contains(u, {_DOMAIN})))::INTEGER AS n FROM pages")
def _(s, d):
    return _index(s, d).select("page_id", F.size(crawl.external_links(F.col("html"), F.col("domain"))).alias("n"))


@query("c12_html_text")
def _(s, d):
    return pages(s, d).select("page_id", crawl.html_text(F.col("html")).alias("p")).select("page_id", "p.text", "p.title", F.size("p.spans").alias("spans"), "p.error")


@query("c16_characters_by_language", "SELECT lang, sum(length(text))::BIGINT AS characters, count(*) AS documents FROM documents GROUP BY 1")
def _(s, d):
    return crawl.characters_by_language(docs(s, d))


# -- language models ------------------------------------------------------------------------------

_LID_WORDS = r"list_filter(regexp_split_to_array(lower(replace(X, chr(10), ' ')), '[^\p{L}]+'), lambda w: w <> '')"


def _lid(column: str) -> str:
    w = _LID_WORDS.replace("X", column)
    hits = {k: f"len(list_filter({w}, lambda w: list_contains([{', '.join(q(x) for x in v.split())}], w)))" for k, v in language.LANGUAGE_WORDS.items()}
    total = "(" + " + ".join(hits.values()) + ")"
    return "list_sort([" + ", ".join(f"{{'s': -CASE WHEN {total} > 0 THEN round({n} / {total}::DOUBLE, 2) ELSE 0 END, 'l': '{k}'}}" for k, n in hits.items()) + "])"


@query("m01_language", f"SELECT doc_id, best[1].l AS pred_lang, abs(best[1].s) AS pred_score FROM (SELECT doc_id, {_lid('text')} AS best FROM documents) WHERE -best[1].s >= 0.5")
def _(s, d):
    return language.identify(docs(s, d), least=0.5).select("doc_id", "pred_lang", "pred_score")


@query("m02_language_by_lines")
def _(s, d):
    return language.identify_by_lines(docs(s, d))


@query("m04_keep_languages", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND lang <> 'fr'")
def _(s, d):
    return language.keep_languages(docs(s, d), keep=("en", "fr"), ban=("fr",)).select("doc_id")


_TOKENS = f"tok AS (SELECT doc_id, lang, unnest({_split(_normalize('text'))}) AS word FROM documents)"
_PERPLEXITY = f"""{_TOKENS}, c AS (SELECT lang, word, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT lang, (sum(n) + count(*) + 1)::DOUBLE AS total FROM c GROUP BY 1), m AS (SELECT lang, word, log10((n + 1) / total) AS logp FROM c JOIN t USING (lang)),
x AS (SELECT doc_id, sum(logp) AS s, count(*) AS n FROM tok JOIN m USING (lang, word) GROUP BY 1), pp AS (SELECT doc_id, lang, round(pow(10, -s / (n + 1)), 1) AS perplexity FROM documents LEFT JOIN x USING (doc_id))"""


def _scored(s, d):
    x = docs(s, d)
    counted = materialize(language.counted_words(x, ["doc_id", "lang"]), "lm-words")
    return language.document_perplexity(x.select("doc_id", "lang"), language.unigram_of(counted), counted=counted)


query("m06_perplexity", f"WITH {_PERPLEXITY} SELECT * FROM pp")(_scored)


@query("m08_buckets", f"WITH {_PERPLEXITY}, q AS (SELECT lang, quantile_cont(perplexity, 0.3) AS p30, quantile_cont(perplexity, 0.6) AS p60 FROM pp GROUP BY 1) SELECT doc_id, CASE WHEN perplexity IS NULL OR perplexity < 0 THEN 'all' WHEN perplexity < p30 THEN 'head' WHEN perplexity < p60 THEN 'middle' ELSE 'tail' END AS bucket FROM pp JOIN q USING (lang)")
def _(s, d):
    x = materialize(_scored(s, d), "scores")
    return language.bucket(x, language.percentile_cutoffs(x)).select("doc_id", "bucket")


@query("m09_ngram_counts", f"WITH w AS (SELECT {_split(_normalize('text'))} AS w FROM documents) SELECT ngram, count(*) AS n FROM (SELECT unnest({_grams('w', 3)}) AS ngram FROM w) GROUP BY 1")
def _(s, d):
    return language.ngram_counts(docs(s, d), 3)


@query("m09_continuations", f"WITH w AS (SELECT {_split(_normalize('text'))} AS w FROM documents), g AS (SELECT DISTINCT unnest({_grams('w', 2)}) AS g FROM w) SELECT string_split(g, ' ')[2] AS word, count(*) AS continuations FROM g GROUP BY 1")
def _(s, d):
    return language.continuation_counts(docs(s, d))


@query("m12_vocabulary", f"WITH {_TOKENS} SELECT word, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, word LIMIT 65536")
def _(s, d):
    return language.vocabulary(docs(s, d))


@query("m17_fetch_metadata", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:1] || string_split(text, chr(10))[3:3], chr(10)) AS text FROM documents")
def _(s, d):
    x = docs(s, d)
    return language.fetch_metadata(x.select("doc_id", F.array(F.lit(0), F.lit(2)).alias("line_ids")), x, ("doc_id",)).select("doc_id", "text")


# -- sampling -----------------------------------------------------------------------------------------


def _u(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::BIGINT / {1 << 52}::DOUBLE)"


@query("a01_random_sample", f"SELECT doc_id FROM documents WHERE {_u(0, 'doc_id')} <= 0.5")
def _(s, d):
    return sampling.random_sample(docs(s, d), "doc_id").select("doc_id")


@query("a02_stepwise_sample", f"SELECT doc_id FROM documents WHERE {_u(0, 'doc_id')} <= CASE WHEN n_chars <= 800 THEN 300.0::DOUBLE / 800 WHEN n_chars <= 1600 THEN 300.0::DOUBLE / 800 WHEN n_chars <= 3000 THEN 300.0::DOUBLE / 1400 ELSE 300.0::DOUBLE / 30000 END")
def _(s, d):
    return sampling.perplexity_sample(docs(s, d), "doc_id", sampling.stepwise(F.col("n_chars"), (800, 1600, 3000), 300.0)).select("doc_id")


@query("a03_gaussian_sample", f"SELECT doc_id FROM documents WHERE {_u(0, 'doc_id')} <= 0.78::DOUBLE * exp(-(1 / 4.5::DOUBLE) * ((n_chars - 1600) / 1600::DOUBLE) * ((n_chars - 1600) / 1600::DOUBLE))")
def _(s, d):
    return sampling.perplexity_sample(docs(s, d), "doc_id", sampling.gaussian(F.col("n_chars"), 1600.0)).select("doc_id")


@query("a05_quartiles", "SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM documents")
def _(s, d):
    return sampling.quartiles(docs(s, d), "n_chars")


@query("a06_shuffle", f"SELECT doc_id FROM documents ORDER BY {_u(2021, 'doc_id')}, doc_id LIMIT 10000")
def _(s, d):
    return sampling.shuffled(docs(s, d), "doc_id", 10_000).select("doc_id")


@query("a07_per_bucket", f"SELECT doc_id, bucket FROM (SELECT doc_id, floor(n_chars / 100.0) * 100.0::DOUBLE AS bucket, row_number() OVER (PARTITION BY floor(n_chars / 100.0) ORDER BY {_u(0, 'doc_id')}, doc_id) AS r FROM documents) WHERE bucket <= 1000 AND r <= 100")
def _(s, d):
    return sampling.per_bucket(docs(s, d), "doc_id", "n_chars").select("doc_id", "bucket")


@query("a08_mix_by_ratio", f"SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_u(42, 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(n * CASE lang WHEN 'en' THEN 0.25 WHEN 'de' THEN 0.5 ELSE 1.0 END)")
def _(s, d):
    return sampling.mix_by_ratio(docs(s, d), "doc_id", "lang", {"en": 0.25, "de": 0.5}).select("doc_id")


@query("a09_strided", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 5 = 2")
def _(s, d):
    return sampling.strided(docs(s, d).select("doc_id"), "doc_id", 5, 2)


@query("a11_pack_sequences", f"WITH t AS (SELECT doc_id // 200 AS batch, doc_id, (generate_subscripts(w, 1)) AS p, unnest(w) AS tok FROM (SELECT doc_id, {_split('text')} AS w FROM documents)), n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY doc_id, p) - 1 AS i FROM t) SELECT batch, i // 512 AS seq, string_agg(tok, ' ' ORDER BY i) AS tokens FROM n GROUP BY 1, 2 HAVING count(*) = 512")
def _(s, d):
    packed = sampling.pack_sequences(docs(s, d), "doc_id", T.split_words(F.col("text")), 512, 200)
    return packed.select("batch", "seq", F.array_join("tokens", " ").alias("tokens"))


@query("a13_mask_tokens")
def _(s, d):
    ids = F.transform(T.split_words(F.col("text")), lambda w: F.pmod(F.hash(w), F.lit(30_000)))
    return docs(s, d).select("doc_id", sampling.mask_tokens(ids, F.col("doc_id"), 30_000, 30_000).alias("m")).select("doc_id", "m.*")


# -- profiles and search ----------------------------------------------------------------------------------


@query("g01_describe", "SELECT 'doc_id' AS name, count(doc_id) AS seen, NULL::DOUBLE AS mean_length, avg(doc_id) AS mean, min(doc_id)::DOUBLE AS least, max(doc_id)::DOUBLE AS most FROM documents UNION ALL SELECT 'text', count(text), avg(length(text)), NULL, NULL, NULL FROM documents UNION ALL SELECT 'n_chars', count(n_chars), NULL, avg(n_chars), min(n_chars), max(n_chars) FROM documents")
def _(s, d):
    return profile.describe(docs(s, d).select("doc_id", "text", "n_chars"))


@query("g02_top_values", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, value LIMIT 100")
def _(s, d):
    return profile.top_values(table(s, d, "events"), "event_type")


@query("g03_histogram", "SELECT least(floor((l_quantity - 1) / (49 / 10.0)), 9)::INTEGER AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def _(s, d):
    return profile.histogram(table(s, d, "lineitem"), "l_quantity", 1, 50, 10)


@query("g03_automatic_bins", "WITH s AS (SELECT count(n_chars) AS n, min(n_chars) AS lo, max(n_chars) AS hi, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents) SELECT n, lo, hi, greatest(ceil((hi - lo) / least(2 * (q3 - q1) / pow(n, 1 / 3.0), (hi - lo) / (log2(n) + 1))), 1)::INTEGER AS bins FROM s")
def _(s, d):
    return profile.automatic_bins(docs(s, d), "n_chars")


@query("g06_duplicate_fraction", "SELECT count(*) AS documents, count(DISTINCT replace(text, ' ', '')) AS distinct_documents, 1 - count(DISTINCT replace(text, ' ', '')) / count(*)::DOUBLE AS duplicate_fraction FROM documents")
def _(s, d):
    return dedup.duplicate_fraction(docs(s, d))


@query("g09_checksum", "SELECT count(*) AS rows, sum(('0x' || substr(md5(n_name || '|' || n_nationkey || '|' || n_regionkey), 1, 8))::BIGINT)::BIGINT AS checksum FROM nation UNION ALL SELECT count(*), sum(('0x' || substr(md5(doc_id || '|' || lang || '|' || n_chars || '|' || source || '|' || text), 1, 8))::BIGINT)::BIGINT FROM documents")
def _(s, d):
    return profile.checksum(table(s, d, "nation")).unionByName(profile.checksum(docs(s, d)))


_RUNS = r"SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS r FROM documents"
_GRAMS = f"SELECT doc_id, unnest(list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n))) AS gram FROM ({_RUNS}), (SELECT unnest(range(3, 9)) AS n) WHERE length(r) >= n"


@query("x01_grams", f"SELECT doc_id, count(*) AS n, count(DISTINCT gram) AS distinct_grams FROM ({_GRAMS}) GROUP BY 1")
def _(s, d):
    p = search.postings(docs(s, d))
    return p.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("distinct_grams"))


_QUERY_GRAMS = "SELECT DISTINCT substr(r, i, n) AS gram FROM (SELECT unnest(['mit', 'license', 'thing']) AS r), (SELECT unnest(range(3, 9)) AS n), (SELECT unnest(range(1, 9)) AS i) WHERE i + n - 1 <= length(r)"


@query(
    "x02_bm25",
    f"""WITH g AS ({_GRAMS}), l AS (SELECT doc_id, count(*) AS len FROM g GROUP BY 1), a AS (SELECT (SELECT count(*) FROM documents) AS docs, sum(len) / (SELECT count(*) FROM documents)::DOUBLE AS avg_len FROM l),
t AS (SELECT doc_id, gram, count(*) AS tf FROM g WHERE gram IN ({_QUERY_GRAMS}) GROUP BY ALL), f AS (SELECT gram, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score FROM t JOIN f USING (gram) JOIN l USING (doc_id), a GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""",
)
def _(s, d):
    return search.bm25(docs(s, d), "mit license thing")


@query("x03_upsert", "SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(s, d):
    x = docs(s, d).select("doc_id", "text")
    first = dedup.exact_dedup(x, key=F.md5(F.col("text").cast("binary")))
    return search.upsert(first, x, F.md5(F.col("text").cast("binary"))).select("doc_id")


# -- pipelines ------------------------------------------------------------------------------------------------


@query("o05_mine")
def _(s, d):
    return pipelines.mine(docs(s, d)).select("doc_id", "language", "language_score", "nlines", "perplexity", "bucket")


@query("o09_filter_corpus")
def _(s, d):
    return pipelines.filter_corpus(docs(s, d)).select("doc_id", "text")


@query("o11_clean_site")
def _(s, d):
    return pipelines.clean_site(docs(s, d)).select("doc_id", "text")


from . import queries_more  # noqa: E402,F401 - registers the others
