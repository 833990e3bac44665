"""Language identification, n-gram language models, perplexity and its buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import SLICE, sliced
from ..storage import materialize
from .dedup import join_hot

#: Short lists of our own, of equal length; a user passes others.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it was on are as with be by this have or an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}


def language_scores(c: Column, lists: Mapping[str, str] = LANGUAGE_WORDS) -> Column:
    """array<struct<score, lang>>, best first: each language's share of the words that any list has.

    Scores are rounded to two digits; equal ones are in the order of the name.
    """
    w = F.filter(F.split(F.lower(F.replace(c, F.lit("\n"), F.lit(" "))), "[^\\p{L}]+"), lambda x: x != "")
    counts = T.let(w, lambda x: F.array(*(F.size(T.among(x, words.split())) for words in lists.values())))
    share = lambda n, i: F.when(sum((n[k] for k in range(len(lists))), F.lit(0)) > 0, F.round(n[i] / sum((n[k] for k in range(len(lists))), F.lit(0)), 2)).otherwise(F.lit(0.0))
    scored = T.let(counts, lambda n: F.array(*(F.struct(share(n, i).alias("score"), F.lit(lang).alias("lang")) for i, lang in enumerate(lists))))
    return F.array_sort(scored, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["lang"] < b["lang"], -1).otherwise(1))


def identify(docs: DataFrame, text: str = "text", top: int = 1, least: float = 0.0, lists: Mapping[str, str] = LANGUAGE_WORDS) -> DataFrame:
    """With ``top`` 1 the best language and its score, else a map of the best; rows below ``least`` go."""
    best = language_scores(F.col(text), lists)
    if top == 1:
        out = docs.withColumn("_l", best[0]).where(F.col("_l.score") >= least)
        return out.withColumn("pred_lang", F.col("_l.lang")).withColumn("pred_score", F.col("_l.score")).drop("_l")
    kept = F.filter(F.slice(best, 1, top), lambda x: x["score"] >= least)
    out = docs.withColumn("_l", kept).where(F.size("_l") > 0)
    return out.withColumn("pred_langs", F.map_from_arrays(F.transform("_l", lambda x: x["lang"]), F.transform("_l", lambda x: x["score"]))).drop("_l")


def other_language(c: Column, lang: Column, lists: Mapping[str, str] = LANGUAGE_WORDS) -> Column:
    """0.0 where another language scores higher than ``lang``; null else, and for languages without a list.

    Shares of listed words aren't on the scale of the cutoffs, so a document in its language gets no score.
    """
    verdict = lambda s: F.when(s[0]["score"] > F.filter(s, lambda x: x["lang"] == lang)[0]["score"], F.lit(0.0))
    return F.when(lang.isin(list(lists)), T.let(language_scores(c, lists), verdict))


def identify_by_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lists: Mapping[str, str] = LANGUAGE_WORDS) -> DataFrame:
    """Language of a document from its lines, each counting by score times length."""
    each = docs.select(F.col(id_col), F.explode(F.split(text, "\n")).alias("line")).where("line <> ''")
    scored = each.select(id_col, F.length("line").alias("n"), language_scores(F.col("line"), lists)[0].alias("l")).select(id_col, "n", "l.*")
    sums = scored.groupBy(id_col, "lang").agg(F.sum(F.col("score") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    best = F.max_by(F.struct("lang", "s"), F.struct(F.round("s", 6), F.col("lang"))).alias("b")
    return sums.groupBy(id_col).agg(best, F.sum("n").alias("n")).select(id_col, F.col("b.lang").alias("pred_lang"), (F.col("b.s") / F.col("n")).alias("pred_score"))


# -- a trained identifier ---------------------------------------------------------------

#: Characters of a gram, and grams that a model keeps of each language, its most frequent ones.
GRAM, GRAMS = 3, 4000
LID = "array<struct<score:double,lang:string>>"


def train_identifier(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = GRAMS) -> DataFrame:
    """Naive Bayes over character grams: lang, gram, logp; gram null stands for any other.

    Texts are lower case, line ends are blanks. Of each language the ``size`` most frequent grams
    count (a parameter of the model), with add-one smoothing over the grams of all languages.
    """
    clean = F.lower(F.regexp_replace(F.col(text), "[\n\t ]+", " "))
    each = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), clean.alias("t")).where(F.length("t") >= GRAM)
    counts = each.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counts.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= size).drop("_r")
    kept = materialize(kept, "gram-counts")  # size grams a language
    known = kept.select("gram").distinct()
    total = kept.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("v", F.lit(known.count()))
    rows = kept.unionByName(total.select("lang", F.lit(None).cast("string").alias("gram"), F.lit(0).cast("long").alias("n")))
    return rows.join(total, "lang").select("lang", "gram", F.log((F.col("n") + 1) / (F.col("total") + F.col("v") + 1)).alias("logp"))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and 63-bit code of every gram."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[: len(data) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = code << 21 | data[k : len(data) - GRAM + 1 + k]
    of, left = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    ok = np.flatnonzero(left[: len(code)] >= GRAM)
    return of[ok], code[ok]


def _gram_counts(batches):
    """Grams of each language with their number, a row a gram and some millions of characters."""
    held: dict[str, list] = {}
    size = 0

    def rows():
        for lang, parts in held.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([k for _, k in parts])).astype(np.int64)
            for k in range(0, len(codes), 100_000):
                some = codes[k : k + 100_000]
                signs = np.stack([some >> 21 * (GRAM - 1 - i) & 0x1FFFFF for i in range(GRAM)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                grams = [signs[i : i + GRAM] for i in range(0, len(signs), GRAM)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(grams, pa.string()), pa.array(n[k : k + 100_000])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            of, codes = _codes(part["t"].to_pylist())
            langs, number = np.unique(np.array(part["lang"].to_pylist(), object), return_inverse=True)
            for k, lang in enumerate(langs):
                found, n = np.unique(codes[number[of] == k], return_counts=True)
                held.setdefault(lang, []).append((found, n))
                size += len(found)
            if size > 4_000_000:
                yield from rows()
                size = 0
    yield from rows()


def identifier_scores(c: Column, model: DataFrame) -> Column:
    """array<struct<score, lang>>, best first: each language's share by the mean log probability of the grams.

    Shares are those of exp(10 * mean), rounded to two digits; equal ones are in the order of the name; a
    text without a gram has all alike. The model, ``GRAMS`` rows a language, goes to the workers.
    """
    rows = model.collect()
    names = sorted({r["lang"] for r in rows})
    code = lambda g: sum(ord(x) << 21 * (GRAM - 1 - i) for i, x in enumerate(g))
    keys = np.array(sorted({code(r["gram"]) for r in rows if r["gram"] is not None}), np.int64)
    table = np.zeros((len(keys) + 1, len(names)))
    for r in rows:
        if r["gram"] is None:
            table[:, names.index(r["lang"])] = r["logp"]
    for r in rows:
        if r["gram"] is not None:
            table[np.searchsorted(keys, code(r["gram"])), names.index(r["lang"])] = r["logp"]

    def scores(texts: list) -> list:
        part = [t or "" for t in texts]
        doc, codes = _codes(part)
        place = np.minimum(np.searchsorted(keys, codes), max(0, len(keys) - 1))
        place = np.where(keys[place] == codes, place, len(keys)) if len(keys) else np.zeros(len(codes), np.int64)
        n = np.bincount(doc, minlength=len(part))
        mean = np.stack([np.bincount(doc, table[place, k], len(part)) for k in range(len(names))], axis=1) / np.maximum(n, 1)[:, None] if names else np.zeros((len(part), 0))
        share = np.exp(10 * (mean - mean.max(axis=1, keepdims=True))) if names else mean
        share = np.round(share / share.sum(axis=1, keepdims=True), 2) if names else mean
        return [[{"score": float(s), "lang": k} for s, k in sorted(zip(row, names), key=lambda x: (-x[0], x[1]))] for row in share]

    # not deterministic for Spark alone: else a filter on the result would score each text once more
    of = sliced(LID, scores, 500).asNondeterministic()
    return of(F.lower(F.regexp_replace(c, "[\n\t ]+", " ")))


def identify_with(docs: DataFrame, model: DataFrame, text: str = "text", top: int = 1, least: float = 0.0, only: str | None = None) -> DataFrame:
    """As ``identify``, by a trained model; ``only`` keeps one language's rows."""
    scored = docs.withColumn("_l", identifier_scores(F.col(text), model))
    if top == 1:
        out = scored.withColumn("pred_lang", F.col("_l")[0]["lang"]).withColumn("pred_score", F.col("_l")[0]["score"]).drop("_l").where(F.col("pred_score") >= least)
        return out.where(F.col("pred_lang") == only) if only else out
    kept = scored.withColumn("_l", F.filter(F.slice("_l", 1, top), lambda x: x["score"] >= least)).where(F.size("_l") > 0)
    return kept.withColumn("pred_langs", F.map_from_arrays(F.transform("_l", lambda x: x["lang"]), F.transform("_l", lambda x: x["score"]))).drop("_l")


def annotate_languages(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A document's language and score, and those of each line with its length: id, lang, score, on_lines."""
    each = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("id_line", "line")).withColumn("l", identifier_scores(F.col("line"), model)[0])
    item = F.struct("id_line", F.length("line").alias("n_chars"), F.col("l.lang").alias("lang"), F.col("l.score").alias("score"))
    lines = each.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("on_lines"))
    whole = docs.select(id_col, identifier_scores(F.col(text), model)[0].alias("l")).select(id_col, F.col("l.lang").alias("lang"), F.col("l.score").alias("score"))
    return whole.join(lines, id_col, "left")


def disagreement(docs: DataFrame, lang: str = "lang", pred: str = "pred_lang") -> DataFrame:
    """Rows, and how many of them got another language than they had."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(lang) != F.col(pred)).alias("differ"))


# -- n-gram models -----------------------------------------------------------------------


def tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """One row a token: id (and group), pos, token, of the normalized text."""
    by = [group] if group else []
    return docs.select(id_col, *by, F.posexplode(T.split_words(T.normalize(F.col(text)))).alias("pos", "token"))


def word_counts(words: Column) -> Column:
    """array<struct<word, n>>: how often each item of an array comes, counted within the row."""

    @F.arrow_udf("array<struct<word:string,n:long>>")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(rows), SLICE):
            part = pc.fill_null(rows.slice(at, SLICE), "")
            split = pc.split_pattern(pc.replace_substring(pc.replace_substring(part, "\n", " "), "\t", " "), " ")
            each = pa.table({"doc": pc.list_parent_indices(split), "word": pc.list_flatten(split)})
            each = each.filter(pc.not_equal(each["word"], ""))
            counts = each.group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")])
            counts = counts.take(np.argsort(counts["doc"].to_numpy(), kind="stable"))
            ends = np.cumsum(np.bincount(counts["doc"].to_numpy(), minlength=len(part)))
            items = pa.StructArray.from_arrays([counts["word"].combine_chunks().cast(pa.string()), counts["count_all"].combine_chunks()], ["word", "n"])
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), items))
        return pa.concat_arrays(out or [pa.array([], pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))])

    return of(words)


def counted_words(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """A row a document and distinct word of its normalized text: the columns, word, n. Nothing is shuffled."""
    return docs.select(*columns, F.explode(word_counts(T.normalize(F.col(text)))).alias("c")).select(*columns, "c.word", "c.n")


def ngram_counts(docs: DataFrame, size: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    grams = docs.select(F.explode(T.ngrams(T.split_words(T.normalize(F.col(text))), size)).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


def continuation_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each word how many different words come before it."""
    pairs = docs.select(F.explode(T.ngrams(T.split_words(T.normalize(F.col(text))), 2)).alias("g")).distinct()
    return pairs.groupBy(F.substring_index("g", " ", -1).alias("word")).agg(F.count(F.lit(1)).alias("continuations"))


def vocabulary(docs: DataFrame, text: str = "text", size: int = 65536) -> DataFrame:
    counts = counted_words(docs, [], text).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(size)


def train_unigram(docs: DataFrame, text: str = "text", group: str = "lang") -> DataFrame:
    """log10 probability of each word of a group with add-one smoothing; word null stands for any other."""
    return unigram_of(counted_words(docs, [group], text), group)


def unigram_of(counted: DataFrame, group: str = "lang") -> DataFrame:
    """The same from the words of each document, counted already."""
    counts = counted.groupBy(group, "word").agg(F.sum("n").alias("n"))
    total = counts.groupBy(group).agg((F.sum("n") + F.count(F.lit(1)) + 1).cast("double").alias("total"))
    rows = counts.unionByName(total.select(group, F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n")))
    return rows.join(total, group).select(group, "word", F.log10((F.col("n") + 1) / F.col("total")).alias("logp"), "n")


DISCOUNT = 0.75


@lru_cache(1 << 18)
def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _grams(docs: DataFrame, group: str, text: str) -> DataFrame:
    """A row a place: the columns but the text, its word ``w``, and 64-bit hashes of the group with that
    word and the two before it, ``hw``, ``hv`` and ``hu``; a sentence's bounds are words.
    """
    names = [c for c in docs.columns if c != text]
    clean = docs.select(*names, T.normalize(F.col(text)).alias("_t")).where(F.col(group).isNotNull() & F.col("_t").isNotNull())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                split = pc.split_pattern(part["_t"], " ")
                flat, of = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
                ok = pc.not_equal(flat, "")
                flat, of = flat.filter(ok), of[ok.to_numpy(zero_copy_only=False)]
                rows, rank, sizes = np.unique(of, return_inverse=True, return_counts=True)
                if not len(rows):
                    continue
                coded = flat.dictionary_encode()
                words = [*coded.dictionary.to_pylist(), "</s>", "<s>"]
                # each text as numbers of its words: two begins, the words, and an end
                starts = np.cumsum(sizes + 3) - (sizes + 3)
                line = np.full(int((sizes + 3).sum()), len(words) - 1)
                line[starts[rank] + 2 + np.arange(len(of)) - (np.cumsum(sizes) - sizes)[rank]] = coded.indices.to_numpy()
                line[starts + sizes + 2] = len(words) - 2
                keep = np.ones(len(line), bool)
                keep[starts] = keep[starts + 1] = False
                place, doc = np.flatnonzero(keep), np.repeat(rows, sizes + 1)
                own = np.array([_hash(f"\0{g}") for g in part[group].to_pylist()], np.int64)[doc]
                hashes = np.array([_hash(w) for w in words], np.int64)
                columns = [part[c].take(pa.array(doc)) for c in names] + [pa.array(words, pa.string()).take(pa.array(line[place]))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(hashes[line[place - k]] ^ own) for k in (2, 1, 0))], [*names, "w", "hu", "hv", "hw"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return clean.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "w string, hu long, hv long, hw long"]))


def train_trigrams(docs: DataFrame, text: str = "text", group: str = "lang", discount: float = DISCOUNT) -> dict[str, DataFrame]:
    """Interpolated Kneser-Ney of order 3, a model for each group, as tables that grow with the corpus.

    ``seen``: log10 p of each place that was seen, by a hash of its words. Of lower orders, by the hashes
    of ``_grams``: ``two``: (hv, hw) and its discounted share over continuations; ``one``: w's share of all
    continuations; ``back3`` and ``back2``: what a context leaves to the lower order; ``other``: the share
    of a word that wasn't seen.
    """
    # rows of one middle word are one part, sorted twice by whole numbers, where all counts but those of the last word are at hand
    places = _grams(docs.select(group, text), group, text).repartition("hv")
    c3 = places.groupBy("hv", "hu", "hw").agg(F.first(group).alias(group), F.first("w").alias("w"), F.count(F.lit(1)).alias("n"))
    whole = lambda *by: W.partitionBy("hv", *by)
    c3 = c3.select("*", (F.row_number().over(W.partitionBy("hv", "hu").orderBy("hw")) == 1).alias("first_uv"))
    c3 = c3.select("*", F.sum("n").over(whole("hu")).alias("total3"), F.count(F.lit(1)).over(whole("hu")).alias("kinds3"))
    c3 = c3.select("*", (F.row_number().over(W.partitionBy("hv", "hw").orderBy("hu")) == 1).alias("first2"))
    c3 = c3.select("*", F.count(F.lit(1)).over(whole("hw")).alias("n2"))
    c3 = c3.select("*", F.count(F.lit(1)).over(whole()).alias("total2"), F.count_if("first2").over(whole()).alias("kinds2"), (F.row_number().over(W.partitionBy("hv").orderBy("hw", "hu")) == 1).alias("first_v"))
    c3 = materialize(c3, "lm-3")
    c1 = materialize(c3.where("first2").groupBy(group, "w").agg(F.first("hw").alias("hw"), F.count(F.lit(1)).alias("n")), "lm-1")
    all_ = c1.groupBy(group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    # the unigrams leave a discounted share for all words of the vocabulary and one unseen word
    one = c1.join(F.broadcast(all_), group).select(group, "w", "hw", ((F.col("n") - discount) / F.col("total") + F.col("kinds") * discount / F.col("total") / (F.col("kinds") + 1)).alias("p"))
    other = all_.select(group, (F.col("kinds") * discount / F.col("total") / (F.col("kinds") + 1)).alias("p"))
    p3, b3 = (F.col("n") - discount) / F.col("total3"), F.col("kinds3") * discount / F.col("total3")
    p2, b2 = (F.col("n2") - discount) / F.col("total2"), F.col("kinds2") * discount / F.col("total2")
    # of a place that was seen all is known but the last word's share, so only hashes and two numbers are moved
    parts = c3.select("hw", *_place(), (p3 + b3 * p2).alias("_a"), (b3 * b2).alias("_b"))
    return {
        "back3": c3.where("first_uv").select("hu", "hv", b3.alias("b3")), "two": c3.where("first2").select("hv", "hw", p2.alias("p2")), "back2": c3.where("first_v").select("hv", b2.alias("b2")),
        "one": one, "other": other, "seen": parts.join(one.select("hw", "p"), "hw").select("_h", "_g", F.log10(F.col("_a") + F.col("_b") * F.col("p")).alias("logp")), "trained_on": docs.select(group, text),
    }


def _place() -> list[Column]:
    """96 bits that stand for a place's group and words."""
    return [F.xxhash64("hu", "hv", "hw").alias("_h"), F.hash("hu", "hv", "hw").alias("_g")]


def trigram_logp(docs: DataFrame, model: dict[str, DataFrame], keys: list[str], text: str = "text", group: str = "lang") -> DataFrame:
    """Keys, sum of log10 p, and number of places: words and the end of the text.

    Places are moved as hashes of their words. Those that the model has seen are looked up; lower orders
    are asked only for the others, each kind of place once. A model has seen all places of its own documents.
    """
    own = docs.select(group, text).sameSemantics(model["trained_on"])
    found = _grams(docs.select(*keys, *([group] if group not in keys else []), text), group, text)
    places = found.select(*keys, *_place())
    scored = model["seen"]
    if not own:
        seen = materialize(scored, "lm-seen")
        kinds = found.groupBy("hu", "hv", "hw").agg(F.first(group).alias(group)).select("*", *_place())
        fresh = materialize(kinds.hint("merge").join(seen.select("_h", "_g"), ["_h", "_g"], "left_anti"), "lm-fresh")
        lower = fresh.join(model["back3"], ["hu", "hv"], "left").join(model["two"], ["hv", "hw"], "left").join(model["back2"], "hv", "left").join(model["one"].select("hw", F.col("p").alias("p1")), "hw", "left")
        lower = lower.join(F.broadcast(model["other"].withColumnRenamed("p", "p0")), group)
        p = F.coalesce("b3", F.lit(1.0)) * (F.coalesce("p2", F.lit(0.0)) + F.coalesce("b2", F.lit(1.0)) * F.coalesce("p1", "p0"))
        scored = seen.unionByName(lower.select("_h", "_g", F.log10(p).alias("logp")))
    return places.hint("merge").join(scored, ["_h", "_g"]).groupBy(*keys).agg(F.sum("logp").alias("logp"), F.count(F.lit(1)).alias("places"))


def trigram_perplexity(docs: DataFrame, model: dict[str, DataFrame], id_col: str = "doc_id", text: str = "text", group: str = "lang") -> DataFrame:
    """Perplexity of each document under its group's model, to one digit; null without a model or word."""
    scored = trigram_logp(docs, model, [id_col], text, group)
    return docs.select(id_col, group).join(scored, id_col, "left").select(id_col, group, F.round(F.pow(F.lit(10.0), -F.col("logp") / F.col("places")), 1).alias("perplexity"))


def sentence_perplexity(docs: DataFrame, model: dict[str, DataFrame], id_col: str = "doc_id", text: str = "text", group: str = "lang") -> DataFrame:
    """id, pos, sentence and perplexity of each line that has a word and a model."""
    each = docs.select(id_col, group, F.posexplode(F.split(text, "\n")).alias("pos", "sentence"))
    scored = trigram_logp(each, model, [id_col, "pos"], "sentence", group)
    return each.join(scored, [id_col, "pos"]).select(id_col, "pos", "sentence", F.round(F.pow(F.lit(10.0), -F.col("logp") / F.col("places")), 1).alias("perplexity"))


def mine_sentences(docs: DataFrame, model: dict[str, DataFrame], most: float, id_col: str = "doc_id", text: str = "text", group: str = "lang") -> DataFrame:
    """Sentences that a model finds likely: 0 < perplexity < ``most``, each once by its normalized wording.

    Sentences end at end signs and lines. The perplexity is per word, the end of a sentence not counted.
    """
    parts = F.flatten(F.transform(F.split(text, "\n"), T.sentences))
    each = docs.select(id_col, group, F.posexplode(parts).alias("pos", "sentence")).withColumn("sentence", T.strip(F.col("sentence"))).where("sentence <> ''").withColumn("key", T.normalize(F.col("sentence"))).where("key <> ''")
    first = each.groupBy(group, F.md5(F.col("key").cast("binary")).alias("h")).agg(F.min(F.struct(id_col, "pos", "sentence")).alias("x")).select(group, "x.*")
    first = materialize(first, "sentences")
    scored = trigram_logp(first, model, [id_col, "pos"], "sentence", group)
    value = F.round(F.pow(F.lit(10.0), -F.col("logp") / (F.col("places") - 1)), 1)
    return first.join(scored, [id_col, "pos"]).select(id_col, "pos", "sentence", value.alias("perplexity")).where((F.col("perplexity") > 0) & (F.col("perplexity") < most))


def perplexity_histogram(scored: DataFrame, value: str = "perplexity", most: float = 2000.0, bins: int = 50) -> DataFrame:
    """Counts of equal bins of the values from 0 and below ``most``."""
    v = F.col(value)
    return scored.where((v >= 0) & (v < most)).groupBy(F.floor(v / (most / bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def classify_and_split(docs: DataFrame, model: DataFrame, path: str, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows by predicted language, written to a folder each, and read back."""
    identify_with(docs, model, text, least=least).write.partitionBy("pred_lang").parquet(path)
    return docs.sparkSession.read.parquet(path)


def project(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 2) -> DataFrame:
    """Principal components of vectors: id and pc1, pc2, .., each scaled to 0..255.

    Sums of products are made by the tasks; the driver gets one matrix as wide as the vectors. Signs
    are such that the largest weight of a component is positive. Vectors that are null or hold nulls
    are left out.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda v: v.isNull())).select(id_col, x.alias("x"))
    wide = rows.agg(F.max(F.size("x"))).first()[0] or 0

    def moments(batches):
        n, total, square = 0, np.zeros(wide), np.zeros((wide, wide))
        for pdf in batches:
            if len(pdf):
                data = np.stack(pdf["x"].to_numpy()).astype(np.float64)
                n, total, square = n + len(data), total + data.sum(axis=0), square + data.T @ data
        yield pd.DataFrame({"n": [n], "total": [total.tolist()], "square": [square.ravel().tolist()]})

    parts = rows.select("x").mapInPandas(moments, "n long, total array<double>, square array<double>")
    # one row a task, summed in a tree of partial sums by place
    n = parts.agg(F.sum("n")).first()[0] or 0
    sums = {name: np.array([r["s"] for r in parts.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).orderBy("i").collect()]) for name in ("total", "square")} if n else {}
    if not n:
        return rows.select(id_col, *(F.lit(None).cast("double").alias(f"pc{k + 1}") for k in range(dimensions)))
    mean = sums["total"] / n
    _, axes = np.linalg.eigh(sums["square"].reshape(wide, wide) / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dimensions]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    value = lambda k: F.aggregate(F.zip_with("x", F.array(*map(F.lit, axes[:, k].tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - float(mean @ axes[:, k])
    placed = materialize(rows.select(id_col, *(value(k).alias(f"pc{k + 1}") for k in range(axes.shape[1]))), "projected")
    edges = placed.agg(*(f(f"pc{k + 1}").alias(f"{f.__name__}{k}") for k in range(axes.shape[1]) for f in (F.min, F.max))).first()
    scale = lambda k: F.when(F.lit(edges[f"max{k}"] > edges[f"min{k}"]), (F.col(f"pc{k + 1}") - edges[f"min{k}"]) / (edges[f"max{k}"] - edges[f"min{k}"]) * 255).otherwise(0.0)
    return placed.select(id_col, *(F.round(scale(k), 3).alias(f"pc{k + 1}") for k in range(axes.shape[1])))


def perplexity(logp: Column, length: Column) -> Column:
    """10 ** (-sum of log10 p / (tokens + 1))."""
    return F.pow(F.lit(10.0), -logp / (length + 1))


def document_perplexity(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text: str = "text", group: str = "lang", counted: DataFrame | None = None) -> DataFrame:
    """Perplexity of each document under its group's model, to one digit; null without a model or word.

    Words are counted within a document before anything is shuffled (or handed in, ``counted``). Words
    that a large part of the documents has are few, and their row of the model is broadcast.
    """
    other = model.where("word IS NULL").select(group, F.col("logp").alias("other"))
    counted = materialize(counted_words(docs, [id_col, group], text), "lm-words") if counted is None else counted
    known = materialize(model.where("word IS NOT NULL"), "lm-model")
    met = counted.groupBy(group, "word").agg(F.count(F.lit(1)).alias("docs")).join(known.select(group, "word", "logp"), [group, "word"], "left")
    met = materialize(met, "lm-met")
    scored = join_hot(counted, met, [group, "word"], "docs", counted.count()).join(F.broadcast(other), group).groupBy(id_col).agg(F.sum(F.col("n") * F.coalesce("logp", "other")).alias("s"), F.sum("n").alias("n"))
    return docs.select(id_col, group).join(scored, id_col, "left").select(id_col, group, F.round(perplexity(F.col("s"), F.col("n")), 1).alias("perplexity"))


def bucket(scored: DataFrame, cutoffs: DataFrame, group: str = "lang", value: str = "perplexity") -> DataFrame:
    """head below the 30th percentile, middle below the 60th, tail; "all" without a cutoff or for negatives."""
    v = F.col(value)
    named = F.when(F.col("p30").isNull() | (v < 0) | v.isNull(), "all").when(v < F.col("p30"), "head").when(v < F.col("p60"), "middle").otherwise("tail")
    return scored.join(cutoffs.select(group, "p30", "p60"), group, "left").withColumn("bucket", named).drop("p30", "p60")


def percentile_cutoffs(scored: DataFrame, group: str = "lang", value: str = "perplexity") -> DataFrame:
    """The exact 30th and 60th percentile of each group: values are counted first, so a task sees each value once."""
    from .profile import percentiles

    return percentiles(scored, value, {"p30": 0.3, "p60": 0.6}, group)


def keep_languages(docs: DataFrame, lang: str = "lang", keep: tuple[str, ...] = (), ban: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the languages to keep (none: all) that aren't banned."""
    out = docs.where(~F.col(lang).isin(list(ban))) if ban else docs
    return out.where(F.col(lang).isin(list(keep))) if keep else out


def fetch_metadata(minified: DataFrame, documents: DataFrame, keys: tuple[str, ...], line_ids: str = "line_ids", text: str = "text") -> DataFrame:
    """Text of each metadata row again: the lines that it names of the document with its keys.

    Numbers out of range are passed over, and rows without any line go.
    """
    lines = documents.select(*keys, F.split(text, "\n").alias("_lines"))
    joined = minified.join(lines, list(keys))
    picked = F.transform(F.filter(line_ids, lambda i: (i >= 0) & (i < F.size("_lines"))), lambda i: F.element_at("_lines", (i + 1).cast("int")))
    return joined.withColumn(text, F.array_join(picked, "\n")).where(F.size(picked) > 0).drop("_lines")
