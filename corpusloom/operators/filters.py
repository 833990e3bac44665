"""Document quality filters: metrics as columns, verdicts against cutoffs by language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import sliced
from .profile import percentiles
from .wordlists import FLAGGED, STOPWORDS

#: Characters that count as special: punctuation, symbols, separators, formats, ASCII digits, white space.
SPECIAL = r"[\p{P}\p{S}\p{Z}\p{Cf}0-9\t\n\r\f\x0B]"
_ASCII_SPECIAL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())


@dataclass(frozen=True)
class Cutoffs:
    """Parameters of one language."""

    drop_bad: bool = False
    drop_long: bool = False
    word_most: int = 50
    words_least: int = 10
    words_most: int = 100_000
    char_size: int = 10
    char_most: float = 0.2
    word_size: int = 5
    word_rep_most: float = 0.3
    special_most: float = 0.4
    stop_least: float = 0.1
    flagged_most: float = 0.1
    lang_least: float = 0.7
    perplexity_most: float = 10_000


# language: longest word, fewest words, character and word repetition, special, stop, flagged, language, perplexity
_BY_LANGUAGE = """
ar 25 20 .20 .34 .30 .07 .03 .81 2300
bn 20 33 .13 .21 .45 .002 .001 .95 2000
ca 20 15 .2 .4 .25 .25 .1 .8 2500
en 25 20 .106 .19 .4 .3 .01 .80 1500
es 25 16 .14 .25 .34 .4 .01 .8 1300
eu 28 8 .20 .40 .31 .05 .1 .70 3000
fr 45 13 .14 .13 .34 .27 .008 .8 1770
hi 25 38 .18 .47 .45 .01 .005 .90 1517
id 30 15 .15 .20 .34 .15 .01 .7 5000
pt 19 19 .25 .98 .35 .2 .007 .6 3038
ur 25 25 .19 .5 .25 .01 .025 .90 1495
vi 25 30 .15 .20 .34 .08 .005 .90 1600
zh 1000 1 .2 .96 .3 .1691 .001 .85 2095
"""
CUTOFFS: dict[str, Cutoffs] = {}
for _row in _BY_LANGUAGE.split("\n")[1:-1]:
    _name, _long, _few, *_rest = _row.split()
    CUTOFFS[_name] = Cutoffs(True, True, int(_long), int(_few), 100_000, 10, *map(float, _rest[:1]), 5, *map(float, _rest[1:]))
CUTOFFS["ur"] = replace(CUTOFFS["ur"], word_size=7)
CUTOFFS["zh"] = replace(CUTOFFS["zh"], drop_bad=False, drop_long=False, words_most=1_000_000, char_size=3)


def cutoffs(language: str) -> Cutoffs:
    return CUTOFFS.get(language, Cutoffs())


def by_language(lang: Column, name: str) -> Column:
    """A cutoff as a column, the default for unknown languages."""
    out = F.lit(getattr(Cutoffs(), name))
    for language, own in CUTOFFS.items():
        out = F.when(lang == language, F.lit(getattr(own, name))).otherwise(out)
    return out


def number_words(c: Column) -> Column:
    return F.size(T.words(c, strip_chars=_ASCII_SPECIAL)).cast("long")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    key = (a[:n] ^ (a[:n] >> np.uint64(29))) * _MIX + b[:n]
    return key ^ (key >> np.uint64(32))


def _character_repetition(text: str, n: int) -> float:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < n:
        return 0.0
    # hashes of windows of 1, 2, 4, .. characters are joined to those of n
    part, width, key, have = codes.astype(np.uint64) * _MIX, 1, None, 0
    while width <= n:
        if n & width:
            key = part if key is None else _join(key, part[have:])
            have += width
        part, width = _join(part, part[width:]), width * 2
    key = key[: len(codes) - n + 1]
    count = np.sort(np.unique(key, return_counts=True)[1])[::-1]
    top = min(int(np.sqrt(len(count))), len(count) - int((count > 1).sum()))
    return float(count[:top].sum() / count.sum())


def _word_repetition(words: Sequence[str], n: int) -> float:
    count = Counter(zip(*(words[i:] for i in range(n))))
    total = sum(count.values())
    return sum(v for v in count.values() if v > 1) / total if total else 0.0


def character_repetition(c: Column, size: int | Column = 10) -> Column:
    """Share of the most frequent character n-grams, at most the root of their number, among all."""

    ratio = sliced("double", lambda text, n: [_character_repetition(t or "", int(k)) for t, k in zip(text, n)])
    return ratio(c, size if isinstance(size, Column) else F.lit(size))


def word_repetition(c: Column, size: int | Column = 5) -> Column:
    """Share of the places of word n-grams that occur more than once."""

    ratio = sliced("double", lambda text, n: [_word_repetition(_words(t or ""), int(k)) for t, k in zip(text, n)])
    return ratio(F.lower(c), size if isinstance(size, Column) else F.lit(size))


def _words(text: str) -> list[str]:
    """As ``functions.text.words`` with the characters of ``_ASCII_SPECIAL`` trimmed."""
    stripped = (w.strip(_ASCII_SPECIAL) for w in text.replace("\n", " ").replace("\t", " ").split(" "))
    return [w for w in stripped if w]


def special_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, SPECIAL, ""))) / n).otherwise(F.lit(0.0))


def listed_ratio(c: Column, lang: Column, lists: Mapping[str, str | Sequence[str]]) -> Column:
    """Share of a document's words that its language's list holds, 1 at most; null without a list."""
    known = {language: set(items.split() if isinstance(items, str) else items) for language, items in lists.items()}

    def share(w: Column) -> Column:
        out = F.lit(None).cast("double")
        for language, items in known.items():
            hits = F.size(F.filter(w, lambda x: x.isin(sorted(items))))  # noqa: B023
            out = F.when(lang == language, F.when(F.size(w) > 0, F.least(hits / F.size(w), F.lit(1.0))).otherwise(F.lit(0.0))).otherwise(out)
        return out

    return T.let(T.words(c, lower=True, strip_chars=_ASCII_SPECIAL), share) if known else F.lit(None).cast("double")


_METRICS = "number_words long, character_repetition double, word_repetition double, stop_ratio double, flagged_ratio double"


def metrics(docs: DataFrame, text: str = "text", lang: str = "lang", stopwords: Mapping = STOPWORDS, flagged: Mapping = FLAGGED) -> DataFrame:
    """All metrics beside the columns of ``docs``. Words are made once a text, in one Arrow function for those that need them."""
    c, code = F.coalesce(F.col(text), F.lit("")), F.col(lang)
    lists = [{k: frozenset(v.split() if isinstance(v, str) else v) for k, v in x.items()} for x in (stopwords, flagged)]

    def rows(texts: list, langs: list, chars: list, words: list) -> list[tuple]:
        out = []
        for t, k, n_chars, n_words in zip(texts, langs, chars, words):
            w = _words(t.lower())
            shares = [(min(1.0, sum(x in known[k] for x in w) / len(w)) if w else 0.0) if k in known else None for known in lists]
            out.append((len(_words(t)), _character_repetition(t, int(n_chars)), _word_repetition(w, int(n_words)), *shares))
        return out

    of = sliced(_METRICS, rows)
    measured = docs.withColumn("_m", of(c, code, by_language(code, "char_size"), by_language(code, "word_size")))
    return measured.select(*docs.columns, "_m.number_words", "_m.character_repetition", "_m.word_repetition", special_ratio(c).alias("special_ratio"), "_m.stop_ratio", "_m.flagged_ratio")


def threshold_metrics(docs: DataFrame, text: str = "text", lang: str = "lang", char_sizes: Sequence[int] = tuple(range(2, 16)), word_sizes: Sequence[int] = tuple(range(3, 11))) -> DataFrame:
    """What thresholds are chosen by: all metrics to four digits, repetition for many sizes, and the words' flags.

    ``character_repetitions`` and ``word_repetitions`` are maps by size; ``words`` holds each word with its
    length and whether it has a bad substring.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    kind = "character_repetitions map<int,double>, word_repetitions map<int,double>"

    def rows(texts: list) -> list[tuple]:
        out = []
        for t in texts:
            w = _words(t.lower())
            out.append(([(n, round(_character_repetition(t, n), 4)) for n in char_sizes], [(n, round(_word_repetition(w, n), 4)) for n in word_sizes]))
        return out

    of = sliced(kind, rows)
    bad = lambda w: F.array_max(F.array(*(F.contains(w, F.lit(x)) for x in T.BAD_SUBSTRINGS)))
    words = F.transform(T.words(c, strip_chars=_ASCII_SPECIAL), lambda w: F.struct(w.alias("word"), F.length(w).alias("length"), bad(w).alias("bad")))
    m = metrics(docs, text, lang).withColumn("_r", of(c)).withColumn("words", words)
    ratios = ("character_repetition", "word_repetition", "special_ratio", "stop_ratio", "flagged_ratio")
    return m.select(*docs.columns, "number_words", *(F.round(r, 4).alias(r) for r in ratios), "_r.character_repetitions", "_r.word_repetitions", "words")


def verdict(spark, text: str, lang: str, cutoff: Cutoffs | None = None) -> dict:
    """All metrics of one text, and the first check that it fails under the language's or other cutoffs."""
    row = metrics(spark.createDataFrame([(text, lang)], "text string, lang string")).first().asDict()
    own = cutoff or cutoffs(lang)
    fails = [n for n, m, c, least in CHECKS if row.get(m) is not None and (row[m] < getattr(own, c) if least else row[m] > getattr(own, c))]
    return row | {"discard_reason": fails[0] if fails else None, "failed": fails}


#: Checks in order, cheap ones first: name, metric, cutoff, and whether it is a lower bound.
CHECKS = (
    ("words_few", "number_words", "words_least", True),
    ("words_many", "number_words", "words_most", False),
    ("character_repetition", "character_repetition", "char_most", False),
    ("word_repetition", "word_repetition", "word_rep_most", False),
    ("special", "special_ratio", "special_most", False),
    ("stopwords", "stop_ratio", "stop_least", True),
    ("flagged", "flagged_ratio", "flagged_most", False),
    ("language", "lang_score", "lang_least", True),
    ("perplexity", "perplexity", "perplexity_most", False),
)


def discard_reason(columns: Sequence[str], lang: Column) -> Column:
    """First check that fails, null where none does; a null metric passes."""
    out = None
    for name, metric, cutoff, least in CHECKS:
        if metric in columns:
            bound = by_language(lang, cutoff)
            fails = F.col(metric) < bound if least else F.col(metric) > bound
            out = F.when(fails, F.lit(name)) if out is None else out.when(fails, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", **lists) -> DataFrame:
    """Documents with metrics and ``discard_reason``; keep those where it is null."""
    measured = metrics(docs, text, lang, **lists)
    return measured.withColumn("discard_reason", discard_reason(measured.columns, F.col(lang)))


def modify_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Uniform white space, then bad and long words dropped as the language asks."""
    c = T.normalization(F.col(text), non_printing=False, lower=False, numbers=False, punct=False)
    c = F.when(by_language(F.col(lang), "drop_bad"), T.drop_bad_words(c, _ASCII_SPECIAL)).otherwise(c)
    c = F.when(by_language(F.col(lang), "drop_long"), T.drop_long_words(c, by_language(F.col(lang), "word_most"), _ASCII_SPECIAL)).otherwise(c)
    return docs.withColumn(text, c)


def discard_analysis(filtered: DataFrame) -> DataFrame:
    """Number and share of documents by first failing check."""
    total = filtered.agg(F.count(F.lit(1)).alias("total"))
    return filtered.groupBy(F.coalesce("discard_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("total")).alias("share"))


def outlier_histogram(df: DataFrame, value: str, bins: int = 50, reach: float = 9.0) -> DataFrame:
    """Histogram of the values within ``reach`` median absolute deviations of the median."""
    v = F.col(value).cast("double")
    middle = percentiles(df, value, {"med": 0.5}).first()
    med = middle["med"] if middle else None
    if med is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    spread = percentiles(df.select(F.abs(v - med).alias("away")), "away", {"mad": 0.5}).first()["mad"]
    kept = df.select(v.alias("v")).where(F.col("v").isNotNull() & (F.lit(med == 0) | (F.abs(F.col("v") - med) < reach * spread)))
    edges = kept.agg(F.min("v"), F.max("v")).first()  # two numbers
    lo, wide = edges[0], ((edges[1] or 0) - (edges[0] or 0)) / bins
    at = F.least(F.floor((F.col("v") - lo) / wide), F.lit(bins - 1)) if wide else F.lit(0)
    return kept.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def zipf(docs: DataFrame, text: str = "text", top: int = 100) -> DataFrame:
    """Most frequent words with their rank; equal counts rank by word."""
    counts = docs.select(F.explode(T.words(F.col(text), lower=True, strip_chars=_ASCII_SPECIAL)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(top)
