"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode punctuation and, in the same order, what stands for it in ASCII.
PUNCT = "，。、「」„“”«»《》１´∶：？！（）；–～’━〈〉【】％►"
PUNCT_ASCII = ',.,""' + '"' * 8 + "':" + ":?!();-~'-<>[]%-"
#: The three that become several characters.
PUNCT_LONG = {"—": " - ", "．": ". ", "…": "..."}
PUNCT_ALL = PUNCT + "".join(PUNCT_LONG)
ODD_SPACES = "\u2009\u200a\u202f\u2005\u3000\u2002\u00a0\u2008\u2003\ufffc\u0084"
NON_PRINTING = r"[\x00-\x1F\x7F-\x9F]"
_EDGES = r"(?U)^\s+|\s+$"
BAD_SUBSTRINGS = ("http", "www", ".com", "href", "//")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def remove_non_printing(c: Column) -> Column:
    """Without control characters; line ends and tabs are among them."""
    return F.regexp_replace(c, NON_PRINTING, "")


def uniform_whitespace(c: Column) -> Column:
    return F.translate(c, ODD_SPACES, " " * len(ODD_SPACES))


def digits_to_zero(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}", "0")


def replace_unicode_punct(c: Column) -> Column:
    c = F.translate(c, PUNCT, PUNCT_ASCII)
    for sign, text in PUNCT_LONG.items():
        c = F.replace(c, F.lit(sign), F.lit(text))
    return c


def remove_unicode_punct(c: Column) -> Column:
    return F.translate(c, PUNCT_ALL, "")


@lru_cache(1)
def _accents() -> tuple[str, str]:
    source, target = [], []
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", char) if unicodedata.category(x) != "Mn")
        if plain != char and len(plain) == 1:
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Letters without their marks. Hangul syllables, which have several letters, stay as they are."""
    return F.regexp_replace(F.translate(c, *_accents()), r"\p{Mn}", "")


def normalize(c: Column, accent: bool = True, case: bool = True, numbers: bool = True, punct: int = 1) -> Column:
    """Crawl flavour: trimmed, lower case, no accents, digits as 0, punctuation replaced (1) or removed (2)."""
    c = strip(c)
    if case:
        c = F.lower(c)
    if accent:
        c = strip_accents(c)
    if numbers:
        c = digits_to_zero(c)
    if punct:
        c = replace_unicode_punct(c) if punct == 1 else remove_unicode_punct(c)
    return remove_non_printing(c)


def normalization(c: Column, non_printing: bool = True, strip_: bool = True, lower: bool = True, spaces: bool = True, numbers: bool = True, punct: bool = True) -> Column:
    """Filter flavour, each step by a switch, in this order."""
    for on, step in ((non_printing, remove_non_printing), (strip_, strip), (lower, F.lower), (spaces, uniform_whitespace), (numbers, digits_to_zero), (punct, replace_unicode_punct)):
        if on:
            c = step(c)
    return c


def normalize_for_dedup(c: Column) -> Column:
    """Key of a line: trimmed, lower case, digits as 0, no punctuation beyond ASCII, no control characters."""
    return remove_non_printing(remove_unicode_punct(digits_to_zero(F.lower(strip(c)))))


def normalize_context(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def spacing_for_tokens(c: Column, language: str = "en") -> Column:
    """Spacing before a tokenizer: brackets, quotes, signs after blanks, number separators.

    Some rules that look like patterns are literal text in the behaviour that this follows, so they
    have no effect on usual texts and are left out; a bracket before a sign keeps a backslash.
    """

    def swap(c: Column, *pairs: tuple[str, str]) -> Column:
        for old, new in pairs:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    c = swap(c, ("\r", ""), ("(", " ("), (")", ") "), (" +", " "))
    c = F.regexp_replace(c, r"\) ([.!:?;,])", r"\\)$1")
    c = swap(c, ("( ", "("), (" )", ")"))
    c = F.regexp_replace(c, r"(\p{Nd}) %", r"$1\\%")
    c = swap(c, (" :", ":"), (" ;", ";"), ("`", "'"), ("''", ' " '))
    c = swap(F.translate(c, "„“”–", '"""-'), ("—", " - "), (" +", " "))
    c = F.translate(c, "´‘‚’", "'\"\"\"")
    c = swap(c, ("''", '"'), ("…", "..."))
    for quote in "«»":
        around = (f" {quote} ", ' "' if quote == "«" else '" ')
        beside = (f"{quote} " if quote == "«" else f" {quote}", '"')
        c = swap(c, around, beside, (quote, '"'))
    c = swap(c, (" %", "%"), *((f" {sign}", sign) for sign in ":?!;"), (" +", " "), ("．", ". "))
    if language == "en":
        c = F.regexp_replace(c, r'"([,.]+)', '$1\\\\"')
    elif language not in ("cs", "cz"):
        c = swap(c, (',"', '",'))
        c = F.regexp_replace(c, r'(\.+)"((?U)\s*[^<])', '\\\\"$1$2')
    mark = "," if language in ("de", "es", "cz", "cs", "fr") else "."
    return F.regexp_replace(c, r"(\p{Nd}) (\p{Nd})", f"$1{mark}$2")


def split_words(c: Column, newline: bool = True, tab: bool = True) -> Column:
    """Words between blanks (and line ends, and tabs), none empty."""
    pattern = "|".join([" ", *["\n"] * newline, *["\t"] * tab])
    return F.filter(F.split(c, pattern), lambda w: w != "")


def words(c: Column, lower: bool = False, strip_chars: str = "") -> Column:
    """Words of a document, trimmed of a set of characters."""
    w = split_words(F.lower(c) if lower else c)
    return F.filter(F.transform(w, lambda x: F.btrim(x, F.lit(strip_chars))), lambda x: x != "") if strip_chars else w


def strip_characters(c: Column, chars: str) -> Column:
    """Without characters of a set at both ends."""
    return F.btrim(c, F.lit(chars))


def one_line(c: Column) -> Column:
    """Line ends as blanks."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def among(array: Column, items) -> Column:
    """Items of an array that a fixed list has."""
    known = F.array(*map(F.lit, sorted(set(items))))
    return F.filter(array, lambda x: F.array_contains(known, x))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(array: Column, size: int, joiner: str = " ") -> Column:
    """Joined windows of ``size`` items; none where there are fewer."""
    windows = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - size + 1), lambda i: F.array_join(F.slice(a, i, size), joiner))
    return let(array, lambda a: F.when(F.size(a) >= size, windows(a)).otherwise(F.array().cast("array<string>")))


def drop_words(c: Column, keep) -> Column:
    """Text without the words that ``keep`` refuses; separators collapse, empty sentences go."""
    parts = lambda x, sep: F.filter(F.split(x, sep), lambda y: y != "")
    line = lambda s: F.array_join(F.filter(F.transform(parts(s, "\t"), lambda t: F.array_join(F.filter(parts(t, " "), keep), " ")), lambda t: t != ""), "\t")
    return F.array_join(F.filter(F.transform(parts(c, "\n"), line), lambda s: s != ""), "\n")


def drop_bad_words(c: Column, strip_chars: str = "", bad: tuple[str, ...] = BAD_SUBSTRINGS) -> Column:
    def keep(word: Column) -> Column:
        word = F.btrim(word, F.lit(strip_chars)) if strip_chars else word
        out = F.lit(True)
        for part in bad:
            out = out & ~F.contains(word, F.lit(part))
        return out

    return drop_words(c, keep)


def drop_long_words(c: Column, most: int | Column, strip_chars: str = "") -> Column:
    def keep(word: Column) -> Column:
        short = F.length(word) <= most
        if strip_chars:
            bare = F.btrim(word, F.lit(strip_chars))
            short = short | ((bare != "") & (F.length(bare) <= most))
        return short

    return drop_words(c, keep)


def sentences(c: Column) -> Column:
    """Sentences with their end signs; joined they are the text again."""
    return F.filter(F.split(c, r"(?<=[.!?．。]\s)(?=\S)"), lambda s: s != "")


def line_key(c: Column) -> Column:
    """First eight bytes of SHA-1 of the normalized line, in hexadecimal."""
    return F.substring(F.sha1(normalize_for_dedup(c).cast("binary")), 1, 16)


def _base64(parts: Column) -> Column:
    """Base64, without line ends, of hexadecimal parts."""
    return F.translate(F.base64(F.unhex(F.array_join(parts, ""))), "\r\n", "")


def line_hashes32(c: Column) -> Column:
    """First four bytes of SHA-1 of each line of a text, one after another, in base64."""
    parts = F.transform(F.split(c, "\n"), lambda x: F.substring(F.sha1(normalize_for_dedup(x).cast("binary")), 1, 8))
    return _base64(parts)


def line_ids_base64(ids: Column) -> Column:
    """Line numbers as unsigned 16-bit little-endian integers in base64."""
    pair = lambda i: F.concat(F.lpad(F.hex(i % 256), 2, "0"), F.lpad(F.hex(F.floor(i / 256)), 2, "0"))
    return _base64(F.transform(ids, pair))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def registered_domain(host: Column) -> Column:
    """Last two labels of a host, three below a two-letter country with a short second label."""
    three = F.regexp_extract(host, r"([^.]+\.(?:com?|org|net|ac|gov|edu)\.[a-z]{2})$", 1)
    return F.when(three != "", three).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))


def surt(url: Column) -> Column:
    """Sort-friendly key: reversed host labels, then the path."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_replace(url_host(url), r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(F.lower(path)))


def html_lang(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", 1)
    return F.when(found != "", found)


# -- decoders, keys, tokenizers -----------------------------------------------------


def _hex(encoded: Column) -> Column:
    return F.hex(F.unbase64(encoded))


def line_ids(encoded: Column) -> Column:
    """Line numbers of ``line_ids_base64``: array<int>, 0 to 65,535."""
    at = lambda h, i: F.conv(F.concat(F.substr(h, i * 4 + 3, F.lit(2)), F.substr(h, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    some = lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.length(h) / 4).cast("int") - 1), lambda i: at(h, i))
    return let(_hex(encoded), lambda h: F.when(F.length(h) >= 4, some(h)).otherwise(F.array().cast("array<int>")))


def line_hashes(encoded: Column) -> Column:
    """Hashes of ``line_hashes32``: array<string> of eight hexadecimal digits."""
    some = lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.length(h) / 8).cast("int") - 1), lambda i: F.substr(h, i * 8 + 1, F.lit(8)))
    return let(_hex(encoded), lambda h: F.when(F.length(h) >= 8, some(h)).otherwise(F.array().cast("array<string>")))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest_key(digest: Column) -> Column:
    """First four bytes of a digest ``sha1:BASE32``, as eight hexadecimal digits; null for anything else."""
    first = F.regexp_extract(digest, "^sha1:([A-Z2-7]{7})", 1)
    value = F.aggregate(F.split(first, ""), F.lit(0).cast("long"), lambda a, c: a * 32 + F.instr(F.lit(_BASE32), c) - 1)
    return F.when(first != "", F.lpad(F.hex(F.shiftright(value, 3)), 8, "0"))


def primary_language(code: Column) -> Column:
    """The language that a list of codes begins with: its first three characters."""
    return F.substring(code, 1, 3)


#: Languages whose words aren't set apart by blanks.
NOT_SPACED = ("th", "zh", "ja")


def tokenise(c: Column, language: str = "en") -> Column:
    """Words and punctuation set apart by single blanks, line by line, case and numbers kept.

    Signs stand alone; a comma does unless digits are on both sides, a full stop only at the end of a
    line; an apostrophe between letters stays with what is behind it, in French, Italian and Catalan
    with what is before it. Lines of ``NOT_SPACED`` languages are as they were.
    """
    if language in NOT_SPACED:
        return c
    clings = "$1' $2" if language in ("fr", "it", "ca") else "$1 '$2"
    steps = (
        (r"([^\p{L}\p{M}\p{N} .',\-])", " $1 "),
        (r"([^\p{N}]),", "$1 , "),
        (r",([^\p{N}])", " , $1"),
        (r"([\p{L}])'([\p{L}])", clings),
        (r"([^ .])\.[ ]*$", "$1 ."),
        (r" +", " "),
    )

    def line(x: Column) -> Column:
        x = normalize(x, accent=False, case=False, numbers=False)
        for pattern, to in steps:
            x = F.regexp_replace(x, pattern, to)
        return F.btrim(x)

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def subword_pieces(c: Column, models: dict[str, str], language: Column) -> Column:
    """Pieces of the model of each row's language, joined by blanks; without a model the text stays as it is.

    ``models`` maps languages to files of the sentencepiece library, which a worker opens once.
    """
    known = dict(models)

    @F.pandas_udf("string")
    def pieces(text: pd.Series, lang: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(text, lang):
            model = None if t is None else _pieces_model(known.get(k) or known.get("*"))
            out.append(t if model is None else " ".join(model.encode(t, out_type=str)))
        return pd.Series(out, dtype=object)

    return pieces(c, language)


@lru_cache(8)
def _pieces_model(path: str | None):
    if path is None:
        return None
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
