"""Text functions as column expressions: words, terms, stems, grams, sentences, hashes, scripts and small formatters."""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that carry no content.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its me my no not of on or our she so such "
    "than that the their them then there these they this those to too us was we were what when where which while who whom why will with would you your all any "
    "each also just only own same very s t about after before over under up down out off again more most other some should must may"
).split()
# Words the stemmer leaves alone.
STEM_EXCEPTIONS = "news series species lens gas bus yes always perhaps thus its".split()
# Suffix, replacement and least length of what is left, in the order they are tried.
SUFFIXES = (
    ("ization", "ize", 4), ("ational", "ate", 4), ("ations", "ate", 4), ("ation", "ate", 4), ("ments", "", 5), ("ment", "", 5),
    ("ies", "y", 4), ("ied", "y", 4), ("sses", "ss", 4), ("es", "", 3), ("ing", "", 4), ("ed", "", 4), ("s", "", 4),
)
SIBILANT, PLAIN_S = "(?:s|x|z|ch|sh)es$", "(?:ss|us|is)$"
# The low halves of the 64-bit FNV-1a offset basis and prime.
FNV_START, FNV_PRIME = 0x84222325, 0x1B3
# Scripts written without spaces.
UNSPACED = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\u0E00-\\u0E7F\\x{20000}-\\x{2FA1F}"
# The words that the loader's tokens leave out.
LOADER_STOPWORDS = "a an and are as at be but by for from has have in is it its of on or that the this to was were will with".split()


def split_words(text: Column) -> Column:
    """Lower-case word parts: split at what is not alphanumeric, at camel-case and digit boundaries; unspaced runs become bigrams."""
    s = F.coalesce(text, F.lit(""))
    s = F.regexp_replace(s, f"([{UNSPACED}]+)", " $1 ")
    s = F.regexp_replace(s, r"[^\p{IsAlphabetic}\p{N}]+", " ")
    s = F.regexp_replace(s, r"(\p{Ll})(\p{Lu})", "$1 $2")
    s = F.regexp_replace(s, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    s = F.regexp_replace(s, r"([0-9])([^0-9\s])", "$1 $2")
    s = F.regexp_replace(s, r"([^0-9\s])([0-9])", "$1 $2")
    words = F.filter(F.split(F.lower(s), " +"), lambda w: w != "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
    parts = F.transform(words, lambda w: F.when(w.rlike(f"^[{UNSPACED}]{{2,}}$"), pairs(w)).otherwise(F.array(w)))
    return F.flatten(parts)


def terms(text: Column) -> Column:
    """Content words in order, repeats kept: no stop words, no single characters but digits and unspaced ones."""
    return F.filter(split_words(text), lambda w: ~w.isin(STOPWORDS) & ((F.length(w) > 1) | w.rlike(f"^[0-9{UNSPACED}]$")))


def _simple_letters() -> tuple[str, str, str]:
    """Upper and lower letters below U+0250, and all characters whose words need no more than these and the ten digits, as regex classes.

    Outside are a letter that lower-cases to two, letters without case and other numbers, and whatever lies beyond but
    general punctuation and currency signs.
    """
    kinds = {c: unicodedata.category(c) for c in map(chr, [*range(0x250), *range(0x2010, 0x2065), *range(0x20A0, 0x20C1)])}
    upper = [c for c, k in kinds.items() if k == "Lu" and c != "\u0130"]
    lower = [c for c, k in kinds.items() if k == "Ll"]
    plain = [c for c, k in kinds.items() if k[0] in "PSZC" or "0" <= c <= "9"]
    joined = lambda chars: "".join(re.escape(c) for c in chars)
    return joined(upper), joined(lower), joined(upper + lower + plain)


UPPER, LOWER, SIMPLE = _simple_letters()
SIMPLE_TEXT, SIMPLE_WORD = re.compile(f"[{SIMPLE}]*"), re.compile(f"[0-9]+|[{UPPER}]+(?![{LOWER}])|[{UPPER}]?[{LOWER}]+")


def _simple_terms(text: str | None, stop=frozenset(STOPWORDS)) -> list[str] | None:
    """terms() of a text of simple characters; of others None."""
    if text is None:
        return []
    if not text.isascii() and not SIMPLE_TEXT.fullmatch(text):
        return None
    words = (w.lower() for w in SIMPLE_WORD.findall(text))
    return [w for w in words if w not in stop and (len(w) > 1 or w in "0123456789")]


@F.pandas_udf(ArrayType(StringType()))
def _terms(texts: pd.Series) -> pd.Series:
    return texts.map(_simple_terms, na_action=None)


@F.pandas_udf(ArrayType(StringType()))
def _term_set(texts: pd.Series) -> pd.Series:
    """The sorted set of terms, capitalized."""
    found = texts.map(_simple_terms, na_action=None)
    return found.map(lambda ws: None if ws is None else sorted({w[:1].upper() + w[1:] for w in ws}))


def terms_of(text: Column) -> Column:
    """terms() of a column of texts by whole Arrow batches, a tenth of the time; texts of other than simple characters as before."""
    return F.coalesce(_terms(text), terms(text))


def term_set_of(text: Column) -> Column:
    """The sorted set of a text's terms, capitalized."""
    return F.coalesce(_term_set(text), F.array_sort(F.array_distinct(F.transform(terms(text), capitalize))))


def stem(word: Column) -> Column:
    """A light stem: the first suffix rule that fits, then a final e of what is longer than four letters."""
    w = F.lower(word)
    out = None
    for suffix, new, least in SUFFIXES:
        fits = w.endswith(suffix) & (F.length(w) - len(suffix) + len(new) >= least)
        if suffix == "es":
            fits = fits & w.rlike(SIBILANT)
        if suffix == "s":
            fits = fits & ~w.rlike(PLAIN_S)
        value = F.concat(F.substr(w, F.lit(1), F.length(w) - len(suffix)), F.lit(new))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    base = out.otherwise(w)
    short = F.when((F.length(base) > 4) & base.endswith("e"), F.substr(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    keep = (F.octet_length(w) <= 3) | (F.octet_length(w) > F.length(w)) | w.isin(STEM_EXCEPTIONS)
    return F.when(keep, w).otherwise(short)


def trigrams(word: Column) -> Column:
    """The set of three-character windows of #word#."""
    p = F.concat(F.lit("#"), word, F.lit("#"))
    return F.when(F.length(p) < 3, F.array(p)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(text: Column) -> Column:
    """Trimmed sentences that hold a letter or digit."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "([。！？]|[.!?\\n](?:\\s|$))", "$1\x01")
    trimmed = F.transform(F.split(marked, "\x01"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s.rlike(r"[\p{IsAlphabetic}\p{N}]"))


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def _fnv_of(texts: pd.Series) -> pd.Series:
    """All texts at once, byte place by byte place, the longest first: at each place those that still have a byte are a beginning."""
    raw = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.uint32)
    n = size[order]
    starts = np.cumsum(n) - n
    h = np.full(len(raw), FNV_START, np.uint32)
    for at in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -at, side="left"))
        if k < 4:  # few long texts are left: plain numbers are faster
            for i in range(k):
                v = int(h[i])
                for x in data[starts[i] + at : starts[i] + n[i]].tolist():
                    v = ((v ^ x) * FNV_PRIME) & 0xFFFFFFFF
                h[i] = v
            break
        h[:k] = (h[:k] ^ data[starts[:k] + at]) * np.uint32(FNV_PRIME)
    out = np.empty(len(raw), object)
    for i, v in zip(order.tolist(), h.tolist()):
        out[i] = None if texts.iloc[i] is None else f"{v:08x}"
    return pd.Series(out)


@F.pandas_udf(StringType())
def _fnv32(texts: pd.Series) -> pd.Series:
    return _fnv_of(texts)


def fnv32(text: Column) -> Column:
    """The low 32 bits of the 64-bit FNV-1a hash as eight hex digits, by whole Arrow batches: a fold over bytes as a
    lambda costs some hundred times as much."""
    return _fnv32(text)


# Code point ranges of the scripts that are told apart.
SCRIPTS = {
    "latin": "A-Za-z\\u00C0-\\u024F\\u1E00-\\u1EFF\\u2C60-\\u2C7F\\uA720-\\uA7FF\\uFF21-\\uFF3A\\uFF41-\\uFF5A",
    "greek": "\\u0370-\\u03FF\\u1F00-\\u1FFF",
    "cyrillic": "\\u0400-\\u052F\\u2DE0-\\u2DFF\\uA640-\\uA69F",
    "armenian": "\\u0530-\\u058F",
    "hebrew": "\\u0590-\\u05FF",
    "arabic": "\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF",
    "indic": "\\u0900-\\u0DFF\\uA8E0-\\uA8FF",
    "thai": "\\u0E00-\\u0E7F",
    "lao": "\\u0E80-\\u0EFF",
    "tibetan": "\\u0F00-\\u0FFF",
    "myanmar": "\\u1000-\\u109F",
    "georgian": "\\u10A0-\\u10FF",
    "ethiopic": "\\u1200-\\u137F",
    "khmer": "\\u1780-\\u17FF",
    "hangul": "\\u1100-\\u11FF\\u3130-\\u318F\\uAC00-\\uD7AF",
    "kana": "\\u3040-\\u30FF\\u31F0-\\u31FF",
    "han": "\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF",
}


def script_profile(text: Column) -> Column:
    """letters, non_latin_fraction (four places) and script: the commonest other script where it reaches a fifth, else latin.

    Letters are taken out once and Latin ones from them once more, so that each script is counted in what is left; the
    two strings are bound by outer lambdas: otherwise they would be made again for each use.
    """
    every = "".join(SCRIPTS.values())

    def of(letters: Column, other: Column) -> Column:
        count = lambda keep: F.length(F.regexp_replace(other, f"[^{keep}]+", ""))
        rest = [(n, count(c)) for n, c in SCRIPTS.items() if n != "latin"] + [("other", F.length(F.regexp_replace(other, f"[{every}]+", "")))]
        top = F.greatest(*[F.struct(c.alias("n"), F.lit(-i).alias("i"), F.lit(n).alias("script")) for i, (n, c) in enumerate(rest)])["script"]
        share = F.when(letters == 0, F.lit(0.0)).otherwise(1 - (letters - F.length(other)) / letters)
        return F.struct(letters.alias("letters"), F.round(share, 4).alias("non_latin_fraction"), F.when(share >= 0.2, top).otherwise(F.lit("latin")).alias("script"))

    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^A-Za-z{every}\\p{{IsAlphabetic}}]+", "")
    return bound(letters, lambda l: bound(F.regexp_replace(l, f"[A-Za-z{SCRIPTS['latin']}]+", ""), lambda o: of(F.length(l), o)))


def unreadable_for_english(text: Column) -> Column:
    return script_profile(text)["non_latin_fraction"] >= 0.2


def clean_id(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^[\[\]`]+|[\[\]`]+$", ""))


def list_items(text: Column) -> Column:
    """Items between , ; or |, without brackets and quotes around them, spaces as underscores; an item needs a letter or digit."""
    clean = lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[{}\[\]()`'\"]+|[{}\[\]()`'\"]+$", ""))
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;|]"), clean), lambda s: s.rlike(r"[\p{IsAlphabetic}\p{N}]"))
    return F.transform(items, lambda s: F.replace(s, F.lit(" "), F.lit("_")))


def normalized_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)", " "), r"\s+", " "))


def option_text(title: Column, abstract: Column, words: int) -> Column:
    """title: first words of abstract."""
    return F.concat(title, F.lit(": "), F.array_join(F.slice(F.split(F.trim(abstract), r"\s+"), 1, words), " "))


def typo(word: Column) -> Column:
    """The word without one inner character (the one in its middle) where it has at least five letters."""
    at = F.floor(F.length(word) / 2).cast("int") + 1
    return F.when(F.length(word) >= 5, F.concat(F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1))).otherwise(word)


def keywords(text: Column, n: int) -> Column:
    """The n longest distinct content words, longer first, then by spelling."""
    keyed = F.transform(F.array_distinct(terms(text)), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["w"])


def loader_terms(text: Column) -> Column:
    """The loader's own tokens: runs of ASCII letters and digits, longer than two, outside a small list; a sorted set."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(LOADER_STOPWORDS))))

# what runs on executors travels with the plan, so they need not hold this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
