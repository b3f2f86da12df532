"""Text functions as column expressions: tokens, white space, previews, keywords and hash keys.

They follow Python's Unicode rules for white space and line ends rather than Java's, and count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of text between white space, punctuation and ASCII symbols.
PIECE = r"[^\p{IsWhite_Space}\p{IsPunctuation}$+<=>^\x60\x7C~]+"
IDENTIFIER = r"[A-Za-z0-9_]+"
#: White space at either end, and line ends, as Python sees them.
_EDGES = r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$"
_RIGHT = r"[\p{IsWhite_Space}\x1c-\x1f]+$"
_LINES = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

#: Characters of a preview, and of the head of a text.
PREVIEW, HEAD = 160, 1000
#: Characters that keywords are taken from, and how many are kept.
BRIEF_HEAD, KEYWORDS, BRIEF_KEYWORDS = 4000, 20, 10

#: Words that are no keywords. Fixed values.
STOPWORDS = (
    "the", "and", "for", "are", "with", "this", "that", "from", "have", "will", "should", "must", "need", "user", "users", "data",
    "when", "your", "their", "about", "into", "which", "within", "where", "while", "there", "only", "each", "more", "than", "also",
    "such", "shall", "can", "may", "our", "per", "any", "all", "like", "been", "over", "ensure", "including", "include",
)
STOPWORDS_ZH = ("的", "了", "和", "或", "及", "需要", "支持", "功能", "用户", "系统")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once; an expression that lambdas refer to is worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column) -> Column:
    """Lower-cased pieces that hold a letter or digit, in order."""
    return F.transform(F.filter(matches(text, PIECE), lambda x: x.rlike(r"[\p{L}\p{N}]")), F.lower)


def tokenize(text: Column) -> Column:
    """The pieces, then every identifier of the lower-cased text that is no piece (repeats kept). Null: no tokens."""
    text = F.coalesce(text, F.lit(""))
    both = F.struct(pieces(text).alias("p"), matches(F.lower(text), IDENTIFIER).alias("w"))

    def joined(x: Column) -> Column:
        more = F.array_except(x["w"], x["p"])  # few: identifiers with an underscore
        return let(more, lambda m: F.concat(x["p"], F.when(F.size(m) == 0, m).otherwise(F.filter(x["w"], lambda w: F.array_contains(m, w)))))

    return let(both, joined)


def query_terms(text: Column, most: int = 32) -> Column:
    """The first `most` distinct tokens."""
    return F.slice(F.array_distinct(tokenize(text)), 1, most)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, _RIGHT, "")


def splitlines(text: Column) -> Column:
    parts = F.split(text, _LINES, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def flatten(text: Column) -> Column:
    """Stripped lines joined by one space, blank ones left out; null if nothing is left."""
    lines = F.filter(F.transform(splitlines(text), strip), lambda x: x != "")
    return F.nullif(F.array_join(lines, " "), F.lit(""))


def trim_preview(text: Column, limit: int = PREVIEW) -> Column:
    whole = strip(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(rstrip(F.substring(whole, 1, limit - 1)), F.lit("…")))


def head(text: Column, limit: int = HEAD) -> Column:
    """The first characters, flattened."""
    return flatten(F.substring(text, 1, limit))


def keywords(text: Column, limit: int = KEYWORDS) -> Column:
    """The most frequent words of three letters or more and runs of Chinese characters, as first written.

    Ties go to what occurs first, words before Chinese runs.
    """
    text = F.coalesce(text, F.lit(""))
    latin = F.filter(matches(text, r"[A-Za-z][A-Za-z0-9_-]+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*STOPWORDS))
    chinese = F.filter(matches(text, r"[一-鿿]{2,}"), lambda w: ~w.isin(*STOPWORDS_ZH))

    def ranked(keys: Column) -> Column:
        """(-count, first place) of each key, from runs of equal keys in sorted order."""

        def runs(s: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(s) - 1)
            heads = F.filter(places, lambda i: (i == 0) | (F.get(s, i)["key"] != F.get(s, i - 1)["key"]))
            ends = let(heads, lambda h: F.zip_with(h, F.concat(F.slice(h, 2, F.size(h)), F.array(F.size(s))), lambda a, b: F.struct((a - b).alias("n"), F.get(s, a)["at"].alias("at"))))
            return F.when(F.size(s) > 0, ends)

        return let(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("key"), (i + 1).alias("at")))), runs)

    def best(found: Column) -> Column:
        both = F.struct(found.alias("found"), F.transform(found, F.lower).alias("keys"))
        return let(both, lambda x: F.transform(F.slice(F.array_sort(F.coalesce(ranked(x["keys"]), F.array().cast("array<struct<n:int,at:int>>"))), 1, limit), lambda r: F.element_at(x["found"], r["at"].cast("int"))))

    return let(F.concat(latin, chinese), best)


def embedding_key(text: Column, dimension: int | None = None) -> Column:
    """SHA-1 key of a text's embedding."""
    return F.sha1(F.concat(text, F.lit(f"|dim={dimension}")) if dimension else text)


def query_key(query: Column, model: str) -> Column:
    """SHA-1 key of a query's vector, whatever provider prefix the model's name has."""
    for prefix in ("openai/", "gemini/", "custom/", "local/"):
        model = model.removeprefix(prefix)
    return F.sha1(F.concat(strip(query), F.lit(f"|model={model}")))


def letter_histogram(text: Column) -> Column:
    """How often each letter a to z occurs: the embedding used where no other is given. It needs no model and no network."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(chr(c)), F.lit("")))).cast("float") for c in range(97, 123)])
