"""Tokens and search terms as column expressions; German lexemes."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.fixed_values import TERM_EDGE_CHARS
from belegwerk.functions.stop_words import GERMAN

# Unicode white space, plus the four ASCII separators that count as blanks too.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def german_stop_words() -> tuple[str, ...]:
    """The German stop list, the same with and without a session."""
    return GERMAN


def sql_words(words: tuple[str, ...]) -> str:
    """Words as a SQL list. One parsed text is far cheaper than a literal each."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def trim_blanks(text: Column) -> Column:
    """Strip every kind of white space; ``trim`` alone strips only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


@functools.lru_cache(maxsize=8)
def _literals_of(words: tuple[str, ...], context: SparkContext) -> list[Column]:
    return [F.lit(w) for w in words]


def _literals(words: tuple[str, ...]) -> list[Column]:
    """Words as columns, made once: they outnumber all other calls to the JVM."""
    return _literals_of(words, SparkContext._active_spark_context)


def search_terms(question: Column, stop_words: tuple[str, ...] | None = None) -> Column:
    """Lower-cased words without edge punctuation, stop words and single letters.

    Duplicates stay. A question that has nothing left becomes one term: itself.
    """
    stop = german_stop_words() if stop_words is None else stop_words
    words = F.transform(
        F.array_remove(F.split(F.lower(question), BLANKS), ""),
        lambda w: F.btrim(w, F.lit(TERM_EDGE_CHARS)),
    )
    known = _literals(stop)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*known))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lower(question)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


VOWELS = "aeiouyäöü"
_REGION = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
_HIDDEN = re.compile(f"([{VOWELS}])([uy])([{VOWELS}])")
# Endings by the last letter, the longest first.
_STEP_1 = {"n": ("ern", "en"), "m": ("em",), "r": ("er",), "s": ("es", "s"), "e": ("e",)}
_STEP_2 = {"t": ("est", "st"), "n": ("en",), "r": ("er",)}
_STEP_3 = {"h": ("isch", "lich"), "t": ("heit", "keit"), "d": ("end",), "g": ("ung", "ig"), "k": ("ik",)}
_S_AFTER, _ST_AFTER = frozenset("bdfghklmnrt"), frozenset("bdfghklmnt")
_BEFORE = {
    "end": re.compile("(?<!e)ig$"), "ung": re.compile("(?<!e)ig$"),
    "lich": re.compile("(er|en)$"), "heit": re.compile("(er|en)$"), "keit": re.compile("(lich|ig)$"),
}
_PLAIN = str.maketrans("UYäöü", "uyaou")


def _ending(word: str, step: dict[str, tuple[str, ...]]) -> str:
    for ending in step.get(word[-1:], ()):
        if word.endswith(ending):
            return ending
    return ""


def german_stem(word: str) -> str:
    """Stem of a lower-case word by the published German Snowball rules."""
    w = word.replace("ß", "ss")
    if "u" in w or "y" in w:
        w = _HIDDEN.sub(lambda m: m[1] + m[2].upper() + m[3], w)
    first = _REGION.match(w) if len(w) >= 3 else None
    second = _REGION.match(w, first.end()) if first else None
    r1 = max(first.end(), 3) if first else len(w)
    r2 = second.end() if second else len(w)

    # The longest ending decides, even where it then may not be cut.
    end = _ending(w, _STEP_1)
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2:-1] in _S_AFTER):
        w = w[:-len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _ending(w, _STEP_2)
    if end and len(w) - len(end) >= r1 and (end != "st" or len(w) >= 6 and w[-3] in _ST_AFTER):
        w = w[:-len(end)]
    end = _ending(w, _STEP_3)
    if end and len(w) - len(end) >= r2:
        base = w[:-len(end)]
        if end not in ("ig", "ik", "isch"):
            w = base
            before = _BEFORE[end].search(base)
            limit = r1 if end in ("lich", "heit") else r2
            if before and before.start() >= limit:
                w = base[:before.start()]
        elif not base.endswith("e"):
            w = base
    return w.translate(_PLAIN)


class Stemmer:
    """Stems the ``lexeme`` column of Arrow batches, each distinct word once.

    Words repeat so much that looking them up in a per-task memory is far
    cheaper than a rule chain per token, and no vocabulary table is joined.
    """

    MEMORY = 1 << 16  # words, some 20 MB; a task forgets them when it has more

    def __init__(self):
        self.known: dict[str, str] = {}

    def stem(self, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        if len(self.known) > self.MEMORY:
            self.known.clear()
        stems = []
        for word in coded.dictionary.to_pylist():
            if word not in self.known:
                self.known[word] = german_stem(word)
            stems.append(self.known[word])
        return pa.array(stems, pa.string()).take(coded.indices)


def stem_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stemmer = Stemmer()
    for batch in batches:
        at = batch.schema.get_field_index("lexeme")
        yield batch.set_column(at, "lexeme", stemmer.stem(batch.column(at)))


def known_config(config: str) -> None:
    if config not in ("german", "stopped", "simple"):
        raise ValueError(f"unknown text configuration: {config}")


def lexemes(
    df: DataFrame, text: str, keep: list[str], config: str = "german",
    stop_words: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per kept token: the ``keep`` columns, ``lexeme`` and ``pos``.

    Positions count every token from 1, so a dropped stop word leaves a gap.
    ``config`` is ``german`` (stop words out, stemmed), ``stopped`` (stop words
    out, not stemmed) or ``simple`` (every token as it is).
    """
    known_config(config)
    out = df.select(*keep, F.posexplode(tokens(F.col(text))).alias("pos", "lexeme"))
    out = out.withColumn("pos", F.col("pos") + 1)
    if config != "simple":
        stop = german_stop_words() if stop_words is None else stop_words
        out = out.filter(f"lexeme not in ({sql_words(stop)})") if stop else out
    out = out.select(*keep, "lexeme", "pos")
    return out.mapInArrow(stem_batches, out.schema) if config == "german" else out


def document_key() -> Column:
    """The document of a parent, as one string that sorts by title and then URL."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\u0001"), F.coalesce("source_url", F.lit("")))
