"""Code points: letters, lower case and scripts, as tables that arrays index."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np

POINTS = 0x110000

# Blocks of the larger scripts in the Unicode code charts, first and last
# code point. Letters outside them are of the script "other".
RANGES = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF),
    ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF), ("cyrillic", 0xA640, 0xA69F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0x08A0, 0x08FF), ("arabic", 0xFB50, 0xFDFF),
    ("arabic", 0xFE70, 0xFEFF),
    ("syriac", 0x0700, 0x074F), ("thaana", 0x0780, 0x07BF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF),
    ("canadian", 0x1400, 0x167F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7FF),
    ("hiragana", 0x3040, 0x309F), ("katakana", 0x30A0, 0x30FF), ("katakana", 0x31F0, 0x31FF), ("katakana", 0xFF66, 0xFF9F),
    ("bopomofo", 0x3100, 0x312F),
    ("han", 0x2E80, 0x2FDF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
)
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in RANGES))
# Written without blanks: every character counts as a word.
UNSPACED = ("han", "hiragana", "katakana", "bopomofo", "thai", "lao", "tibetan", "myanmar", "khmer")


@dataclass(frozen=True)
class Tables:
    letter: np.ndarray  # letters
    mark: np.ndarray
    lower: np.ndarray
    script: np.ndarray
    unspaced: np.ndarray  # by script


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    """Made once for each process, about 8 MB."""
    kind = "".join(unicodedata.category(chr(c))[0] for c in range(POINTS)).encode()
    kind = np.frombuffer(kind, np.uint8)
    letter = kind == ord("L")
    lower = np.arange(POINTS, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    script = np.zeros(POINTS, np.uint8)
    for name, first, last in RANGES:
        script[first:last + 1] = SCRIPTS.index(name)
    return Tables(letter, kind == ord("M"), lower, script, np.isin(SCRIPTS, UNSPACED))


@dataclass(frozen=True)
class Words:
    """Words of neighbouring texts: runs of letters of one script, with their marks."""

    points: np.ndarray  # lower-cased code points of all texts
    at: np.ndarray  # where each text begins in them
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def words_of(body: np.ndarray, at: np.ndarray) -> Words:
    """Cut a slice of UTF-8 texts into words; a word of a script without blanks is one character."""
    t = tables()
    points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=begins[1:])
    at = begins[at]
    n = len(points)
    letter, mark = t.letter[points], t.mark[points]
    # Marks go on with the letter before them; none begins a word.
    spot = np.arange(n)
    base = np.maximum.accumulate(np.where(mark, -1, spot))
    inside = letter | mark & (base >= np.repeat(at[:-1], np.diff(at))) & letter[np.maximum(base, 0)]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    script = t.script[points[np.maximum(base, 0)]]  # a mark has the script of its letter
    new = np.ones(n, bool)
    new[1:] = ~inside[:-1] | (script[1:] != script[:-1]) | t.unspaced[script[1:]]
    starts = np.flatnonzero(letter & (new | edge[:-1]))
    stops = np.ones(n + 1, bool)
    stops[:n] = ~inside
    stops[starts] = True
    stops[at] = True
    stop = np.flatnonzero(stops)
    ends = stop[np.searchsorted(stop, starts, "right")]
    count = np.zeros(n + 1, np.int64)
    np.cumsum(letter, out=count[1:])
    letters = count[ends] - count[starts]
    return Words(t.lower[points], at, starts, ends, np.searchsorted(at, starts, "right") - 1, script[starts], letters)
