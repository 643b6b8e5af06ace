"""Fill-in-the-middle: texts reordered around a middle part that begins and ends between units.

A wavelet matrix over classes of bytes (line feed, other blank, word, rest of a
character; each with what follows it) answers all questions about a text: ranks of the
classes that end a unit add up to the number of units, bisection on those ranks finds
the byte of either cut, and ranks of the classes that continue a character turn bytes
into code points. A slice of texts shares one matrix.

Units are words with the blanks before them (blanks at the end are one more unit), or
lines. Forms: ``psm`` is prefix, suffix, middle behind their markers; ``spm`` is suffix,
prefix, middle; ``plain`` is the text. Draws are read off the SHA-256 of seed and id, so
repeated runs and repeated rows agree.

Defined results: a null text is empty; an empty text, one that holds a marker and a row
without an id stay plain; repeated rows are each cut, alike where the id and text are;
an empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.arrow_text import BLANKS, slices
from belegwerk.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

# Own class in the two upper bits, class of the next byte in the lower ones.
FEED, BLANK, WORD, REST = range(4)
NEXT_BLANK, NEXT_WORD, NEXT_NONE = range(3)
OWN = np.where(BLANKS, BLANK, WORD).astype(np.uint8)
OWN[0x0A] = FEED
OWN[0x80:0xC0] = REST
CLASS_BITS = 4


def classes(own: tuple[int, ...], following: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(a << 2 | b for a in own for b in following)


ANY = (NEXT_BLANK, NEXT_WORD, NEXT_NONE)
ENDS = {
    "tokens": classes((WORD, REST), (NEXT_BLANK, NEXT_NONE)) + classes((FEED, BLANK), (NEXT_NONE,)),
    "lines": classes((FEED,), ANY) + classes((BLANK, WORD, REST), (NEXT_NONE,)),
}
CONTINUES = classes((REST,), ANY)


def byte_classes(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of every byte of neighbouring texts."""
    own = OWN[body]
    following = np.full(len(body), NEXT_NONE, np.uint8)
    following[:-1] = np.where(own[1:] >= WORD, NEXT_WORD, NEXT_BLANK)
    following[at[1:][at[1:] > at[:-1]] - 1] = NEXT_NONE
    return own << np.uint8(2) | following


@dataclass(frozen=True)
class Cuts:
    """Of each text: units, bytes of prefix and middle, and their code points."""

    units: np.ndarray
    first: np.ndarray
    second: np.ndarray
    first_points: np.ndarray
    second_points: np.ndarray


def locate(body: np.ndarray, at: np.ndarray, draws: np.ndarray, unit: str = "tokens") -> Cuts:
    """Both cuts of every text: the two draws modulo units plus one, the smaller first.

    Cuts are bytes and code points from the start of the text.
    """
    matrix = WaveletMatrix(byte_classes(body, at), CLASS_BITS)
    begin, end = at[:-1], at[1:]
    before = matrix.count(ENDS[unit], at)
    units = np.diff(before)
    wanted = np.sort(draws[:, :2] % (units + 1)[:, None].astype(np.uint64), 1).astype(np.int64)
    places = [matrix.after(ENDS[unit], wanted[:, k], begin, end) for k in (0, 1)]
    rest = [matrix.count(CONTINUES, p) for p in (begin, *places)]
    points = [p - begin - (r - rest[0]) for p, r in zip(places, rest[1:])]
    return Cuts(units, places[0] - begin, places[1] - begin, *points)


def draws_of(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id, from the SHA-256 of ``seed:id``."""
    raw = b"".join(hashlib.sha256(f"{seed}:{0 if k is None else k}".encode()).digest()[:16] for k in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.uint64)


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, unit: str = "tokens", share: int = 50, suffix_first: int = 80,
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every whole text.

    ``share`` percent of the texts are reordered, ``suffix_first`` percent of those as
    ``spm``. The character counts are null for plain texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, at in slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                keys = ids.to_pylist()
                draws = draws_of(keys, seed)
                cuts = locate(body, at, draws, unit)
                reorder, spm = draws[:, 2] % 100 < share, draws[:, 3] % 100 < suffix_first
                forms, outputs = [], []
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    raw = body[a:b].tobytes()
                    if not raw or keys[k] is None or not reorder[k] or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
                        forms.append("plain")
                        outputs.append(raw)
                        continue
                    p, m = int(cuts.first[k]), int(cuts.second[k])
                    prefix, middle, suffix = raw[:p], raw[p:m], raw[m:]
                    forms.append("spm" if spm[k] else "psm")
                    outputs.append(b"".join(
                        (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm[k]
                        else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
                    ))
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(cuts.units), pa.array(forms, pa.string()),
                    pa.array(cuts.first_points, mask=plain), pa.array(cuts.second_points - cuts.first_points, mask=plain),
                    pa.array(outputs, pa.binary()).view(pa.string()),
                ], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that an output was made of, read off the output and its form."""
    marker = "|".join(re.escape(m.decode()) for m in (PREFIX, SUFFIX, MIDDLE))
    part = F.split(output, marker, -1)
    return (
        F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(F.col(output))
    )
