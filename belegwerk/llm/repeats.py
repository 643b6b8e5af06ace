"""Exact removal of repeated strings across documents, by collection suffix order.

A byte goes when a string of ``WIDTH`` bytes that covers it also starts in a document
with a smaller id; strings are judged on the input, and never cross documents.

1. Every text is cut into fragments of windows with one anchor (see ``anchors``).
   Anchors that only one text has (copies of it aside) cannot hold a repeat; those
   of several texts are marked in a bitmap of bounded size. A mark by chance only
   costs time.
2. Fragments with a marked anchor are dealt to cells by their anchor, equal ones of a
   batch once, so every repeat meets in one cell. In a cell the suffixes of all
   fragments, as far as another one has the bytes next to their anchor, are sorted by
   column-wise construction of the collection's transform; neighbours with a common prefix
   of ``WIDTH`` are the same string.
3. The spans found are merged for each document and cut from its text.

An exact copy of a text with a smaller id goes as a whole, if it is long enough to
hold a string at all.

Defined results: a null text is empty; texts below ``WIDTH`` bytes stay whole; rows
without an id stay whole and remove nothing; rows with one id are one document: they
never remove from each other, and each loses the places that any of them loses; an
empty table gives an empty one. Ids are integers.
Only the named columns are read; others stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.llm.anchors import GRAM, PLACE_BITS, WIDTH, fragments
from belegwerk.llm.arrow_text import flat, slices, spread
from belegwerk.llm.collection_bwt import common_prefix_groups, suffix_order
from belegwerk.llm.hashing import RunHash
from belegwerk.llm.labelled import fresh
from belegwerk.session import large_batches, materialise

SEVERAL = (1 << 40) - 1  # in place of a text's hash: more than one text
CELL_TEXTS = 30_000  # fragments that one suffix order holds
PIECE = 1 << (PLACE_BITS - 1)
COPY_PARTS = 16  # parts of the copies of one text
SENT = 4 << 20  # bytes of cells that leave a task together
SLICE = 1 << 20  # bytes hashed at once: every byte costs about a hundred of arrays


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices as bytes, offsets, row and start of each piece.

    A text longer than ``PIECE`` bytes is walked in pieces that overlap by a window
    less one byte, so every window is whole in one piece.
    """
    for lo, hi, body, at in slices(texts, SLICE):
        if len(body) <= PIECE:
            yield body, at, np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            continue
        for begin in range(0, len(body) - WIDTH + 1, PIECE - WIDTH + 1):
            part = body[begin:begin + PIECE]
            yield part, np.array([0, len(part)]), np.array([lo]), np.array([begin])


def packed(values: np.ndarray) -> bytes:
    """The low 40 bits of each number."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def cell_bits(total: int, each: int) -> int:
    """Cells, as a power of two, that hold about ``each`` of ``total`` bytes."""
    return min(30, max(4, int(-(-total // each)).bit_length()))


def shared_anchors(docs: DataFrame, total: int) -> tuple[bytes, int]:
    """Bitmap over the first bits of anchor hashes that more than one text has.

    The bitmap grows with the input up to 64 MB; beyond that more marks fall together.
    """
    bits = min(29, max(16, int(total // 4).bit_length()))
    cells = min(cell_bits(total, 16 << 20), bits - 4)
    rest = bits - cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            body, at = flat(batch.column(0))
            edge = at.tolist()
            own = [int.from_bytes(hashlib.md5(body[a:b]).digest()[:5], "little") for a, b in zip(edge, edge[1:])]
            own = np.minimum(np.array(own, np.uint64), np.uint64(SEVERAL - 1))
            for part, part_at, rows, _ in pieces(batch.column(0)):
                _, _, code, row = fragments(part, part_at)
                codes.append(code)
                owners.append(own[rows[row]])
            code, owner = np.concatenate(codes), np.concatenate(owners)
            if not len(code):
                continue
            order = np.argsort(code)
            code, owner = code[order], owner[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
            code, owner = code[first], np.where(low == high, low, np.uint64(SEVERAL))
            cell = (code >> np.uint64(64 - cells)).astype(np.int64)
            cut = np.searchsorted(cell, np.arange((1 << cells) + 1))
            tail = (code << np.uint64(cells)) >> np.uint64(24)
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()),
                pa.array([packed(tail[cut[c]:cut[c + 1]]) for c in full], pa.binary()),
                pa.array([packed(owner[cut[c]:cut[c + 1]]) for c in full], pa.binary()),
            ], ["cell", "codes", "owners"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, table in by_cell(batches):
            code = np.concatenate([unpacked(b) for b in table.column("codes").to_pylist()])
            owner = np.concatenate([unpacked(b) for b in table.column("owners").to_pylist()])
            order = np.argsort(code)
            code, owner = code[order], owner[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
            hit = code[first][(low != high) | (high == SEVERAL)]
            marks = np.zeros(1 << rest, bool)
            marks[(hit >> np.uint64(40 - rest)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["cell", "marks"])

    dealt = docs.select("text").mapInArrow(run, "cell int, codes binary, owners binary")
    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(mark, "cell int, marks binary").toArrow()
    out = np.zeros((1 << cells, 1 << rest >> 3), np.uint8)
    for cell, marks in zip(found.column("cell").to_pylist(), found.column("marks").to_pylist()):
        out[cell] = np.frombuffer(marks, np.uint8)
    return out.tobytes(), bits


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole cells of rows that arrive sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column(0).to_numpy()
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
        for a, b in zip(start, np.append(start, len(cell))[1:]):
            if held and held[0].column(0)[0].as_py() != int(cell[a]):
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


FRAGMENTS = ("cell int, texts binary, sizes binary, text binary, doc binary, start binary, "
             "begin binary, end binary")


def deal_fragments(docs: DataFrame, marks, bits: int, cells: int) -> DataFrame:
    """Fragments with marked anchors, by cell.

    Equal fragments of a batch are sent once, with the places they have in the
    document of the smallest id; in the others they are repeats already, and those
    spans travel with the cell (``doc`` beyond the places, ``begin`` and ``end``).
    Fragments take several times the bytes of their texts, so they are cut from the batch
    only as their cells are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            whole, edge = flat(batch.column(1))
            parts = []
            for body, at, rows, begin in pieces(batch.column(1)):
                first, end, code, row = fragments(body, at)
                spot = (code >> np.uint64(64 - bits)).astype(np.int64)
                keep = ((marked[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool) & known[rows[row]]
                first, end, code, row = first[keep], end[keep], code[keep], row[keep]
                size = end - first + WIDTH - 1
                parts.append((code, RunHash(body).of(first, first + size), rows[row], first - at[row] + begin[row], size))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            code, same, own, start, size = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            order = np.lexsort((start, ids[own], same, code))
            code, same, own, start, size = (v[order] for v in (code, same, own, start, size))
            doc, text_at = ids[own], edge[own] + start
            new = np.ones(len(code), bool)
            new[1:] = (same[1:] != same[:-1]) | (code[1:] != code[:-1])
            del order, own, same
            group = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            least = doc == doc[head][group]
            cell = (code >> np.uint64(64 - cells)).astype(np.int64)
            kinds = [pa.int32(), *[pa.binary()] * 7]
            names = ["cell", "texts", "sizes", "text", "doc", "start", "begin", "end"]
            out, held, full = [], 0, np.unique(cell).tolist()
            for c in full:
                a, b = np.searchsorted(cell, [c, c + 1])
                h = head[np.searchsorted(head, a):np.searchsorted(head, b)]
                mine = np.arange(a, b)[least[a:b]]
                rest = np.arange(a, b)[~least[a:b]]
                out.append((
                    c, whole[spread(text_at[h], size[h])].tobytes(), size[h].astype(np.int32).tobytes(),
                    (group[mine] - group[a]).astype(np.int32).tobytes(),
                    np.append(doc[mine], doc[rest]).astype(np.int64).tobytes(), start[mine].astype(np.int64).tobytes(),
                    start[rest].astype(np.int64).tobytes(), (start[rest] + size[rest]).astype(np.int64).tobytes(),
                ))
                held += sum(map(len, out[-1][1:]))
                if len(out) == 256 or held > SENT or c == full[-1]:
                    lot = [pa.array(v, k) for v, k in zip(zip(*out), kinds)]
                    out, held = [], 0
                    yield pa.RecordBatch.from_arrays(lot, names)

    return docs.select("doc_id", "text").mapInArrow(run, FRAGMENTS)


def equal_windows(texts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragment, offset and group of every window, from the suffix order of the fragments."""
    owner, length = suffix_order(texts, at)
    long, new = common_prefix_groups(texts, at, owner, length, WIDTH)
    owner, length = owner[long], length[long]
    return owner, np.diff(at)[owner] - length, np.cumsum(new) - 1


def orders(key: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Items in lots of at most ``most``, those of one key in one lot.

    A key of more items is a lot by itself.
    """
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    ends = np.append(first, len(order))[1:]
    lo = 0
    while lo < len(order):
        fit = int(np.searchsorted(ends, lo + most, "right"))
        hi = int(ends[fit - 1]) if fit and ends[fit - 1] > lo else int(ends[fit])
        yield order[lo:hi]
        lo = hi


def shared_stretches(texts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragment, first window, windows and key of stretches that may share a window with another.

    A window holds its anchor and besides it ``WIDTH - GRAM`` bytes, so the half of them that
    follow it or the half before it. So windows of two fragments can only be equal
    where both have the same bytes from the anchor on, or both up to its end; those
    bytes are the key. Windows of equal keys lie at the same side of their anchor.
    """
    half = (WIDTH - GRAM) // 2
    run = RunHash(texts)
    code = run.every(GRAM) & ~np.uint64((1 << PLACE_BITS) - 1)
    place = np.arange(len(code))
    owner = np.searchsorted(at, place, "right") - 1
    code[place + GRAM > at[owner + 1]] = np.iinfo(np.uint64).max  # runs into the next fragment
    least = np.flatnonzero(code == np.minimum.reduceat(code, at[:-1])[owner])
    anchor = least[np.append(True, owner[least][1:] != owner[least][:-1])]  # the leftmost, as for windows
    windows = np.diff(at) - WIDTH + 1
    first = np.clip(anchor - at[:-1] - half, 0, windows)  # windows from here on hold the bytes after the anchor
    out = []
    for side, (begin, end) in enumerate(((first, windows), (np.zeros_like(first), first))):
        own = np.flatnonzero(begin < end)
        spot = anchor[own] - (half if side else 0)
        key = run.of(spot, spot + GRAM + half) ^ np.uint64(side)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[which] > 1
        out.append((own[keep], begin[own[keep]], (end - begin)[own[keep]], key[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def window_owners(texts: np.ndarray, at: np.ndarray, doc: np.ndarray, most: int = CELL_TEXTS) -> np.ndarray:
    """Smallest document of each window's string, windows of all (different) fragments in order.

    The stretches that may share windows are worked on in suffix orders of at most
    ``most``. Only those of one key that alone has more are cut into windows, which
    are dealt to orders by their content.
    """
    windows = np.diff(at) - WIDTH + 1
    base = np.cumsum(windows) - windows
    out = np.repeat(doc, windows)
    if not len(windows):
        return out

    def settle(spots: np.ndarray, group: np.ndarray) -> None:
        if len(group):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(out[spots], first)
            out[spots] = np.repeat(least, np.diff(np.append(first, len(spots))))

    owner, begin, count, key = shared_stretches(texts, at)
    start, spot = at[owner] + begin, base[owner] + begin
    for lot in orders(key, most):
        if len(lot) <= most:
            size = count[lot] + WIDTH - 1
            own, offset, group = equal_windows(texts[spread(start[lot], size)], np.append(0, np.cumsum(size)))
            settle(spot[lot[own]] + offset, group)
            continue
        spots, begins = spread(spot[lot], count[lot]), spread(start[lot], count[lot])
        parts = -(-len(spots) // most)
        part = (RunHash(texts).of(begins, begins + WIDTH) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        for k in range(parts):
            mine = np.flatnonzero(part == k)
            each = np.full(len(mine), WIDTH)
            own, _, group = equal_windows(texts[spread(begins[mine], each)], np.arange(len(mine) + 1) * WIDTH)
            settle(spots[mine[own]], group)
    return out


def cell_spans(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, begin and end of every span of repeats that a cell shows."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names if c != "cell"}
    number: dict[bytes, int] = {}
    texts, text, doc, start, done = [], [], [], [], []
    for k in range(table.num_rows):
        sizes = np.frombuffer(columns["sizes"][k], np.int32)
        ends = np.cumsum(sizes)
        blob, own = columns["texts"][k], []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            t = blob[a:b]
            n = number.get(t)
            if n is None:
                n = number[t] = len(texts)
                texts.append(t)
            own.append(n)
        places = np.frombuffer(columns["text"][k], np.int32)
        docs = np.frombuffer(columns["doc"][k], np.int64)
        text.append(np.array(own, np.int64)[places])
        doc.append(docs[:len(places)])
        start.append(np.frombuffer(columns["start"][k], np.int64))
        done.append((docs[len(places):], np.frombuffer(columns["begin"][k], np.int64), np.frombuffer(columns["end"][k], np.int64)))
    text, doc, start = np.concatenate(text), np.concatenate(doc), np.concatenate(start)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, text, doc)
    owners = window_owners(np.frombuffer(b"".join(texts), np.uint8), at, least)
    windows = np.diff(at) - WIDTH + 1
    base = np.cumsum(windows) - windows
    # Runs of repeated windows of every place a fragment has.
    each = windows[text]
    index = spread(base[text], each)
    place = np.repeat(np.arange(len(text)), each)
    hit = owners[index] < doc[place]
    offset = np.arange(len(index)) - np.repeat(np.cumsum(each) - each, each)
    place, offset = place[hit], offset[hit]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(place))[1:] - 1
    spans = (
        doc[place[first]], start[place[first]] + offset[first], start[place[first]] + offset[last] + WIDTH,
    )
    return tuple(np.concatenate([s, *(d[k] for d in done)]) for k, s in enumerate(spans))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: sorted, disjoint byte spans to remove, as int64 pairs.

    Documents that are whole copies of another are not all listed; see ``drop_repeats``.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    with large_batches(spark):  # what a batch has twice is sent once
        marks, bits = shared_anchors(docs, total)
    cells = cell_bits(total, 3 << 19)
    dealt = deal_fragments(docs, spark.sparkContext.broadcast(marks), bits, cells)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_cell(batches):
            doc, begin, end = cell_spans(table)
            if not len(doc):
                continue
            order = np.lexsort((begin, doc))
            doc, pairs = doc[order], np.stack([begin, end], 1)[order].astype("<i8")
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            ends = np.append(first, len(doc))[1:]
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[first]), pa.array([pairs[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
            ], ["doc_id", "spans"])

    found = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(search, "doc_id long, spans binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, table in by_cell(batches):
            pairs = np.frombuffer(b"".join(table.column("spans").to_pylist()), "<i8").reshape(-1, 2)
            spans = union_of(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([spans.tobytes()], pa.binary())], ["doc_id", "spans"])

    merged = found.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(merge, "doc_id long, spans binary")
    with large_batches(spark):
        return materialise(merged)


def union_of(pairs: np.ndarray) -> np.ndarray:
    """Disjoint spans, sorted, that cover the same bytes; touching ones become one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    last = np.append(new, len(pairs))[1:] - 1
    return np.stack([pairs[new, 0], reach[last]], 1).astype("<i8")


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def removed(raw: bytes, spans: bytes | None, copies: list[str] | None) -> list[list[int]]:
    """Maximal removed runs of a text."""
    if copies and hashlib.md5(raw).hexdigest() in copies:
        return [[0, len(raw)]]
    pairs = np.minimum(np.frombuffer(spans, "<i8").reshape(-1, 2), len(raw)) if spans else np.zeros((0, 2), np.int64)
    return pairs[pairs[:, 0] < pairs[:, 1]].tolist()


def kept_bytes(raw: bytes, gone: list[list[int]]) -> bytes:
    edges = [0, *(e for pair in gone for e in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_cuts(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: spans to cut, and hashes of texts that go whole."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(texts)
    named = texts.filter("doc_id is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.octet_length("text").alias("n"))
    firsts = named.filter(F.col("n") >= WIDTH).groupBy("h", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    # A text may have very many copies: they meet its first id in parts.
    firsts = firsts.filter("rows > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))))
    named = named.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_PARTS)).cast("int"))
    copies = named.join(firsts, ["h", "n", "part"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_set("h").alias("whole"))
    names = [fresh(docs, c) for c in ("cut_id", "cut_spans", "cut_whole")]
    cuts = spans.join(copies, "doc_id", "full").toDF(*names)
    return docs.join(cuts, F.col("doc_id").cast("long") == F.col(names[0]), "left").drop(names[0]), names[1], names[2]


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)`` of every document.

    ``spans`` are the maximal removed runs of bytes, ``kept`` the remaining bytes
    (a cut may fall inside a character).
    """
    found, spans, whole = with_cuts(docs.select("doc_id", "text"))

    def cut(texts: pa.Array, spans: pa.Array, whole: pa.Array) -> pa.Array:
        out = []
        for text, blob, copied in zip(texts.to_pylist(), spans.to_pylist(), whole.to_pylist()):
            raw = (text or "").encode()
            gone = removed(raw, blob, copied)
            kept = kept_bytes(raw, gone)
            out.append((len(raw), len(raw) - len(kept), [{"begin": a, "end": b} for a, b in gone], kept))
        columns = zip(*out) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), SPANS, pa.binary())
        return pa.StructArray.from_arrays(
            [pa.array(list(v), k) for v, k in zip(columns, kinds)], ["n_bytes", "n_removed", "spans", "kept"]
        )

    made = F.arrow_udf(cut, "struct<n_bytes:long,n_removed:long,spans:array<struct<begin:long,end:long>>,kept:binary>")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), made.asNondeterministic()("text", spans, whole).alias("cut")).select("doc_id", "cut.*")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text; ``n_chars`` counts it, where there is one.

    Bytes of a character that a cut has split go with the rest of it.
    """
    found, spans, whole = with_cuts(docs)

    def cut(texts: pa.Array, spans: pa.Array, whole: pa.Array) -> pa.Array:
        out = []
        for text, blob, copied in zip(texts.to_pylist(), spans.to_pylist(), whole.to_pylist()):
            raw = (text or "").encode()
            out.append(kept_bytes(raw, removed(raw, blob, copied)).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    made = F.arrow_udf(cut, "string").asNondeterministic()
    out = found.withColumn("text", made("text", spans, whole)).drop(spans, whole)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
