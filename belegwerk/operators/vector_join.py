"""Question x chunk similarity join with threshold and top-k per question.

A table of questions within the limits is broadcast, and the chunks stream past it where
they are. A larger one is cut into blocks, in one job. Small chunks are copied: blocks and shards of
chunks meet by a key, with one scan of the chunks. Large ones stay where they are and are read once for
each block, which is broadcast. In every way a task keeps at most ``k`` hits per question.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from belegwerk.functions.vectors import SCORE_DIGITS
from belegwerk.operators.question_block import QuestionBlock, unit_rows
from belegwerk.session import LIMITS, Limits, input_size, materialise, sound_unions, top_k

ROWS_PER_PRODUCT = 1024
QUESTIONS_PER_PRODUCT = 4096
PENDING_HITS = 1 << 18


def hit_schema(qid_type: T.DataType, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("qid", qid_type),
        T.StructField("chunk_id", chunks.schema["id"].dataType),
        T.StructField("parent_id", chunks.schema["parent_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _best(hits: pa.Table, k: int | None, group: str | None = None) -> pa.Table:
    """Keep the ``k`` best hits per question, ties by chunk id.

    With ``group`` the best hit of each group, and the ``k`` best groups, ties by group.
    """
    if k is None or hits.num_rows == 0:
        return hits
    tie = "chunk_id"
    if group is not None:
        tie = group
        hits = hits.sort_by([("q", "ascending"), (group, "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        codes = hits[group].combine_chunks().dictionary_encode().indices.to_numpy()
        q = hits["q"].to_numpy()
        hits = hits.filter(pa.array(np.r_[True, (q[1:] != q[:-1]) | (codes[1:] != codes[:-1])]))
    hits = hits.sort_by([("q", "ascending"), ("score", "descending"), (tie, "ascending")])
    q = hits["q"].to_numpy()
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return hits.filter(pa.array(place < k))


class _Scorer:
    """Matrix products of chunk batches with one set of questions, reduced as they come."""

    def __init__(self, matrix: np.ndarray, qids: pa.Array, threshold: float, k: int | None, probes=None, group: str | None = None):
        self.matrix, self.qids, self.threshold, self.k = matrix, qids, threshold, k
        self.probes, self.group = probes, group
        self.pending: list[pa.Table] = []
        self.size = 0
        # Once a question has ``k`` hits here, a lower score cannot be among its best.
        self.floor = np.full(len(matrix), threshold)

    def _products(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        dim = self.matrix.shape[1]
        for lo in range(0, batch.num_rows, ROWS_PER_PRODUCT):
            part = batch.slice(lo, ROWS_PER_PRODUCT)
            rows, good = unit_rows(part.column("embedding"), dim)
            everyone = np.arange(len(self.matrix))
            if self.probes is None:
                pieces = [(np.arange(len(rows)), everyone)]
            else:
                lists = part.column("list_id").to_numpy(zero_copy_only=False)
                pieces = [(np.flatnonzero(lists == v), self.probes.get(int(v)))
                          for v in np.unique(lists)]
                pieces = [p for p in pieces if p[1] is not None]
            for at, wanted in pieces:
                for left in range(0, len(wanted), QUESTIONS_PER_PRODUCT):
                    who = wanted[left:left + QUESTIONS_PER_PRODUCT]
                    q = self.matrix[who[0]:who[-1] + 1] if len(who) == who[-1] - who[0] + 1 else self.matrix[who]
                    products = rows[at] @ q.T
                    # Round only what can pass; the threshold is tested after rounding.
                    i, j = np.nonzero(products > self.floor[who] - 1e-6)
                    scores = np.round(products[i, j], SCORE_DIGITS)
                    passed = (scores > self.threshold) & good[at][i]
                    i, j, scores = i[passed], j[passed], scores[passed]
                    if not len(i):
                        continue
                    row = pa.array(at[i])
                    yield pa.table({
                        "q": who[j].astype(np.int32),
                        "chunk_id": part.column("id").take(row),
                        "parent_id": part.column("parent_id").take(row),
                        "score": scores,
                        **({self.group: part.column(self.group).take(row)} if self.group else {}),
                    })

    def _raise_floor(self, hits: pa.Table) -> None:
        q, score = hits["q"].to_numpy(), hits["score"].to_numpy()
        last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
        first = np.r_[0, last[:-1] + 1]
        full = last - first + 1 >= self.k
        self.floor[q[last[full]]] = np.maximum(self.threshold, score[last[full]])

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for hits in self._products(batch):
            self.pending.append(hits)
            self.size += hits.num_rows
            if self.size >= PENDING_HITS:
                reduced = _best(pa.concat_tables(self.pending), self.k, self.group)
                if self.k is None or reduced.num_rows >= PENDING_HITS // 2:
                    yield from self._out(reduced)
                    self.pending, self.size = [], 0
                else:
                    self.pending, self.size = [reduced], reduced.num_rows
                if self.k is not None:
                    self._raise_floor(reduced)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.pending:
            yield from self._out(_best(pa.concat_tables(self.pending), self.k, self.group))
        self.pending, self.size = [], 0

    def _out(self, hits: pa.Table) -> Iterator[pa.RecordBatch]:
        out = pa.table({
            "qid": self.qids.take(hits["q"].combine_chunks()),
            "chunk_id": hits["chunk_id"], "parent_id": hits["parent_id"], "score": hits["score"],
        })
        yield from out.combine_chunks().to_batches()


def block_hits(
    block: QuestionBlock, chunks: DataFrame, min_similarity: float, k: int | None, route=None,
    group: str | None = None, tasks: int | None = None,
) -> DataFrame:
    """Hits of one block: chunks stream past the broadcast questions, no shuffle.

    ``route(matrix)`` may name per chunk list the questions that need it; chunks then
    carry ``list_id``. With ``group``, a string column of the chunks, a task keeps the best
    hit of each of the ``k`` best groups of a question. ``tasks`` is the most tasks that read the chunks.
    """
    spark = chunks.sparkSession
    schema = hit_schema(block.qid_type, chunks)
    qids, matrix = block.vectors
    if len(qids) == 0:
        return spark.createDataFrame([], schema)
    narrow = chunks.filter(F.size("embedding") == matrix.shape[1])
    columns = ["id", "parent_id", "embedding"]
    probes = None
    if route is not None:
        probes = {int(v): np.flatnonzero(m) for v, m in route(matrix).items() if m.any()}
        if not probes:
            return spark.createDataFrame([], schema)
        narrow = narrow.filter(F.col("list_id").isin(*sorted(probes)))
        columns.append("list_id")
    if group is not None:
        columns.append(group)
    shared, threshold = spark.sparkContext.broadcast(matrix), float(min_similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value, qids, threshold, k, probes, group)
        for batch in batches:
            yield from scorer.feed(batch)
        yield from scorer.flush()

    narrow = narrow.select(*columns)
    return (narrow if tasks is None else narrow.coalesce(tasks)).mapInArrow(run, schema)


def passing_hits(
    questions: DataFrame, chunks: DataFrame, min_similarity: float, k: int | None, blocks: int,
    group: str | None = None, limits: Limits = LIMITS,
) -> DataFrame:
    """Hits of any number of questions: all chunks stream past one broadcast block after the other.

    The blocks are parts of one job, and nothing but hits is shuffled. A task hands on ``k`` hits of each
    question of its block, so there are no more tasks to a block than cores.
    """
    spark = chunks.sparkSession
    lot = F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    asked = materialise(questions.select("qid", "embedding", F.size("embedding").alias("dim"), lot.alias("lot")))
    dims = [r["dim"] for r in asked.filter("dim > 0").select("dim").distinct().orderBy("dim").collect()]
    tasks = spark.sparkContext.defaultParallelism
    parts = []
    for n in range(blocks):
        for dim in dims or [0]:
            block = QuestionBlock(asked.filter((F.col("lot") == n) & (F.col("dim") == dim)).select("qid", "embedding"), limits)
            parts.append(block_hits(block, chunks, min_similarity, k, None, group, tasks))
    return functools.reduce(DataFrame.union, parts)


KEY = ("dim", "block", "shard", "part")


class _Meet:
    """Streams rows in the order of their key, the questions of a key before its chunks."""

    def __init__(self, threshold: float, k: int | None, group: str | None):
        self.threshold, self.k, self.group = threshold, k, group

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, scorer = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*KEY, "side")]
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new).tolist()
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                *now, side = (int(c[lo]) for c in columns)
                if now != key:
                    if scorer is not None:
                        yield from scorer.flush()
                    key, asked, scorer = now, [], None
                run = batch.slice(lo, hi - lo)
                if side == 0:
                    asked.append(run.select(["qid", "embedding"]))
                    continue
                if scorer is None:
                    if not asked:
                        continue
                    questions = pa.Table.from_batches(asked).combine_chunks()
                    matrix, good = unit_rows(questions["embedding"], key[0])
                    qids = questions["qid"].combine_chunks().filter(pa.array(good))
                    scorer = _Scorer(matrix[good], qids, self.threshold, self.k, None, self.group)
                if len(scorer.qids):
                    yield from scorer.feed(run)
        if scorer is not None:
            yield from scorer.flush()


def keyed_hits(
    questions: DataFrame, chunks: DataFrame, min_similarity: float, k: int | None, blocks: int,
    shards: list[Column] | None = None, group: str | None = None,
) -> DataFrame:
    """Hits of any number of questions: blocks of questions meet shards of chunks by key.

    A task holds one block of questions and streams the chunks, which are sent once for each
    block. ``shards`` names the shard column of the questions (an array) and of the
    chunks, and the parts of a shard; by default every question goes to all of as many
    shards as there are shuffle partitions.
    """
    spark = chunks.sparkSession
    if shards is None:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        asked = F.sequence(F.lit(0), F.lit(n - 1))
        own, parts = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.lit(1)
    else:
        asked, own, parts = shards
    wide = {"array<float>"} == {dict(df.dtypes)["embedding"] for df in (questions, chunks)}
    vector = F.col("embedding").cast("array<float>" if wide else "array<double>").alias("embedding")
    qid, ids = questions.schema["qid"].dataType, chunks.schema["id"].dataType
    parent = chunks.schema["parent_id"].dataType
    named = [group] if group else []
    near = questions.filter(F.size("embedding") > 0).select(
        F.size("embedding").alias("dim"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(asked).alias("shard"), F.lit(0).alias("side"), "qid",
        F.lit(None).cast(ids).alias("id"), F.lit(None).cast(parent).alias("parent_id"), vector,
        *(F.lit(None).cast("string").alias(c) for c in named),
    ).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    far = chunks.filter(F.size("embedding") > 0).select(
        F.size("embedding").alias("dim"), own.alias("shard"), F.lit(1).alias("side"),
        F.lit(None).cast(qid).alias("qid"), "id", "parent_id", vector, *named,
    ).select(
        "*", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    columns = [*KEY, "side", "qid", "id", "parent_id", "embedding", *named]
    rows = near.select(columns).union(far.select(columns))
    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "side")
    return dealt.mapInArrow(_Meet(float(min_similarity), k, group).__call__, hit_schema(qid, chunks))


def measure(questions: DataFrame) -> tuple[int, int]:
    """Rows and bytes of the vectors of a table of questions, by one aggregate."""
    size = 8 * F.greatest(F.size("embedding"), F.lit(0)).cast("long")
    row = questions.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return int(row[0]), int(row[1])


def vector_join(
    questions: DataFrame, chunks: DataFrame, min_similarity: float,
    k: int | None = None, limits: Limits = LIMITS, route=None, shards=None, group: str | None = None,
) -> DataFrame:
    """Pairs ``(qid, chunk_id, parent_id, score)`` above a similarity.

    ``questions(qid, embedding)``, ``chunks(id, parent_id, embedding)``. The
    comparison is strict. With ``k`` only the best ``k`` chunks per question
    stay, ranked by score and then chunk id. Null, zero and odd-sized vectors
    never match. ``route`` and ``shards`` are for clustered chunks (see ``block_hits``
    and ``keyed_hits``). With ``group`` the hits are those that decide the ``k`` best groups of
    each question, and maybe more; they are not ranked.
    """
    sound_unions(questions.sparkSession)
    questions = questions.select("qid", "embedding")
    rows, size = measure(questions)
    if rows <= limits.rows and size <= limits.bytes:
        hits = block_hits(QuestionBlock(questions, limits), chunks, min_similarity, k, route, group)
    else:
        # Aim at half-full blocks: hash blocks are not all of one size.
        least = max(-(-rows // limits.rows), -(-size // limits.bytes))
        if route is None and shards is None and 2 * least * input_size(chunks) > limits.bytes:
            # A block's hits should fit what a task may hold.
            blocks = max(least, -(-5 * rows * (k or 0) // (2 * PENDING_HITS)))
            hits = passing_hits(questions, chunks, min_similarity, k, blocks, group, limits)
        else:
            hits = keyed_hits(questions, chunks, min_similarity, k, 2 * least, shards, group)
    if k is None or group is not None:
        return hits
    return top_k(hits, k, ["qid"], [F.desc("score"), F.asc("chunk_id")])
