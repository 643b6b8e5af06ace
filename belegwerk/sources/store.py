"""Corpus tables on storage: immutable folders, and a log of commits that says which count.

A writer puts its rows into new folders and then adds one small file to the log, which
names the folders that begin to count and those that cease to. That file is there whole
or not at all, so readers see all of a change or nothing, whenever a run dies; what a
dead run has left behind counts for nothing. A table is read as of one snapshot of the
log; folders that others replace meanwhile stay until ``vacuum``.

A deletion of some documents writes their keys only, its marks. A folder's name in the log ends
in the marks that hold for it, and readers leave out what they name; ``compact``, or
a deletion that erases, writes the folder anew without it.

Any number of writers may add batches at the same time. Rewriting ones (delete, compact)
check after the commit that no other one has replaced the same folders, and raise if so;
run one at a time.

Tables: parents, chunks, families (the first chunk of every parent), postings (of the
chunks' texts), title_postings, ingest_errors, and of the optional vector index vectors,
centroids and radii.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from belegwerk.functions.text import document_key
from belegwerk.schemas import CHUNKS, ERRORS, PARENTS, conform
from belegwerk.session import LIMITS, input_size, materialise, sized, sound_unions

POSITIONS = T.ArrayType(T.IntegerType())
POSTINGS = (
    T.StructType().add("id", T.StringType()).add("lexeme", T.StringType())
    .add("positions", POSITIONS).add("doc", T.LongType())
)
FAMILIES = T.StructType().add("parent_id", T.StringType()).add("first_chunk", T.StringType()).add("doc", T.LongType())
TITLE_POSTINGS = T.StructType().add("title", T.StringType()).add("lexeme", T.StringType()).add("positions", POSITIONS)
VECTORS = (
    T.StructType().add("id", T.StringType()).add("parent_id", T.StringType())
    .add("embedding", T.ArrayType(T.FloatType())).add("document", T.StringType()).add("list_id", T.IntegerType())
)
CENTROIDS = T.StructType().add("list_id", T.IntegerType()).add("centroid", T.ArrayType(T.DoubleType()))
RADII = T.StructType().add("list_id", T.IntegerType()).add("radius", T.DoubleType()).add("vectors", T.LongType())
TABLES = {
    "parents": PARENTS, "chunks": CHUNKS, "postings": POSTINGS, "title_postings": TITLE_POSTINGS, "ingest_errors": ERRORS,
    "families": FAMILIES, "vectors": VECTORS, "centroids": CENTROIDS, "radii": RADII,
}
PARTITIONED = {"vectors": ["list_id"]}
# Marks name a document by title and by the hash of its key; what each table has of that. No table
# may have a column of marks: in a subquery its name would not mean the table's.
MARKS = T.StructType().add("gone_doc", T.LongType()).add("gone_title", T.StringType())
MARKED_BY = {
    "parents": "title", "title_postings": "title", "chunks": "document", "vectors": "document", "postings": "doc", "families": "doc",
}
WITHOUT = "~"  # before each name of marks
MOST_MARKS = 16  # deletions that one folder may have until it is written anew
TASK_BYTES = 128 << 20  # vectors that a task sorts into the folders of their lists
# The postings of a text lie together: a file names each id once, in a dictionary, if that may be
# large enough for all of a row group.
FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
OPTIONS = {"postings": {"parquet.dictionary.page.size": str(8 << 20), "parquet.block.size": str(16 << 20)}}
LOG = (
    T.StructType().add("added", T.BooleanType()).add("table", T.StringType()).add("batch", T.StringType())
    .add("write", T.StringType()).add("rows", T.LongType())
)


@dataclass(frozen=True, order=True)
class Folder:
    """Rows of one batch of a table, written once."""

    table: str
    batch: str
    write: str
    rows: int = -1  # parents and chunks only

    @property
    def marks(self) -> tuple[str, ...]:
        return tuple(self.write.split(WITHOUT)[1:])

    def path(self, root: str) -> str:
        return f"{root}/{self.table}/write={self.write.split(WITHOUT)[0]}/batch={self.batch}"


def _or_none(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@dataclass(frozen=True)
class Snapshot:
    """The folders that count at one moment; tables are read as they were then."""

    spark: SparkSession
    path: str
    folders: tuple[Folder, ...]

    def of(self, table: str, batches: Iterable[str] | None = None) -> list[Folder]:
        wanted = None if batches is None else set(batches)
        return [f for f in self.folders if f.table == table and (wanted is None or f.batch in wanted)]

    def batches(self) -> set[str]:
        return {f.batch for f in self.of("parents")}

    def read(self, table: str, batches: Iterable[str] | None = None) -> DataFrame:
        """Rows of a table with their ``batch``; none where nothing was written."""
        return self.stored(table, batches).drop("doc")

    def stored(self, table: str, batches: Iterable[str] | None = None) -> DataFrame:
        """Rows as ``read`` gives them, with the hash that marks go by."""
        schema = T.StructType([*TABLES[table].fields, T.StructField("batch", T.StringType())])
        lots: dict[tuple[str, ...], list[str]] = {}
        for f in self.of(table, batches):
            lots.setdefault(f.marks, []).append(f.path(self.path))
        if not lots:
            return self.spark.createDataFrame([], schema)
        sound_unions(self.spark)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
        parts = [self._unmarked(reader.parquet(*paths).select(schema.fieldNames()), table, marks) for marks, paths in lots.items()]
        return functools.reduce(DataFrame.unionByName, parts)

    def marks(self, names: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(MARKS).parquet(*[_marks_path(self.path, n) for n in names])

    def _unmarked(self, rows: DataFrame, table: str, names: tuple[str, ...]) -> DataFrame:
        if not names:
            return rows
        by = MARKED_BY[table]
        own = F.col(by).outer()
        gone = F.broadcast(self.marks(names).select("gone_title" if by == "title" else "gone_doc"))
        return rows.filter(~gone.filter(F.col(gone.columns[0]) == (F.xxhash64(own) if by == "document" else own)).exists())

    def commit(self, added: Iterable[Folder], removed: Iterable[Folder] = ()) -> None:
        """Let folders begin and cease to count, all at once."""
        rows = [(True, *_columns(f)) for f in added] + [(False, *_columns(f)) for f in removed]
        if rows:
            log = self.spark.createDataFrame(rows, LOG)
            log.coalesce(1).write.parquet(f"{self.path}/log/commit={uuid.uuid4().hex}")


def _marks_path(root: str, name: str) -> str:
    return f"{root}/marks/write={name}"


def _columns(f: Folder) -> tuple:
    return f.table, f.batch, f.write, f.rows


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    schema = T.StructType([*LOG.fields, T.StructField("commit", T.StringType())])
    return _or_none(lambda: spark.read.schema(schema).parquet(f"{path}/log"))


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """What counts in the corpus at ``path`` now; nothing where none was written yet.

    The driver gets one row for each folder that counts, as for any listing of files;
    ``compact`` keeps those few.
    """
    log = _log(spark, path)
    if log is None:
        return Snapshot(spark, path, ())
    key = ["table", "batch", "write"]
    live = log.groupBy(*key).agg(F.min("added").alias("live"), F.max("rows").alias("rows")).filter("live")
    return Snapshot(spark, path, tuple(sorted(Folder(r.table, r.batch, r.write, r.rows) for r in live.collect())))


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    """The parents table, or an empty one where none was written yet."""
    return snapshot(spark, path).read("parents")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks table, or an empty one where none was written yet."""
    return snapshot(spark, path).read("chunks")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings of the chunks, or an empty table where none were written yet."""
    return snapshot(spark, path).read("postings")


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Documents that could not go in, each with the reason."""
    return snapshot(spark, path).read("ingest_errors")


def write_batch(root: str, table: str, df: DataFrame, batch: str, rows: int = -1) -> Folder:
    """Write one batch of a table to a new folder, which does not count yet."""
    folder = Folder(table, batch, uuid.uuid4().hex, rows)
    shaped = conform(df, TABLES[table]) if table in ("parents", "chunks", "ingest_errors") else df
    writer = shaped.write.options(**FILES, **OPTIONS.get(table, {}))
    if table in PARTITIONED:
        writer = writer.partitionBy(*PARTITIONED[table])
    writer.parquet(folder.path(root))
    return folder


def listed(vectors: DataFrame, rows: int, dim: int) -> DataFrame:
    """``rows`` vectors in the order of their lists, in tasks large enough that no folder gets many small files.

    Nothing is shuffled: a task sorts what it reads and writes a file of each list.
    """
    each = 4 * dim + 256  # and the ids
    return vectors.coalesce(max(1, -(-rows * each // TASK_BYTES))).sortWithinPartitions("list_id")


def _rewrite(snap: Snapshot, table: str, df: DataFrame) -> list[Folder]:
    """Write rows of several batches, with their ``batch``, in one job; the folders that came of it."""
    write = uuid.uuid4().hex
    root = f"{snap.path}/{table}/write={write}"
    df.write.options(**FILES, **OPTIONS.get(table, {})).partitionBy("batch", *PARTITIONED.get(table, ())).parquet(root)
    schema = T.StructType([*TABLES[table].fields, T.StructField("batch", T.StringType())])
    written = snap.spark.read.schema(schema).parquet(root)
    counts = written.groupBy("batch").count().collect()  # one row for each batch
    return [Folder(table, r["batch"], write, r["count"] if table in ("parents", "chunks") else -1) for r in counts]


def _replace(snap: Snapshot, added: list[Folder], removed: list[Folder]) -> None:
    snap.commit(added, removed)
    log = _log(snap.spark, snap.path)
    twice = log.filter("not added").groupBy("table", "batch", "write").count().filter("count > 1")
    if twice.join(snap.spark.createDataFrame([_columns(f)[:3] for f in removed], "table string, batch string, write string"),
                  ["table", "batch", "write"], "left_semi").count():
        raise RuntimeError("another writer has replaced the same folders; delete or compact again, one at a time")


KEEP_BY = {"postings": "id", "vectors": "id"}  # tables that follow the chunks


def delete_from_store(spark: SparkSession, path: str, titles: DataFrame, erase: bool = False) -> None:
    """Take documents ``titles(title)`` out of all tables, in one commit.

    Their keys are written as marks, if they are few enough to be broadcast to every
    reader. Otherwise, or to ``erase`` them from the files that count, the batches that hold
    one of them are rewritten, all in one job for each table.
    """
    snap = snapshot(spark, path)
    doomed = sized(titles.select("title").distinct())
    held = snap.read("parents").join(doomed, "title", "left_semi").select("batch").distinct()
    batches = sorted(r["batch"] for r in held.collect())  # batches, not documents
    if not batches:
        return
    name = None if erase else _marked(snap, batches, doomed)
    if name is None:
        _erase(snap, batches, doomed)
        return
    removed = [f for table in MARKED_BY for f in snap.of(table, batches)]
    added = [replace(f, write=f"{f.write}{WITHOUT}{name}") for f in removed]
    left = Snapshot(spark, path, tuple(added))
    rows = {(t, r["batch"]): r["count"] for t in ("parents", "chunks") for r in left.read(t).groupBy("batch").count().collect()}
    _replace(snap, [replace(f, rows=rows.get((f.table, f.batch), 0)) if f.rows >= 0 else f for f in added], removed)


def _marked(snap: Snapshot, batches: list[str], doomed: DataFrame) -> str | None:
    """The name of marks that are written for the documents; None if marks cannot stand for them.

    They cannot if they are too many, if a folder has marks of many deletions, if rows lack their
    document's key, or if a document that stays has the hash of one that goes.
    """
    folders = [f for table in MARKED_BY for f in snap.of(table, batches)]
    before = {m for f in folders for m in f.marks}
    if max(len(f.marks) for f in folders) >= MOST_MARKS:
        return None
    for table, by in MARKED_BY.items():
        if by != "title" and snap.stored(table, batches).filter(F.col(by).isNull()).limit(1).count():
            return None
    parents = snap.read("parents", batches).select("title", F.xxhash64(document_key()).alias("doc"))
    name = uuid.uuid4().hex
    gone = parents.join(doomed, "title", "left_semi").select(
        F.col("doc").alias("gone_doc"), F.col("title").alias("gone_title")
    ).distinct()
    gone.coalesce(1).write.options(**FILES).parquet(_marks_path(snap.path, name))
    if 8 * input_size(snap.marks([name, *before])) <= LIMITS.bytes:
        stay = parents.join(doomed, "title", "left_anti")
        marks = F.broadcast(snap.marks([name]))
        if not stay.join(marks, F.col("doc") == F.col("gone_doc"), "left_semi").limit(1).count():
            return name
    _delete_folder(snap.spark, _marks_path(snap.path, name))
    return None


def _erase(snap: Snapshot, batches: list[str], doomed: DataFrame) -> None:
    old = {table: snap.stored(table, batches) for table in TABLES}
    gone = old["parents"].join(doomed, "title", "left_semi").select(F.col("id").alias("parent_id"))
    gone = sized(gone)
    lost = sized(old["chunks"].join(gone, "parent_id", "left_semi").select("id"))
    new = {
        "parents": old["parents"].join(doomed, "title", "left_anti"),
        "chunks": old["chunks"].join(gone, "parent_id", "left_anti"),
        "families": old["families"].join(gone, "parent_id", "left_anti"),
        "title_postings": old["title_postings"].join(doomed, "title", "left_anti"),
        **{table: old[table].join(lost, key, "left_anti") for table, key in KEEP_BY.items()},
    }
    added = []
    for table, df in new.items():
        if snap.of(table, batches):
            added += _rewrite(snap, table, df.select(old[table].columns))
    _replace(snap, added, [f for table in new for f in snap.of(table, batches)])


def compact(spark: SparkSession, path: str, small: int = 100_000) -> int:
    """Join the batches of fewer than ``small`` chunks into one; the number joined.

    Documents that marks name are left out, and a lone batch that has marks is written anew.
    Rows and results stay as they are. A batch that is repeated later finds its titles
    known and adds nothing.
    """
    snap = snapshot(spark, path)
    rows = {b: 0 for b in snap.batches()}
    for f in snap.of("chunks"):
        rows[f.batch] += f.rows
    batches = sorted(b for b, n in rows.items() if 0 <= n < small)
    if len(batches) < 2 and not any(f.marks for b in batches for f in snap.of("parents", [b])):
        return 0
    name = f"joined-{uuid.uuid4().hex}"
    total = sum(rows[b] for b in batches)
    added, removed = [], []
    for table in TABLES:
        old = snap.of(table, batches)
        if not old or table == "centroids":
            continue
        df = snap.stored(table, batches).drop("batch")
        if table == "radii":
            df = df.groupBy("list_id").agg(F.max("radius").alias("radius"), F.sum("vectors").alias("vectors"))
        elif table == "vectors":
            df = listed(df, total, len(snap.read("centroids").first()["centroid"]))
        else:  # postings stay in their order
            df = df.coalesce(max(1, -(-total // small)))
        added.append(write_batch(path, table, df, name, sum(f.rows for f in old) if table in ("parents", "chunks") else -1))
        removed += old
    _replace(snap, added, removed)
    return len(batches)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that some commit has replaced; the number deleted.

    Call it when no search that began before those commits is still running.
    """
    log = _log(spark, path)
    if log is None:
        return 0
    gone = [Folder(*r) for r in log.filter("not added").select("table", "batch", "write").distinct().collect()]
    live = snapshot(spark, path).folders
    paths = {f.path(path) for f in gone} - {f.path(path) for f in live}
    marks = {m for f in gone for m in f.marks} - {m for f in live for m in f.marks}
    return sum(_delete_folder(spark, p) for p in (*paths, *(_marks_path(path, m) for m in marks)))


def _delete_folder(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def delete_documents(
    parents: DataFrame, chunks: DataFrame, titles: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given ``titles(title)`` and without their chunks.

    What is deleted is written, and broadcast if it is small, so that the chunks stay where they are.
    """
    doomed = sized(titles.select("title").distinct())
    kept = parents.join(doomed, "title", "left_anti")
    gone = sized(parents.join(doomed, "title", "left_semi").select(F.col("id").alias("parent_id")))
    return kept, chunks.join(gone, "parent_id", "left_anti")
