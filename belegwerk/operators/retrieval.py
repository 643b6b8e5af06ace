"""The branches of both search modes and their fusion, over tables of questions.

Questions are ``(qid, question, terms, embedding)``, in any number; the corpus is
``parents(id, title, source_url, full_text, summary)``,
``chunks(id, parent_id, content, embedding)``. Small tables that come of the questions
are written and broadcast; beyond the limits the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from belegwerk.fixed_values import (
    FINAL_DOCUMENTS, KEYWORD_CHUNKS, TITLE_SCORE, VECTOR_CHUNKS,
)
from belegwerk.functions.text import document_key
from belegwerk.functions.urls import safe_url
from belegwerk.operators.postings import lexeme_sets, match_sets
from belegwerk.operators.substring import AskedTerms, first_per_term, match_terms, term_hits
from belegwerk.operators.vector_join import vector_join
from belegwerk.operators.vector_lists import VectorLists, list_join
from belegwerk.session import LIMITS, Limits, ranked, sized, top_k


def by_score() -> list:
    return [F.desc("score"), F.asc("chunk_id")]


def vector_branch(
    questions: DataFrame, chunks: DataFrame, min_similarity: float, k: int | None = VECTOR_CHUNKS,
    lists: VectorLists | None = None, route=None, limits: Limits = LIMITS, group: str | None = None,
) -> DataFrame:
    """Best chunks by similarity: ``(qid, chunk_id, parent_id, score)``.

    A chunk's parent is taken from its foreign key; ``validate_corpus`` checks
    that key, so no join is spent on it here. Clustered ``lists`` are read instead of the
    chunks where there are any.
    """
    if lists is not None and route is None:
        hits = list_join(questions, lists, min_similarity, k, limits=limits, group=group)
    else:
        whole = chunks.filter(F.col("parent_id").isNotNull())
        hits = vector_join(questions, whole, min_similarity, k, limits, route, group=group)
    return hits.select("qid", "chunk_id", "parent_id", "score")


def keyword_branch(
    questions: DataFrame, parents: DataFrame, chunks: DataFrame, postings: DataFrame,
    config: str = "german", k: int = KEYWORD_CHUNKS, families: DataFrame | None = None,
    wildcards: bool = False, limits: Limits = LIMITS,
) -> DataFrame:
    """Best chunks by cover density, filled up with substring hits of score 0.

    A chunk qualifies when it matches all lexemes or its parent holds any term.
    The fill needs only the ``k`` smallest chunk ids per question, and those lie
    in the ``k`` parents with the smallest first chunk of each term; so every
    term keeps ``k`` parents, whatever share of all parents it matches. The first chunk of
    each parent is read from stored ``families(parent_id, first_chunk)``, if there are any.
    """
    words = questions.select("qid", F.array_join("terms", " ").alias("words"))
    sets = lexeme_sets(words, "words", config, limits)
    matched = sized(match_sets(sets, postings, "id", k, limits).withColumnRenamed("id", "chunk_id"), limits)

    asked = AskedTerms(questions.select("qid", "terms"), limits)
    first = families
    if first is None:
        first = chunks.groupBy("parent_id").agg(F.min("id").alias("first_chunk"))
    hits = term_hits(parents, "full_text", ["id"], asked, wildcards)
    per_term = first_per_term(
        hits.join(first, hits["id"] == first["parent_id"])
        .select("parent_id", "first_chunk", "term_ids"),
        k, ["first_chunk", "parent_id"],
    )
    chosen = sized(first_parents(per_term.join(asked.askers, "term_id"), k), limits)
    family = chunks.select("parent_id", F.col("id").alias("chunk_id"))
    fill = family.join(chosen, "parent_id").select(
        "qid", "chunk_id", "parent_id", F.lit(0.0).alias("score")
    )
    fill = top_k(fill, k, ["qid"], [F.asc("chunk_id")]).drop("rank")
    scored = family.join(matched, "chunk_id").select("qid", "chunk_id", "parent_id", "score")
    both = scored.unionByName(fill).groupBy("qid", "chunk_id", "parent_id").agg(
        F.max("score").alias("score")
    )
    return top_k(both, k, ["qid"], by_score()).drop("rank")


def first_parents(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first distinct parents of each question: ``(qid, parent_id)``.

    A parent of ``found(qid, parent_id, first_chunk)`` comes once for each term, so rows are cut by dense rank
    where they are, before they are shuffled.
    """
    near = F.dense_rank().over(Window.partitionBy("qid").orderBy("first_chunk"))
    rows = found.select("qid", "parent_id", "first_chunk", near.alias("near")).filter(F.col("near") <= k)
    return top_k(rows.drop("near").distinct(), k, ["qid"], [F.asc("first_chunk")]).select("qid", "parent_id")


def best_per_parent(*branches: DataFrame) -> DataFrame:
    """All branches together, best score per question and parent."""
    rows = branches[0].select("qid", "parent_id", "score")
    for branch in branches[1:]:
        rows = rows.unionByName(branch.select("qid", "parent_id", "score"))
    return rows.groupBy("qid", "parent_id").agg(F.max("score").alias("final_score"))


def with_passages(fused: DataFrame, parents: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Rank fused parents per question and fetch their wide columns.

    The fused side is two top-k lists per question. It is ranked while narrow, so that
    texts never go through a window.
    """
    there = parents.select(F.col("id").alias("parent_id")).join(sized(fused, limits), "parent_id")
    order = ranked(there, ["qid"], [F.desc("final_score"), F.asc("parent_id")], "fused_rank")
    wide = parents.select(F.col("id").alias("parent_id"), "title", "source_url", "full_text", "summary")
    return wide.join(sized(order, limits), "parent_id").select(
        "parent_id", "title", "source_url", "full_text", "summary", "qid", "final_score", "fused_rank"
    )


def document_vector_branch(
    questions: DataFrame, parents: DataFrame, chunks: DataFrame, min_similarity: float,
    k: int = FINAL_DOCUMENTS, lists: VectorLists | None = None, route=None, limits: Limits = LIMITS,
) -> DataFrame:
    """Best similarity of the ``k`` best documents: ``(qid, title, source_url, score)``.

    A task keeps the best chunk of the ``k`` best documents of each question: a document
    among the best of all is among the best where its best chunk is. Chunks
    that do not carry their ``document`` get it from their parent first.
    """
    names = parents.select(F.col("id").alias("parent_id"), "title", "source_url")
    if lists is None and "document" not in chunks.columns:
        chunks = chunks.join(names.select("parent_id", document_key().alias("document")), "parent_id")
    hits = vector_branch(questions, chunks, min_similarity, k, lists, route, limits, "document")
    best = hits.groupBy("qid", "parent_id").agg(F.max("score").alias("score"))
    return sized(best, limits).join(names, "parent_id").groupBy("qid", "title", "source_url").agg(
        F.max("score").alias("score")
    )


def document_title_branch(
    questions: DataFrame, parents: DataFrame, k: int | None = FINAL_DOCUMENTS, wildcards: bool = False,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Documents whose title holds any term of ``questions(qid, terms)``: ``(qid, title, source_url, score)``.

    All scores are equal, so only the first ``k`` by title and URL can be used;
    every term keeps ``k`` documents before questions are attached. Without ``k`` every pair
    comes, once, where its document is read.
    """
    documents = parents.select("title", "source_url").distinct()
    by_name = ["title", "source_url"]
    if k is None:
        rows = match_terms(questions, documents, "title", by_name, limits=limits, wildcards=wildcards)
    else:
        asked = AskedTerms(questions.select("qid", "terms"), limits)
        per_term = first_per_term(term_hits(documents, "title", by_name, asked, wildcards), k, by_name)
        rows = per_term.join(asked.askers, "term_id").select("qid", "title", "source_url").distinct()
        rows = top_k(rows, k, ["qid"], [F.asc(c) for c in by_name]).drop("rank")
    return rows.withColumn("score", F.lit(float(TITLE_SCORE)))


def first_by_title(rows: DataFrame, rank: str, keep: list[str]) -> DataFrame:
    """First-seen distinct by title per question, renumbered from 1 in ``pos``."""
    first = top_k(rows, 1, ["qid", "title"], [F.asc(rank)], "__nth").drop("__nth")
    return ranked(first, ["qid"], [F.asc(rank)], "pos").select("qid", "pos", "title", *keep)


def ranked_documents(*branches: DataFrame, k: int = FINAL_DOCUMENTS) -> DataFrame:
    """Union of both branches, top ``k`` rows, then first-seen titles.

    The cut comes before the de-duplication: a document found by both branches
    takes two of the ``k`` places and appears once.
    """
    rows = branches[0]
    for branch in branches[1:]:
        rows = rows.unionByName(branch)
    order = [F.desc("score"), F.asc("title"), F.asc("source_url")]
    top = top_k(rows, k, ["qid"], order)
    return first_by_title(top, "rank", ["source_url", "score"]).select(
        "qid", "pos", "title", safe_url(F.col("source_url")).alias("url"), "score"
    )
