"""Both search modes over tables of questions, end to end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.fixed_values import (
    DOCUMENT_MIN_SIMILARITY, DOCUMENTS_DONE, FINAL_DOCUMENTS, FINAL_PASSAGES, KEYWORD_CHUNKS,
    PASSAGE_MIN_SIMILARITY, VECTOR_CHUNKS,
)
from belegwerk.functions.text import search_terms
from belegwerk.functions.vectors import hashed_embedding
from belegwerk.operators import assemble, retrieval
from belegwerk.operators.models import Model, term_share
from belegwerk.operators.postings import build_postings, fts_rank
from belegwerk.operators.question_block import prepare_questions
from belegwerk.operators.vector_lists import VectorLists
from belegwerk.session import LIMITS, Limits, materialise, sized, sound_unions, top_k
from belegwerk.sources.store import snapshot


@dataclass(frozen=True)
class Corpus:
    """Tables of one corpus. Without stored postings a search builds its own."""

    parents: DataFrame
    chunks: DataFrame
    postings: DataFrame | None = None
    config: str = "german"
    families: DataFrame | None = None
    lists: VectorLists | None = None
    title_postings: DataFrame | None = None

    def keyword_index(self) -> DataFrame:
        if self.postings is not None:
            return self.postings
        # A search reads the index several times: write it rather than repeat it.
        return materialise(build_postings(self.chunks, "content", "id", self.config))


def stored_corpus(spark: SparkSession, path: str, config: str = "german") -> Corpus:
    """All tables of the corpus at ``path``, as of one snapshot."""
    snap = snapshot(spark, path)
    return Corpus(
        snap.read("parents"), snap.read("chunks"), snap.read("postings"), config,
        snap.read("families"), VectorLists.stored(snap), snap.read("title_postings"),
    )


@dataclass(frozen=True)
class Settings:
    """Numbers and models of a search; the defaults are the fixed values."""

    passage_similarity: float = PASSAGE_MIN_SIMILARITY
    document_similarity: float = DOCUMENT_MIN_SIMILARITY
    vector_chunks: int = VECTOR_CHUNKS
    keyword_chunks: int = KEYWORD_CHUNKS
    passages: int = FINAL_PASSAGES
    documents: int = FINAL_DOCUMENTS
    embedding_model: Model = hashed_embedding
    rerank_model: Model = term_share
    rerank_template: str | None = None
    route: object = None
    wildcards: bool = False  # % and _ inside a term match freely
    limits: Limits = field(default_factory=lambda: LIMITS)


def _prepared(questions: DataFrame, settings: Settings) -> DataFrame:
    """Questions with their terms and vectors, written: both branches read them."""
    sound_unions(questions.sparkSession)
    return materialise(prepare_questions(questions, settings.embedding_model))


def _keyword(prepared: DataFrame, corpus: Corpus, settings: Settings) -> DataFrame:
    return retrieval.keyword_branch(
        prepared, corpus.parents, corpus.chunks, corpus.keyword_index(), corpus.config,
        settings.keyword_chunks, corpus.families, settings.wildcards, settings.limits,
    )


def keyword_search(
    questions: DataFrame, corpus: Corpus, settings: Settings = Settings()
) -> DataFrame:
    """Keyword branch alone: ``(qid, chunk_id, parent_id, score)``."""
    return _keyword(_prepared(questions, settings), corpus, settings)


def _fused(prepared: DataFrame, corpus: Corpus, settings: Settings) -> DataFrame:
    vector = retrieval.vector_branch(
        prepared, corpus.chunks, settings.passage_similarity, settings.vector_chunks,
        corpus.lists, settings.route, settings.limits,
    )
    fused = retrieval.best_per_parent(vector, _keyword(prepared, corpus, settings))
    return retrieval.with_passages(fused, corpus.parents, settings.limits)


def hybrid_search(
    questions: DataFrame, corpus: Corpus, settings: Settings = Settings()
) -> DataFrame:
    """Fused candidate passages per question, ranked by ``fused_rank``.

    ``(qid, parent_id, title, source_url, full_text, summary, final_score, fused_rank)``.
    """
    return _fused(_prepared(questions, settings), corpus, settings)


def top_passages(
    questions: DataFrame, corpus: Corpus, settings: Settings = Settings()
) -> DataFrame:
    """Reranked passages: the columns of ``hybrid_search`` plus ``rerank_score, pos``."""
    prepared = _prepared(questions, settings)
    paired = _fused(prepared, corpus, settings).join(
        sized(prepared.select("qid", "question"), settings.limits), "qid"
    )
    return assemble.rerank(
        paired, settings.rerank_model, settings.passages, "question", settings.rerank_template
    )


def passage_answers(
    questions: DataFrame, corpus: Corpus, settings: Settings = Settings()
) -> DataFrame:
    """``(qid, context, documents)`` for every question."""
    top = top_passages(questions, corpus, settings)
    return assemble.passage_results(questions, top)


def document_search(
    questions: DataFrame, corpus: Corpus, settings: Settings = Settings()
) -> DataFrame:
    """Documents per question: ``(qid, pos, title, url, score)``."""
    prepared = _prepared(questions, settings)
    vector = retrieval.document_vector_branch(
        prepared, corpus.parents, corpus.chunks, settings.document_similarity, settings.documents,
        corpus.lists, settings.route, settings.limits,
    )
    title = retrieval.document_title_branch(
        prepared, corpus.parents, settings.documents, settings.wildcards, settings.limits
    )
    return retrieval.ranked_documents(vector, title, k=settings.documents)


def title_search(
    questions: DataFrame, corpus: Corpus, settings: Settings = Settings()
) -> DataFrame:
    """Documents whose title holds all lexemes of a question, by cover density.

    ``(qid, title, score, rank)``, from the stored title postings if there are any.
    """
    index = corpus.title_postings
    if index is None:
        titles = corpus.parents.select("title").distinct()
        index = materialise(build_postings(titles.withColumn("words", F.col("title")), "words", "title", corpus.config))
    asked = questions.select("qid", F.array_join(search_terms(F.col("question")), " ").alias("words"))
    hits = fts_rank(asked, index, "words", "title", corpus.config, settings.documents, settings.limits)
    return top_k(hits.distinct(), settings.documents, ["qid"], [F.desc("score"), F.asc("title")])


def document_answers(
    questions: DataFrame, corpus: Corpus, settings: Settings = Settings()
) -> DataFrame:
    """``(qid, context, documents)`` for every question, in document mode."""
    lists = assemble.document_lists(document_search(questions, corpus, settings))
    return assemble.with_every_question(
        questions.select("qid"), lists, documents=assemble.no_documents()
    ).select("qid", F.lit(DOCUMENTS_DONE).alias("context"), "documents")
