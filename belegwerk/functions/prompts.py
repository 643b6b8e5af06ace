"""Prompt templates. Every text is an argument; these are working defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from belegwerk.fixed_values import (
    INTENT_SEARCH, INTENT_SMALLTALK, SUMMARY_INPUT_CHARS,
)

SUMMARY_TEMPLATE = (
    "Schreibe genau drei Sätze über das folgende Dokument: seine Art und seinen Zweck, "
    "das behandelte Projekt oder Produkt und die zentrale Aussage.\n\nText: {text}"
)
INTENT_TEMPLATE = (
    "Ordne die Nachricht ein und nenne knappe Suchbegriffe.\n"
    "SMALLTALK: Gruß, Dank oder allgemeines Gespräch.\n"
    "SEARCH: es werden Dokumente oder eine Liste von Dateien verlangt.\n"
    "RAG: Fachfrage, die aus den Dokumenten zu beantworten ist.\n"
    "Der Verlauf zählt nur, wenn die Nachricht sich auf ihn bezieht.\n"
    "Antworte in zwei Zeilen:\nTYPE: <Klasse>\nQUERY: <Suchbegriffe>\n\n"
    "Nachricht:\n{question}\n\nVerlauf:\n{history}"
)
RERANK_TEMPLATE = (
    "Instruct: Welche Abschnitte helfen, diese Frage zu beantworten?\nQuery: {question}"
)
SEARCH_EMPTY_PROMPT = (
    "Teile freundlich mit, dass zu dieser Suche nichts gefunden wurde und passende "
    "Dokumente vielleicht noch fehlen."
)
SEARCH_FOUND_PROMPT = (
    "Bestätige in einem Satz, dass Dokumente gefunden wurden. Zähle sie nicht auf; "
    "die Liste folgt von selbst."
)
SMALLTALK_PROMPT = (
    "Antworte freundlich und biete Hilfe bei Fragen zu den Dokumenten und bei der Suche an."
)
PASSAGE_TEMPLATE = (
    "Beantworte die Frage vollständig und nur nach den folgenden Abschnitten. Erfinde nichts "
    "und schreibe keine Quellenliste. Sage es, wenn die Abschnitte nichts hergeben.\n\n{context}"
)


def fill_template(template: str, **values: Column) -> Column:
    """A template's text with columns in place of ``{name}``; null prints empty."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(F.coalesce(values[piece], F.lit("")) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def summary_prompt(
    text: Column, template: str = SUMMARY_TEMPLATE, most: int | None = SUMMARY_INPUT_CHARS
) -> Column:
    """Prompt over the first ``most`` characters, what the model reads; None: all."""
    return fill_template(template, text=text if most is None else F.substring(text, 1, most))


def intent_prompt(question: Column, history: Column, template: str = INTENT_TEMPLATE) -> Column:
    return fill_template(template, question=question, history=history)


def system_prompt(
    intent: Column, n_documents: Column, context: Column,
    search_empty: str = SEARCH_EMPTY_PROMPT, search_found: str = SEARCH_FOUND_PROMPT,
    smalltalk: str = SMALLTALK_PROMPT, passages: str = PASSAGE_TEMPLATE,
) -> Column:
    """One of four system prompts by intent and number of documents."""
    return (
        F.when((intent == INTENT_SEARCH) & (n_documents == 0), search_empty)
        .when(intent == INTENT_SEARCH, search_found)
        .when(intent == INTENT_SMALLTALK, smalltalk)
        .otherwise(fill_template(passages, context=context))
    )
