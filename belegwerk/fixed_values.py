"""Constants and formats that decide results, in one place.

Everything here is a default; the operators take each value as an argument.
"""

# --- source files -----------------------------------------------------------
SUPPORTED_EXTENSIONS = (
    ".pdf", ".docx", ".pptx", ".xlsx", ".html", ".asc",
    ".md", ".txt", ".png", ".jpg", ".jpeg", ".tiff",
)
DEFAULT_FILE_BASE_URL = "https://files.example/download/"

# --- chunk sizes, in characters ---------------------------------------------
PARENT_SIZE, PARENT_OVERLAP = 1750, 250
CHILD_SIZE, CHILD_OVERLAP = 300, 50

# --- vectors ----------------------------------------------------------------
EMBEDDING_DIM = 2560
VECTOR_LISTS = 100

# --- retrieval --------------------------------------------------------------
PASSAGE_MIN_SIMILARITY = 0.60
DOCUMENT_MIN_SIMILARITY = 0.65
VECTOR_CHUNKS = 25
KEYWORD_CHUNKS = 15
FINAL_PASSAGES = 6
FINAL_DOCUMENTS = 35
TITLE_SCORE = 1.0
COVER_WEIGHT = 0.1
SUMMARY_INPUT_CHARS = 20000
HISTORY_TURNS = 3

# --- characters stripped from both ends of a search term ---------------------
TERM_EDGE_CHARS = "?!.,"

# --- characters a URL keeps unescaped, besides letters, digits and _.-~ -------
URL_SAFE_CHARS = ":/?&="

# --- a message holding one of these bypasses retrieval ------------------------
SYSTEM_TASK_MARKERS = (
    "### Task:",
    "JSON format:",
    "concise",
    "summarizing",
    "title with",
    "Generate a short title",
    "Summarize the conversation",
    "Return only the title",
    "based on the previous",
)

# --- classifier reply ---------------------------------------------------------
REPLY_SEARCH = "TYPE: SEARCH"
REPLY_SMALLTALK = "TYPE: SMALLTALK"
REPLY_QUERY = "QUERY:"
INTENT_SEARCH, INTENT_SMALLTALK, INTENT_PASSAGES = "SEARCH", "SMALLTALK", "RAG"

# --- output formats -----------------------------------------------------------
SOURCE_LABEL = "### QUELLE: "
SUMMARY_LABEL = "DOKUMENT-INFO (Zusammenfassung): "
PASSAGE_LABEL = "RELEVANTER ABSCHNITT:"
MISSING_SUMMARY = "None"
HISTORY_CUT_MARKER = "### Referenzen:"
REFERENCE_HEADING = "\n\n---\n### 🔍 Referenzen:\n"
NO_SUMMARY = "Keine Zusammenfassung verfügbar."
NO_PASSAGES = "Keine relevanten Dokumente gefunden."
DOCUMENTS_DONE = "Dokument-Suche abgeschlossen."
