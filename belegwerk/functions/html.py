"""HTML and plain files to Markdown-like text."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns (the subset Java and RE2 share) and their replacement,
# applied in this order.
HTML_RULES = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
    (r"\s+", " "),
    (r"(?i)<h1\b[^>]*>", "\n\n# "),
    (r"(?i)<h2\b[^>]*>", "\n\n## "),
    (r"(?i)<h3\b[^>]*>", "\n\n### "),
    (r"(?i)<h[4-6]\b[^>]*>", "\n\n#### "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(p|div|article|section|ul|ol|table|tr|nav|header|footer|main|aside|h[1-6])\b[^>]*>", "\n\n"),
    (r"<[^>]*>", ""),
    (r"[ \t]*\n[ \t]*", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
    (r"^\s+|\s+$", ""),
)


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Named and numeric character references once; hard spaces become blanks."""
    return text.map(lambda t: unescape(t).replace("\xa0", " ") if t and "&" in t else t)


def html_to_markdown(html: Column) -> Column:
    """Headings, list items and paragraphs as Markdown; all other tags go."""
    out = html
    for pattern, replacement in HTML_RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return decode_entities(out)
