"""HTML as Markdown, by column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each kind of markup becomes, in this order.
STEPS = (
    (r"(?is)<!--.*?-->|<!doctype[^>]*>", ""),
    (r"(?is)<(?:script|style|head|noscript)\b[^>]*>.*?</(?:script|style|head|noscript)>", ""),
    (r"\s+", " "),
    (r"(?i)<h1\b[^>]*>", "\n\n# "),
    (r"(?i)<h2\b[^>]*>", "\n\n## "),
    (r"(?i)<h3\b[^>]*>", "\n\n### "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\b[^>]*>", "\n"),
    (r"(?i)</?(?:p|div|section|article|nav|header|footer|main|ul|ol|table|h[1-6])\b[^>]*>", "\n\n"),
    (r"(?i)</?(?:b|strong)\b[^>]*>", "**"),
    (r"(?s)<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^\s+|\s+$", ""),
)


def to_markdown(html: Column) -> Column:
    """Headings, list items, bold text and paragraphs stay as Markdown; scripts, styles and all other tags go."""
    out = F.coalesce(html, F.lit(""))
    for pattern, becomes in STEPS:
        out = F.regexp_replace(out, pattern, becomes)
    return out
