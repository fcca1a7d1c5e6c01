"""Rows that every text operator must take."""

from __future__ import annotations

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Null, empty and blank texts, one word, equal rows, a repeated id, a null id, a long
# text, symbols, other scripts, and columns whose names operators use themselves.
EDGE = [
    (1, None, "a", "x"),
    (2, "", "a", "x"),
    (3, " \t\n ", None, None),
    (4, "word", "b", "x"),
    (5, "The same text of some words here again", "a", "y"),
    (5, "The same text of some words here again", "a", "y"),
    (6, "the SAME text of some words here again", "a", None),
    (None, "the row without an id has words", "b", "y"),
    (7, "### *** ||| 123 !!!", None, "y"),
    (8, "日本語 テキスト и русский ' don't we'll <|endoftext|>", "c", "x"),
    (9, ("lorem ipsum dolor sit amet " * 3000) + "end", "a", "x"),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["words", "stats", "component", "path", "host", "rule", "start", "set_key", "n_tokens", "block", "score", "key", "has_letter_", "coverage_", "stats_", "chosen_block", "chosen_key", "judged_url", "language", "quality_score", "others", "pin"]
