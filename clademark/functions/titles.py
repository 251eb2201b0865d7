"""Titles of publications as plain text (F-24)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Markup may be nested so deep.
DEPTH = 10
_MARKED = re.compile(r"<([A-Za-z][A-Za-z0-9]*)>(.*?)</\1>(\s*)", re.DOTALL)
_TAG = re.compile(r"</?[A-Za-z][^>]*>")


def _splits_word(inside: str, gap: str, after: str) -> bool:
    """Whether what is marked and what follows are one word: they touch, or a line was broken inside of it (what follows is in lower case)."""
    if not inside or " " in inside:
        return False
    if not gap:
        return after.isalnum() or after in ("(", "[")
    return after.islower() and (len(gap) > 1 or "\n" in gap or len(inside) == 1)


def clean_title(title: str | None) -> str:
    """A title without markup, words put together again where markup has split them, with single blanks; null is empty."""
    text = title if isinstance(title, str) else ""
    for _ in range(DEPTH):
        done, parts = 0, []
        for m in _MARKED.finditer(text):
            inside, gap = m[2].strip(), m[3]
            # A phrase stands apart from what is before it as well.
            parts += [text[done : m.start()], " " if " " in inside else "", inside, "" if _splits_word(inside, gap, text[m.end() : m.end() + 1]) else " "]
            done = m.end()
        if not done:
            break
        text = "".join([*parts, text[done:]])
    return re.sub(r"\s+", " ", _TAG.sub("", text)).strip()


@F.pandas_udf(StringType())
def cleaned_titles(titles: pd.Series) -> pd.Series:
    """``clean_title`` for a column: titles are as many as a knowledge base cites, not as samples."""
    return titles.map(clean_title)
