"""Replacing the terms of a dictionary in one pass: what a replacement brings in is never replaced again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a dictionary's terms and translations may have in all, as every task holds it.
MOST_CHARACTERS = 20_000_000

#: The attributes of a tag that are shown.
SHOWN = ("placeholder", "aria-label", "title")

_TOKEN = re.compile(r"(?is)(?P<block><(script|style)\b[^>]*>.*?</\2\s*>)|(?P<tag><[^<>]*>)|(?P<text>[^<]+|<)")
_SHOWN = re.compile(rf"(?is)(\s(?:{'|'.join(SHOWN)})\s*=\s*)(?:\"([^\"]*)\"|'([^']*)')")

Automaton = ahocorasick.Automaton


def automaton(terms: list[tuple[str, str]]) -> Automaton | None:
    """All terms in one automaton; None without a term. Empty terms are left out, of a repeated one the smallest translation stays."""
    out = Automaton()
    for term, other in sorted(terms, reverse=True):
        if term:
            out.add_word(term, (len(term), other))
    if not len(out):
        return None
    out.make_automaton()
    return out


def matches(found: Automaton, text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, translation): from the left, the longest term at each place, none within another."""
    longest: dict[int, tuple[int, str]] = {}
    for last, (size, other) in found.iter(text):
        begin = last + 1 - size
        if begin not in longest or longest[begin][0] < size:
            longest[begin] = size, other
    at = 0
    for begin in sorted(longest):
        if begin >= at:
            size, other = longest[begin]
            at = begin + size
            yield begin, at, other


def replaced(found: Automaton, text: str) -> str:
    out, at = [], 0
    for begin, end, other in matches(found, text):
        out += text[at:begin], other
        at = end
    return "".join([*out, text[at:]])


def replaced_in_html(found: Automaton, html: str) -> str:
    """The page with its shown texts replaced: text between two tags, and the values of shown attributes.

    Scripts, styles, tags' names and other attributes stay as they are, and so does text before the first tag
    or after the last.
    """

    def shown(m: re.Match) -> str:
        quote = '"' if m[2] is not None else "'"
        return f"{m[1]}{quote}{replaced(found, m[2] if m[2] is not None else m[3])}{quote}"

    tokens = list(_TOKEN.finditer(html))
    tags = [k for k, m in enumerate(tokens) if m.lastgroup != "text"]
    first, last = (tags[0], tags[-1]) if tags else (0, -1)
    out = []
    for k, m in enumerate(tokens):
        if m["tag"]:
            out.append(_SHOWN.sub(shown, m[0]))
        elif m["text"] and first < k < last:
            out.append(replaced(found, m[0]))
        else:
            out.append(m[0])
    return "".join(out)


def _applied(texts: Column, dictionary: DataFrame, how: Callable[[Automaton, str], str]) -> Column:
    spark = dictionary.sparkSession
    rows = dictionary.select(*(F.col(c).cast("string").alias(c) for c in ("term", "translation"))).na.drop()
    size = rows.agg(F.sum(F.length("term") + F.length("translation"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"the dictionary has {size} characters; a task holds at most {MOST_CHARACTERS}")
    shared = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])
    made: list[Automaton | None] = []

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        if not made:
            made.append(automaton(shared.value))
        return batch if made[0] is None else batch.map(lambda t: None if t is None else how(made[0], t))

    return run(texts)


def translated(texts: Column, dictionary: DataFrame) -> Column:
    """``texts`` with the terms of ``dictionary`` (term, translation) replaced in one pass, the longest term first at each place.

    The dictionary is broadcast, its size checked; each worker builds its automaton once. Upper and lower case
    differ. Null texts stay null, rows of the dictionary with a null are left out, an empty one changes nothing.
    """
    return _applied(texts, dictionary, replaced)


def translated_html(pages: Column, dictionary: DataFrame) -> Column:
    """As ``translated``, within what a page shows: see ``replaced_in_html``."""
    return _applied(pages, dictionary, replaced_in_html)
