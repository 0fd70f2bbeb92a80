"""Licence scan of documents: Aho-Corasick finds notice phrases and identifier tags, a
shunting-yard parser evaluates the licence expressions that follow the tags.

Text: A-Z lower-cased (nothing else), null as empty. Words: runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``
(digits, a-z and every non-ASCII character); word places count from 0.

* Notice phrases are word sequences. One automaton holds all of them as `` w1 w2 … `` between
  single spaces and runs once over the document's words joined the same way, so a match is a
  place where the phrase's words stand consecutively; overlapping places all count. The base
  phrases (``BASE``) give ``n_base``, ``first_word``, ``last_word`` and ``base_labels``; the
  method's phrases (``NOTICES``) add labels.
* Identifier tags (``spdx-license-identifier``, with ``-``, ``_`` or a space between its parts)
  are found by a second automaton over the lower-cased text itself; the rest of the tag's line
  is the expression. Its tokens are licence ids, ``and``, ``or``, ``with`` and parentheses; the
  shunting-yard parser turns them into postfix (``with`` binds tighter than ``and``, ``and``
  than ``or``) and evaluates it: a licence is worth its ``PERMISSIVE`` value, ``a or b`` the
  better, ``a and b`` the worse, ``a with exception`` a raised by ``EXCEPTION_BONUS`` (capped at 1).
  The expression ends at the line's end or where an operand follows an operand. A malformed
  expression (unbalanced parentheses, an operator without operands) is worth the worst of its
  licences. Ids are mapped to labels by ``ID_LABELS`` (first matching prefix); others
  keep their own id as label. Exceptions give no label.

``score`` is the worth of all that is found together (every notice and every expression
applies, so the worst), 1.0 where nothing is found.

Edge cases: null and empty texts have no words (n_words 0, nulls for the places, empty label
strings, score 1.0); very long texts are scanned whole in one pass each; repeated rows are scored
each; a tag without an expression is ignored; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.staging import ready_for_python

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases of the method and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "licensed under the apache license": "apache-2",
    "apache license 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
# Licence ids (prefixes) of expressions and their labels.
ID_LABELS = (
    ("mit", "mit"), ("apache-2", "apache-2"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("gpl", "gpl"), ("bsd", "bsd"),
    ("mpl-2", "mpl-2"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"), ("cc0", "cc0"),
    ("unlicense", "unlicense"), ("proprietary", "proprietary"),
)
# Worth of each label for training use (1 free, 0 not allowed).
PERMISSIVE = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "cc-by": 1.0, "cc0": 1.0, "unlicense": 1.0,
    "lgpl": 0.6, "mpl-2": 0.6, "gpl": 0.3, "agpl": 0.3, "cc-by-sa": 0.3, "cc-by-nc": 0.0, "proprietary": 0.0,
}
UNKNOWN_WORTH = 0.5
EXCEPTION_BONUS = 0.3
TAG_PARTS = ("spdx", "license", "identifier")

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+\-:]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
       "score double, n_expressions long")

_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(kind: str) -> ahocorasick.Automaton:
    """Built once per Python worker."""
    if kind not in _automata:
        found = ahocorasick.Automaton()
        if kind == "words":
            for phrase, label in BASE.items():
                found.add_word(f" {phrase} ", (True, label, len(phrase) + 2))
            for phrase, label in NOTICES.items():
                found.add_word(f" {phrase} ", (False, label, len(phrase) + 2))
        else:
            for a in "-_ ":
                for b in "-_ ":
                    tag = f"{TAG_PARTS[0]}{a}{TAG_PARTS[1]}{b}{TAG_PARTS[2]}"
                    found.add_word(tag, len(tag))
        found.make_automaton()
        _automata[kind] = found
    return _automata[kind]


def label_of(licence_id: str) -> str:
    for prefix, label in ID_LABELS:
        if licence_id.startswith(prefix):
            return label
    return licence_id


def worth(label: str) -> float:
    return PERMISSIVE.get(label, UNKNOWN_WORTH)


def evaluate(expression: str) -> tuple[float, set[str]] | None:
    """Worth and labels of a licence expression (lower-case); None if it names no licence."""
    tokens = TOKEN.findall(expression)
    output: list[str] = []
    operators: list[str] = []
    broken = False
    expect_operand, after_with = True, False
    for token in tokens:
        if not expect_operand and token not in PRECEDENCE and token != ")":
            break  # an operand where an operator belongs: the expression has ended
        if token in PRECEDENCE:
            while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[token]:
                output.append(operators.pop())
            operators.append(token)
            broken |= expect_operand
            expect_operand, after_with = True, token == "with"
        elif token == "(":
            operators.append(token)
        elif token == ")":
            while operators and operators[-1] != "(":
                output.append(operators.pop())
            if operators:
                operators.pop()
            else:
                broken = True
        else:
            output.append(("!" if after_with else "") + token)
            expect_operand, after_with = False, False
    while operators:
        top = operators.pop()
        broken |= top == "("
        if top != "(":
            output.append(top)
    licences = {label_of(t) for t in output if t not in PRECEDENCE and not t.startswith("!")}
    if not licences:
        return None
    if broken:
        return min(worth(x) for x in licences), licences
    stack: list[tuple[float, bool]] = []  # (worth, is an exception)
    for token in output:
        if token in PRECEDENCE:
            if len(stack) < 2:
                return min(worth(x) for x in licences), licences
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, left[0] + EXCEPTION_BONUS) if right[1] else min(left[0], right[0]), False))
            elif token == "and":
                stack.append((min(left[0], right[0]), False))
            else:
                stack.append((max(left[0], right[0]), False))
        elif token.startswith("!"):
            stack.append((1.0, True))
        else:
            stack.append((worth(label_of(token)), False))
    if len(stack) != 1:
        return min(worth(x) for x in licences), licences
    return stack[0][0], licences


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_expressions of one text."""
    lowered = (text or "").translate(_UPPER)
    words = WORD.findall(lowered)
    joined = " " + " ".join(words) + " "
    starts = list(accumulate((len(w) + 1 for w in words[:-1]), initial=1)) if words else []
    n_base, first, last, base, labels, worths = 0, None, None, set(), set(), []
    if words:
        from bisect import bisect_left

        for end, (is_base, label, length) in _automaton("words").iter(joined):
            place = bisect_left(starts, end - length + 2)
            labels.add(label)
            worths.append(worth(label))
            if is_base:
                n_base += 1
                base.add(label)
                first = place if first is None else min(first, place)
                last = place if last is None else max(last, place)
    n_expressions = 0
    for end, length in _automaton("tags").iter(lowered):
        line_end = lowered.find("\n", end + 1)
        found = evaluate(lowered[end + 1 : None if line_end < 0 else line_end])
        if found is not None:
            n_expressions += 1
            worths.append(found[0])
            labels |= found[1]
    score = min(worths) if worths else 1.0
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score), n_expressions


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches:
        rows = [scan(t) for t in batch["text"]]
        frame = pd.DataFrame(rows, columns=columns[1:])
        frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield frame.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})


def licence_scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_expressions."""
    ready_for_python(documents.sparkSession)
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(_scan_batches, OUT)
