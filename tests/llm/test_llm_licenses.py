"""op13: licence scan against plain scans and a recursive-descent evaluator."""

import re

import pytest

from presslake.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def places(words, phrases):
    found = []
    for phrase, label in phrases.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return found


def plain_evaluate(tokens):
    """Recursive descent: or-list of and-lists of (id [with exception])."""
    pos = 0

    def atom():
        nonlocal pos
        if tokens[pos] == "(":
            pos += 1
            value = disjunction()
            assert tokens[pos] == ")"
            pos += 1
            return value
        value = lic.worth(lic.label_of(tokens[pos]))
        pos += 1
        if pos < len(tokens) and tokens[pos] == "with":
            pos += 2
            value = min(1.0, value + lic.EXCEPTION_BONUS)
        return value

    def conjunction():
        nonlocal pos
        value = atom()
        while pos < len(tokens) and tokens[pos] == "and":
            pos += 1
            value = min(value, atom())
        return value

    def disjunction():
        nonlocal pos
        value = conjunction()
        while pos < len(tokens) and tokens[pos] == "or":
            pos += 1
            value = max(value, conjunction())
        return value

    return disjunction()


TEXTS = [
    None, "", "   ", "Released UNDER THE MIT LICENSE.", "under-the-mit-license and under the mit license",
    "Apache License, Version 2.0 applies; see the Apache License Version 2 text.", "Licensed CC-BY-NC 4.0, also cc by nc by nc",
    "under the mit\nlicense", "unter der MIT-Lizenz, Ünder the mit license", "x" * 100_000 + " under the mit license",
    "GNU General Public License v3 and all rights reserved", "The Mozilla Public License 2.0",
]
EXPRESSIONS = [
    ("MIT OR Apache-2.0", 1.0), ("GPL-2.0-only WITH Classpath-exception-2.0", 0.6), ("(MIT AND GPL-3.0) OR CC-BY-NC-4.0", 0.3),
    ("LGPL-2.1 AND (MIT OR GPL-3.0+)", 0.6), ("CC-BY-NC-4.0 AND MIT", 0.0), ("Apache-2.0 */ int main()", 1.0),
]


def test_base_places_against_plain_scan():
    for text in TEXTS:
        words = words_of(text)
        base = places(words, lic.BASE)
        n_words, n_base, first, last, base_labels, labels, score, n_expr = lic.scan(text)
        assert (n_words, n_base) == (len(words), len(base))
        assert first == (min(i for i, _ in base) if base else None)
        assert last == (max(i for i, _ in base) if base else None)
        assert base_labels == ",".join(sorted({l for _, l in base}))
        every = base + places(words, lic.NOTICES)
        assert labels == ",".join(sorted({l for _, l in every}))
        assert score == (min(lic.worth(l) for _, l in every) if every else 1.0)


@pytest.mark.parametrize("expression, value", EXPRESSIONS)
def test_expressions_against_recursive_descent(expression, value):
    text = f"/* SPDX-License-Identifier: {expression}\n */"
    got = lic.scan(text)
    tokens = lic.TOKEN.findall(expression.lower())
    cut = next((i for i in range(1, len(tokens)) if tokens[i] not in ("and", "or", "with", ")") and tokens[i - 1] not in ("and", "or", "with", "(")), len(tokens))
    assert lic.evaluate(expression.lower())[0] == pytest.approx(plain_evaluate(tokens[:cut])) == pytest.approx(value)
    assert got[7] == 1
    notices = places(words_of(text), lic.BASE) + places(words_of(text), lic.NOTICES)
    assert got[6] == pytest.approx(min([value] + [lic.worth(l) for _, l in notices]))


def test_malformed_and_empty_tags():
    assert lic.scan("SPDX-License-Identifier:")[7] == 0
    broken = lic.scan("spdx_license_identifier (MIT OR GPL-3.0\n")
    assert broken[7] == 1 and broken[6] == 0.3 and broken[5] == "gpl,mit"
    assert lic.scan("spdx license identifier: AND MIT")[6] == 1.0


def test_query_rows(spark):
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "under the mit license", None, None, None, None), (3, TEXTS[3], "en", "s", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, labels string")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in lic.licence_scan(df).collect()}
    expected = {(r[0],) + lic.scan(r[1])[:7] for r in rows}
    assert got == expected
    assert lic.licence_scan(df.limit(0)).count() == 0
