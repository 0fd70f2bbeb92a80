"""op11: the Merkle manifest against a plain tree built in Python."""

import hashlib
import zlib

import pytest

from presslake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join(field(v) for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return out


def path(tree_levels, index):
    siblings = []
    for level in tree_levels[:-1]:
        first = index - index % 8
        siblings += [level[m] for m in range(first, min(first + 8, len(level))) if m != index]
        index //= 8
    return siblings


def fold(tree_levels, index, digest):
    for level in tree_levels[:-1]:
        first = index - index % 8
        digest = h("".join(digest if m == index else level[m] for m in range(first, min(first + 8, len(level)))))
        index //= 8
    return digest


def brute(rows):
    """Per row (in input order): doc_id, leaf, subroot, root, proof, folded root, verified."""
    trees = {}
    for n, (doc_id, text, lang, source, n_chars, *_) in enumerate(rows):
        trees.setdefault(lang, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), n))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        members = sorted(trees[lang], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        built[lang] = (members, levels([m[1] for m in members]))
    top = levels([built[lang][1][-1][0] for lang in langs])
    root = top[-1][0]
    out = {}
    for t, lang in enumerate(langs):
        members, tree = built[lang]
        for i, (doc_id, digest, n) in enumerate(members):
            doc_id_, text, lang_, source, n_chars, *_ = rows[n]
            tampered = text
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                tampered = text.translate(str.maketrans(merkle.UPPER, merkle.LOWER))
            changed = leaf(doc_id, source, lang, n_chars, tampered)
            proof = h("".join(path(tree, i) + path(top, t)))
            folded = fold(top, t, fold(tree, i, changed))
            out.setdefault((doc_id, digest), []).append((doc_id, digest, tree[-1][0], root, proof, folded, folded == root))
    return sorted((r for rs in out.values() for r in rs), key=key)


def key(row):
    return (row[0] is not None, row[0] or 0) + row[1:]


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in got), key=key)


def many(n, langs):
    rows = []
    for i in range(n):
        text = None if i % 97 == 5 else ("Word Of " + str(i)) * (1 + i % 4)
        rows.append((i, text, langs[i % len(langs)], None if i % 11 == 0 else "src" + str(i % 3), None if i % 13 == 0 else i, "x", "y"))
    return rows


def test_one_lang_deep_tree_spans_blocks(spark):
    # 4,100 leaves: five levels, two blocks of 4,096, a last block of four leaves.
    rows = many(4100, ["en"])
    assert result(spark, rows) == brute(rows)


def test_many_langs_with_null_lang_and_odd_cases(spark):
    rows = many(300, ["en", None, "de", "é", "Z", "fr", "es", "pt", "it", "nl"])
    rows += [rows[3], rows[3], (None, "Text", "en", "s", 4, "a", "b"), (None, None, None, None, None, None, None),
             (7, "Other TEXT under a tied id", "en", "s", 1, "c", "d"), (8, "", "en", "", 0, "e", "f"), (9, "A" * 200_000, "de", "s", 200_000, "", "")]
    got, expected = result(spark, rows), brute(rows)
    assert got == expected
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_single_row_and_empty_table(spark):
    rows = [(1, "Hello", "en", "s", 5, "", "")]
    got = result(spark, rows)
    assert got == brute(rows)
    assert got[0][1] == got[0][2] == got[0][3]  # leaf is subroot is root
    assert got[0][4] == h("")
    assert result(spark, []) == []


@pytest.mark.parametrize("n", [8, 9, 64, 65])
def test_run_boundaries(spark, n):
    rows = many(n, ["en", "de"])
    assert result(spark, rows) == brute(rows)
