"""Small documents with every odd case, and slow, plain versions of the operators."""

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, shard string, d string, n string, copies string"


def words(text):
    return WORD.findall(text or "")


def prose(r, n):
    return " ".join(r.choice(["sea", "rock", "kelp", "the", "a", "of", "blue", "tern", "ice", "wind", "Nets", "ébb"]) + str(r.randrange(40)) for _ in range(n))


def rows():
    """Documents with copies, shared passages, repeats within a text, and all that may be missing.

    Columns beyond those of documents have names that the operators use inside.
    """
    r = random.Random(11)
    passage, line = prose(r, 60), prose(r, 45)
    texts = [prose(r, r.randrange(1, 160)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[4] + " more", passage, prose(r, 30) + " " + passage + " " + prose(r, 20), prose(r, 9) + " " + passage]
    texts += [line + "\n" + line + "\n" + prose(r, 12), " ".join(["tick"] * 300), "x" * 700, "ab" * 400, prose(r, 3000)]
    near = prose(r, 150).split()
    for i in range(6):
        texts.append(" ".join(near[:20 + i] + ["edit%d" % i] + near[21 + i :]))
    texts += [None, "", " \t\n ", None, "one", "two words", "\x0b odd \x0c spaces kept ", "日本語 " * 30, "#" * 50]
    out = [(i, t, "en", ["b", "a", None, "c", ""][i % 5] if i % 3 else "hot", len(t or ""), 1, "s", "s", "d", "n", "c") for i, t in enumerate(texts)]
    out += [out[5], out[5], (None,) + out[6][1:], (None, None) + out[6][2:], (7, "another text under the same id",) + out[7][2:]]
    return out


def repeated_units(units_of, window):
    """Per text, flags of the units covered by a window that starts more than once."""
    units = [units_of(t) for t in (row[1] for row in rows())]
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    flags = []
    for u in units:
        f = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                f[i : i + window] = [True] * window
        flags.append(f)
    return units, flags


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)
