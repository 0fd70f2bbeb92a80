"""Substring removal, near duplicates and suffix sorting against plain versions."""

import functools
import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_data import repeated_units, rows, table, words
from presslake.llm import fm_dedup, passages, simhash_links, suffix_dedup
from presslake.llm.components import components
from presslake.llm.induced_sorting import Store, sorted_suffixes
from pyspark.sql import functions as F


def plain_sort(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("memory", [3, 8, 1000])
def test_suffix_order_and_common_prefixes(memory):
    """Little memory sends queues and arrays to disk and strings of names into recursion."""
    r, spilled = random.Random(memory), 0
    for _ in range(120):
        text = [r.randrange(1, r.choice([2, 3, 4, 30])) for _ in range(r.randrange(1, 70))] * r.choice([1, 1, 3])
        text.append(0)
        cap, store = r.choice([2, 9, 200]), Store(memory)
        order, common = sorted_suffixes(np.array(text, r.choice([np.uint8, np.int64])), cap, memory, store)
        assert (list(order), list(common)) == plain_sort(text, cap)
        spilled += store.spilled
        store.close()
    assert (spilled > 0) == (memory < 1000)


def test_scratch_bytes_of_a_sort_in_little_memory():
    text = np.append(np.random.default_rng(4).integers(1, 200, 50_000).astype(np.uint8), np.uint8(0))
    store = Store(1000)
    order, common = sorted_suffixes(text, 20, 1000, store)
    assert (list(order), list(common)) == plain_sort(text.tobytes(), 20)
    assert sum(os.fstat(f.fileno()).st_size for f in store.files) < 60 * len(text)
    store.close()


@pytest.mark.parametrize("window, gram", [(30, 6), (12, 12), (50, 20)])
def test_byte_runs_of_many_texts(window, gram):
    """Texts cut together have the runs of each alone, for few calls; anchors found twice are those of a plain count."""
    r, units = random.Random(window), passages.Units(words=False, window=window, gram=gram)
    texts = [bytes(r.choices(b"ab" if i % 3 else b"abcdefghijklmnop", k=r.randrange(0, 3 * window))) for i in range(400)]
    texts += [b"a" * 700, b"xyz" * 300, b"", texts[7] * 3]
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    row, starts, sizes, anchors, hashes, _ = units.runs(texts)
    sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 8 * len(row) + 10 * len(texts)
    at = 0
    for i, text in enumerate(texts):
        n = int((row == i).sum())
        alone = units.runs([text])
        assert [x[at : at + n].tolist() for x in (starts, sizes, anchors, hashes)] == [x.tolist() for x in alone[1:5]]
        assert sizes[at : at + n].sum() == max(0, len(text) - window + 1)
        # The grams that are the least of a window, by their bytes.
        first = {}
        for s, size, anchor in zip(*(x[at : at + n].tolist() for x in (starts, sizes, anchors))):
            for w in range(s, s + size):
                grams = {p: text[p : p + gram] for p in range(w, w + window - gram + 1)}
                least = min(grams.values(), key=plain_hash)
                first.setdefault(anchor, set()).update(p for p, g in grams.items() if g == least)
        assert {a for a, places in first.items() if len(places) > 1} == set(alone[3][alone[5]].tolist())
        at += n
    assert at == len(row)


@functools.cache
def plain_hash(gram):
    h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(gram))
    x = (h + len(gram) * 0x9E3779B97F4A7C15) % (1 << 64)
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


@pytest.mark.parametrize("hot", [4096, 1, 0])
def test_words_removed(spark, hot):
    units, flags = repeated_units(words, 35)
    want = Counter()
    for row, u, f in zip(rows(), units, flags):
        kept = " ".join(w for w, gone in zip(u, f) if not gone)
        want[(row[0], len(u), sum(f), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert sum(k[2] for k in want) > 500
    got = fm_dedup.without_repeats(table(spark), shard_bytes=20_000, hot_segments=hot)
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("hot, memory", [(4096, 1 << 20), (1, 500)])
def test_bytes_removed(spark, hot, memory):
    units, flags = repeated_units(lambda t: (t or "").encode(), 200)
    want = Counter()
    for row, u, f in zip(rows(), units, flags):
        kept = bytes(b for b, gone in zip(u, f) if not gone)
        spans = sum(a and not b for a, b in zip(f, [False, *f]))
        want[(row[0], len(u), sum(f), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert sum(k[2] for k in want) > 2000
    got = suffix_dedup.without_repeated_bytes(table(spark), shard_bytes=8_000, hot_segments=hot, memory_rows=memory)
    assert Counter(map(tuple, got.collect())) == want


def test_rows_without_an_id_whose_short_hashes_agree(spark):
    """Texts with one 32-bit hash keep their own ranges, and equal rows share one list of them."""
    def known(i):
        return " ".join("w%d" % (i * 131 + j * j) for j in range(50))

    numbered = spark.range(300_000).selectExpr("id", "concat_ws(' ', transform(sequence(0, 49), j -> concat('w', cast(id * 131 + j * j AS string)))) AS text")
    pair = numbered.groupBy(F.hash("text").alias("h")).agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").orderBy("h").first()["ids"][:2]
    first, second = map(known, sorted(pair))
    data = [(None, first), (None, second + " end")] + [(None, second)] * 20 + [(1, "before " + first)]
    assert len({r[0] for r in spark.createDataFrame(data[:3:2], "d long, t string").select(F.hash("t")).collect()}) == 1
    got = fm_dedup.without_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    assert Counter((r["n_words"], r["n_removed"]) for r in got.collect()) == {(50, 50): 21, (51, 50): 2}
    units = passages.Units(words=True, window=35, gram=10)
    keyed, ranges = passages.repeated_ranges(spark.createDataFrame(data, "doc_id long, text string"), units, fm_dedup.find_repeats, 20_000)
    listed = passages.with_ranges(keyed, ranges).collect()
    assert all(len(set(map(tuple, r["ranges"]))) == len(r["ranges"]) for r in listed)


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_segments_whose_polynomial_hashes_agree(spark):
    # A Thue-Morse word and its complement of 1024 letters agree in every 64-bit polynomial hash;
    # segments are told apart by a digest of their bytes, so the unique middle word stays.
    x = _thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    shared_w = " ".join(f"w{i}" for i in range(40))
    shared_v = " ".join(f"v{i}" for i in range(40))
    data = [(1, f"{shared_w} {x} {shared_v}"), (2, f"{shared_w} {y} {shared_v}")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in fm_dedup.without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: (81, 80), 2: (81, 80)}
    raw = [(1, f"{'p' * 300}{x}{'q' * 300}"), (2, f"{'p' * 300}{y}{'q' * 300}")]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.without_repeated_bytes(spark.createDataFrame(raw, "doc_id long, text string")).collect()}
    texts = [t.encode() for _, t in raw]
    seen = {}
    for t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    expected = {}
    for (doc_id, _), t in zip(raw, texts):
        flags = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                flags[i : i + 200] = [True] * 200
        expected[doc_id] = sum(flags)
    assert got == expected


def test_removal_from_nothing(spark):
    assert fm_dedup.without_repeats(table(spark, [])).collect() == []
    assert suffix_dedup.without_repeated_bytes(table(spark, [])).collect() == []


def test_fm_index_counts(spark):
    r = np.random.default_rng(4)
    text = r.integers(1, 6, 400)
    index = fm_dedup.FMIndex(text, np.ones(len(text), np.int64))
    for _ in range(60):
        a = int(r.integers(0, 390))
        pattern = text[a : a + int(r.integers(1, 9))]
        low, high = np.array([0]), np.array([index.size])
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        count = sum(np.array_equal(text[i : i + len(pattern)], pattern) for i in range(len(text)))
        assert index.occurrences(low, high)[0] == count


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    smallest = {}
    for i, d in enumerate(ids):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return [smallest.get(find(i)) for i in range(len(prints))]


def test_near_duplicates(spark):
    prints = [plain_fingerprint(r[1]) for r in rows()]
    ids = [r[0] for r in rows()]
    want = Counter((d, f"{p:016x}", c) for d, p, c in zip(ids, prints, plain_components(prints, ids, 4)))
    assert Counter(map(tuple, simhash_links.near_duplicates(table(spark)).collect())) == want
    assert simhash_links.near_duplicates(table(spark, [])).collect() == []


def test_every_pair_in_the_radius_shares_a_bucket():
    r = random.Random(2)
    for radius in (1, 2, 4):
        masks = simhash_links.covering_masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            change = sum(1 << p for p in r.sample(range(64), radius))
            assert any(change & m == 0 for m in masks)


@pytest.mark.parametrize("direct", [4096, 3])
def test_links_of_dense_fingerprints(spark, direct):
    """Small limits on a bucket send it to the second covering; no link may be lost."""
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << p for p in r.sample(range(64), r.randrange(0, 7))) for b in base for _ in range(60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    found = simhash_links.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, direct)
    for a, b in found.collect():
        assert ((a ^ b) & simhash_links.ALL).bit_count() <= 4
    labels = {n: c for n, c in components(found).collect()}
    got = Counter(Counter(labels.get(p, p) for p in signed).values())
    want = Counter(Counter(plain_components(sorted(prints), list(range(len(prints))), 4)).values())
    assert got == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5)]
    labels = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert labels == {**{i: 0 for i in range(201)}, 999: 999, 1000: 999}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_segments_without_repeats_cost_few_steps(monkeypatch):
    """Backward search of segments whose shared words occur once ends after a few words; the flags are those of a plain count."""
    draw, window = random.Random(7), 35
    segments = [" ".join(draw.choices([f"w{i}" for i in range(300)], k=draw.randint(35, 60))).encode() for _ in range(400)]
    segments += [s.replace(b"w1 ", b"w2 ", 1) for s in segments[:50]] + [b" ".join(segments[60].split(b" ")[3:] + [b"new"] * 5)]
    segments, asked = [s for s in segments if len(s.split(b" ")) >= window], []
    weights = np.array([2 if i % 90 == 0 else 1 for i in range(len(segments))])
    rank = fm_dedup.WaveletTree.rank
    monkeypatch.setattr(fm_dedup.WaveletTree, "rank", lambda tree, symbol, at: (asked.append(len(symbol)), rank(tree, symbol, at))[1])
    found = fm_dedup.find_repeats(segments, weights, window)
    counts = {}
    for s, n in zip(segments, weights.tolist()):
        w = s.split(b" ")
        for i in range(len(w) - window + 1):
            counts[tuple(w[i : i + window])] = counts.get(tuple(w[i : i + window]), 0) + n
    for s, flags in zip(segments, found):
        w = s.split(b" ")
        assert flags.tolist() == [counts[tuple(w[i : i + window])] > 1 for i in range(len(w) - window + 1)]
    assert sum(asked) < 16 * len(segments) + 4 * 60 * sum(int(f.any()) for f in found)


def test_kept_words_are_joined_by_one_space_whatever_stood_between():
    from presslake.llm.passages import Units
    from presslake.llm.words import joined, word_bounds

    draw, units = random.Random(11), Units(words=True, window=3, gram=2)
    for _ in range(500):
        text = "".join(draw.choice(["a", "bb", "é", " ", " ", "  ", "\t", "\n"]) for _ in range(draw.randint(0, 40))).encode()
        starts, ends = word_bounds(text)
        words = [text[a:b] for a, b in zip(starts, ends)]
        keep = np.flatnonzero([draw.random() < 0.7 for _ in words])
        assert joined(text, starts, ends, keep) == b" ".join([words[i] for i in keep])
        ranges = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
        assert units.segments(text, ranges) == [b" ".join(words[i:j]) for i, j in ranges]
