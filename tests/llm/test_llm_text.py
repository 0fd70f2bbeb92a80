"""Encoded lengths, packed ids, quality ledger and WARC files against plain versions."""

import base64
import hashlib
import json
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_data import rows, table, words
from presslake.llm import packed_ids, quality_ledger, token_counts, warc
from presslake.llm.encoding import WHITE_SPACE, PieceEncoder, default_tokenizer, piece_bounds
from presslake.llm.packed_ids import PackedFile, bits_for, pack, unpack
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tokenizer():
    return PieceEncoder(default_tokenizer()).tokenizer


def test_pieces_give_the_ids_of_the_library(tokenizer):
    r = random.Random(3)
    texts = [row[1] for row in rows()] + ["we're it's don't'll", "a1b2 ½3a²5", "абв гд. аб", "\x1c!\x1c a\x85b", "<|endoftext|>x <|endoftext|>"]
    texts += ["".join(r.choice(" \n\tab '.,0½²é\xa0б漢<|>s-re") for _ in range(80)) for _ in range(400)]
    for kept in (50, 100_000):
        encoder = PieceEncoder(default_tokenizer(), kept)
        for at in range(0, len(texts), 37):
            part = texts[at : at + 37]
            ids, counts = encoder.encode(part)
            want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pieces_are_cut_in_arrays_as_a_pattern_cuts_them():
    latin, other = "A-Za-zÀ-ÖØ-öø-ɏ", "!-@\\[-`{-~"
    pattern = re.compile(f"[{WHITE_SPACE}]*[{latin}]+(?=[{WHITE_SPACE}{other}]|\\Z)|[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
    r = random.Random(5)
    texts = ["", *("".join(r.choice(WHITE_SPACE + "aZß×÷ÿɏɐб漢𝔸'0.<|>\0\x1c«“ ") for _ in range(r.randrange(40))) for _ in range(3000)), ""]
    data = b"\xff".join([b"", *(t.encode() for t in texts), b""])
    starts, ends, upto = piece_bounds(np.frombuffer(data, np.uint8))
    got = [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
    assert [got[a:b] for a, b in zip(upto.tolist(), upto[1:].tolist())] == [pattern.findall(t) for t in texts]


def test_known_short_pieces_are_no_python_objects():
    encoder, r = PieceEncoder(default_tokenizer()), random.Random(6)
    fresh = [" ".join({"".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(20_000)}) for _ in range(2)]
    encoder.encode(fresh[:1])
    held = sys.getallocatedblocks()
    encoder.encode(fresh[1:])
    assert encoder.encode(fresh[1:])[0].tolist() == encoder.tokenizer.encode(fresh[1], add_special_tokens=False).ids
    assert sys.getallocatedblocks() - held < 5_000


def test_histogram(spark, tokenizer):
    sizes = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in (r[1] for r in rows())]
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(table(spark)))
    got = {r["n_tokens"]: r for r in histogram.collect()}
    assert {k: r["n_docs"] for k, r in got.items()} == Counter(sizes)
    for limit, r in got.items():
        assert r["docs_from"] == sum(s >= limit for s in sizes) and r["tokens_from"] == sum(s for s in sizes if s >= limit)
        assert r["truncated_tokens"] == sum(min(s, limit) for s in sizes) and r["total_tokens"] == sum(sizes)
        assert r["rank_below"] == sum(s < limit for s in sizes) and r["total_docs"] == len(sizes)
    for limit in (0, 7, 100, 10**6):
        assert tuple(token_counts.truncated_total(histogram, limit).first()) == (limit, sum(min(s, limit) for s in sizes), sum(s > limit for s in sizes))
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        assert token_counts.length_quantile(histogram, q).first()[0] == sorted(sizes)[int(q * (len(sizes) - 1))]
    assert token_counts.length_histogram(token_counts.encoded_lengths(table(spark, []))).collect() == []


@pytest.mark.parametrize("vocabulary", [2, 3, 300, 32_000, 50_257, 1 << 17, 1 << 24])
def test_packing_round_trip(vocabulary):
    bits, r = bits_for(vocabulary), np.random.default_rng(1)
    assert 2**bits >= vocabulary > 2 ** (bits - 1)
    for n in (0, 1, 7, 8, 1000):
        ids = r.integers(0, vocabulary, n).astype("<u4")
        data = pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and np.array_equal(unpack(data, bits, n), ids)


@pytest.mark.parametrize("block_ids, shard_bytes", [(packed_ids.BLOCK_IDS, 1 << 20), (64, 4000)])
def test_packed_files(spark, tmp_path, tokenizer, block_ids, shard_bytes):
    folder = f"file://{tmp_path}/packed"
    manifest = packed_ids.write_packed(table(spark), folder, block_ids=block_ids, shard_bytes=shard_bytes)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for doc_id, text, *_ in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in packed_ids.read_packed(spark, folder).orderBy("start").collect()]
    assert got == want and (len(manifest) > 1) == (shard_bytes == 4000)
    for entry in manifest:
        data = (tmp_path / "packed" / entry["path"]).read_bytes()
        assert (len(data), zlib.crc32(data)) == (entry["n_bytes"], entry["crc32"])
    last = PackedFile(folder, manifest[-1]["path"])
    text = order[-1][1]
    assert last.document(len(last.doc_ids) - 1).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
    again = packed_ids.write_packed(table(spark).repartition(3), folder + "2", block_ids=block_ids, shard_bytes=shard_bytes)
    assert again == manifest
    assert not [p for p in (tmp_path / "packed").iterdir() if p.suffix == ".tmp"]


def test_packed_files_of_nothing(spark):
    assert packed_ids.packed_documents(table(spark, [])).collect() == []


def _measures(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(covered))


def test_ledger(spark):
    book = quality_ledger.judged(quality_ledger.ledger(table(spark)))
    got = Counter((r["doc_id"], *(r[m] for m in quality_ledger.MEASURES), r["base_failed"]) for r in book.collect())
    want = Counter()
    for doc_id, text, *_ in rows():
        m = _measures(text)
        want[(doc_id, *m, m[0] < 10 or 100 * m[5] > 20 * m[0])] += 1
    assert got == want
    for r in book.collect():
        values = {m: r[m] for m in quality_ledger.MEASURES}
        bits = sum(1 << i for i, (_, rule) in enumerate(quality_ledger.RULES) if eval(rule, {}, values))
        assert r["failures"] == bits and r["kept"] == (bits & quality_ledger.POLICIES[quality_ledger.CURRENT] == 0)
    assert quality_ledger.ledger(table(spark, [])).collect() == []


def test_ablations(spark):
    book = quality_ledger.ledger(table(spark))
    bits = [r["failures"] & quality_ledger.POLICIES[2] for r in book.collect()]
    for r in quality_ledger.ablations(book, 2).collect():
        bit = quality_ledger.BIT[r["rule"]]
        assert (r["failed"], r["only_this"], r["kept_without"]) == (
            sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


PAGES = [(i, f"http://e.com/{i}", h) for i, h in enumerate(["<p>a</p>", "b" * 3000, None, "", "<p>a</p>", "é\r\n\r\nx", "b" * 3000, "<p>a</p>", "z"])]
PAGES += [(4, "http://other/4", "<p>a</p>"), (4, "http://other/4", "<p>a</p>"), (None, None, "z"), (None, "u\nv", "only")]


@pytest.mark.parametrize("least, file_bytes, shard_bytes", [(0, 1 << 20, 1 << 20), (4, 300, 2000), (10**6, 1, 1 << 20)])
def test_warc_round_trip(spark, tmp_path, least, file_bytes, shard_bytes):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, mark string").repartition(4)
    folder = f"file://{tmp_path}/warc"
    warc.write_warc(pages, folder, least, file_bytes, shard_bytes)
    rank = lambda p: (p[0] is None, p[0] or 0, p[1] or "")
    want, first = [], {}
    for p in sorted(PAGES, key=rank):
        data = (p[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = len(data) >= least and data in first
        want.append((p[0], len(data), digest, "revisit" if revisit else "response", first[data] if revisit else None))
        first.setdefault(data, p[0])
    got = [tuple(r) for r in warc.read_warc(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    manifest = json.loads((tmp_path / "warc/manifest.json").read_text())
    assert sum(e["records"] for e in manifest) == len(PAGES) and {e["path"] for e in manifest} | {"manifest.json"} == {
        p.name for p in (tmp_path / "warc").iterdir() if not p.name.endswith(".crc")}
    if file_bytes == 1:
        assert all(e["records"] == 1 for e in manifest)
    warc.write_warc(pages.repartition(2), folder + "2", least, file_bytes, shard_bytes)
    assert json.loads((tmp_path / "warc2/manifest.json").read_text()) == manifest


def test_warc_damage_is_found(spark):
    raw = warc.record(1, "http://a", b"payload")
    assert warc._parsed(raw)[:2] == (1, 7)
    with pytest.raises(ValueError):
        warc._parsed(raw.replace(b"payload", b"paYload"))


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_pages(empty).collect() == []


def test_ledger_has_no_python(spark):
    plan = quality_ledger.judged(quality_ledger.ledger(table(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None
