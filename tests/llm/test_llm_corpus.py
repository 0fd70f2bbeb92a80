"""Mixing, toxicity, decontamination and the pipeline."""

import os
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm_data import WORD, prose, rows, table, words
from oracle_check import connect, difference
from presslake.llm import contamination, mixing, queries, toxicity
from presslake.llm.oracles import oracle_sql
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, wanted = set(), share * sum(sizes.values())
    while len(full) < len(order):
        level = (wanted - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > most * sizes[s]}
        if not over:
            break
        full |= over
    return {s: most * sizes[s] if s in full else level * weight[s] for s in order}


def test_mixing(spark):
    sizes, data = defaultdict(int), rows()
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    targets = plain_targets(sizes, mixing.WEIGHTS, 1.5, 2)
    got = mixing.mixed(table(spark)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in data)
    taken, by_size = defaultdict(int), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        by_size[round(r["target"], 6)] = taken[round(r["target"], 6)] = taken[round(r["target"], 6)] + r["taken"]
    assert sorted(by_size) == sorted({round(t, 6) for t in targets.values()})
    smallest = min(len(words(r[1])) for r in data if words(r[1]))
    assert all(abs(words_taken - target) <= max(smallest, 0.05 * target) for target, words_taken in taken.items())
    again = mixing.mixed(table(spark).repartition(2)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert mixing.mixed(table(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_fitted_counts(seed):
    r = np.random.default_rng(seed)
    lengths = r.choice(np.arange(1, [40, 900, 30_000][seed % 3]), 35, replace=False)
    counts = r.integers(1, [3, 4000][seed % 2], 35)
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 7, total // 2, total - 1, total):
        k = mixing.fit_counts(lengths, counts, budget)
        assert np.all((k >= 0) & (k <= counts)) and (lengths * k).sum() <= budget
        if seed % 2 and budget > total // 10:
            assert budget - (lengths * k).sum() <= max(lengths.min(), budget // 1000)


@pytest.mark.parametrize("lengths, counts, budget", [
    (np.arange(1, 401), np.full(400, 2), 155_000),  # more lengths than the knapsack once used
    (np.array([1]), np.array([100_000]), 90_000),  # more documents of one length
    (np.array([2, 3]), np.array([60_000, 60_000]), 200_001),
    (np.arange(2, 3000, 2), np.full(1499, 1), 2_000_001),  # odd: one word below is the closest
    (np.array([400_000, 300_000, 5]), np.array([1, 1, 2]), 350_003),  # documents longer than the fitted part
])
def test_fit_uses_all_that_is_left(lengths, counts, budget):
    k = mixing.fit_counts(lengths, counts, budget)
    assert np.all((k >= 0) & (k <= counts))
    short = {2_000_001: 1, 350_003: 50_003 - 10}.get(budget, 0)
    assert budget - (lengths * k).sum() == short


def test_hot_lengths_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    docs = spark.createDataFrame([(i, "a b c", "s") for i in range(100)] + [(i, "a b", "t") for i in range(100, 130)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, weights=(1.0, 2.0)).collect()
    assert all(r["copies"] in (1, 2) for r in got)
    for source in ({r["target"]: 0 for r in got}):
        assert abs(sum(r["taken"] for r in got if r["target"] == source) - source) <= 3


def test_contained_items(spark):
    r = random.Random(5)
    items = [(i, prose(r, n)) for i, n in enumerate([5, 6, 9, 14, 20, 33, 60, 130])] + [(90, None), (91, " "), (92, "Only three Words"), (93, prose(r, 12)), (93, prose(r, 12))]
    docs = []
    for i, (_, text) in enumerate(items):
        w = (text or "").split()
        docs.append((i, prose(r, 400) + "\n " + " \t".join(w).upper() + " " + prose(r, 500)))
        docs.append((100 + i, prose(r, 70) + " " + " ".join(w[: max(len(w) * 19 // 20, 5)]) + " " + prose(r, 7)))
        docs.append((200 + i, prose(r, 40) + " " + " ".join(w[: len(w) // 2]) + " " + prose(r, 40)))
    docs += [(300, None), (301, ""), (None, items[4][1]), (5, items[4][1]), (5, items[4][1])]
    want = Counter()
    for doc_id, text in docs:
        w = (text or "").encode().lower().split()
        for item_id, item in items:
            q = (item or "").encode().lower().split()
            n = min(5, len(q))
            if n:
                wanted = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)}
                shared = len(wanted & {tuple(w[j : j + n]) for j in range(len(w) - n + 1)})
                if shared >= 0.8 * len(wanted):
                    want[(doc_id, item_id, shared, len(wanted))] += 1
    assert len(want) > 12
    table_ = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, shared string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, contamination.contained_items(table_, benchmark).collect())) == want
    clean = contamination.without_items(table_, benchmark)
    assert clean.columns == table_.columns
    left = Counter((r["doc_id"], r["text"]) for r in clean.collect())
    leaks = {k[0] for k in want}
    assert left.items() <= Counter(docs).items() and all(d in leaks for d, _ in (Counter(docs) - left))
    assert contamination.contained_items(clean, benchmark).collect() == []
    assert contamination.contained_items(table_, benchmark.limit(0)).collect() == []
    assert contamination.contained_items(table_.limit(0), benchmark).collect() == []


def test_items_of_few_shingles_are_never_missed():
    """One and two shingles, and repeated words, in documents of which one domain holds them."""
    r = random.Random(12)
    items = [(i, " ".join("q%d" % r.randrange(10**6) for _ in range(5 + i % 2))) for i in range(600)]
    items += [(600 + i, " ".join(["r%d" % i] * 54)) for i in range(200)]
    index = contamination.ItemIndex([(i, t.encode()) for i, t in items])
    texts = [(t + " " + prose(r, 60)).encode() for _, t in items]
    assert [(at, i) for at, i, *_ in index.matches(texts, 0.8)] == [(i, i) for i, _ in items]


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PASS_ITEMS", 2)
    r = random.Random(6)
    items = [(i, prose(r, 15)) for i in range(5)]
    docs = spark.createDataFrame([(i, prose(r, 50) + " " + t) for i, t in items], "doc_id long, text string")
    found = contamination.contained_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((x["doc_id"], x["item_id"]) for x in found.collect()) == [(i, i) for i in range(5)]


def labelled(spark, n=900):
    r, docs, labels = random.Random(8), [], []
    for i in range(n):
        w, bad = prose(r, 60).split(), i % 6 == 0
        if bad:
            for word in r.sample(["zurk", "blarg", "FLEEM", "vexa%d" % r.randrange(999), "vexa%d" % r.randrange(999)], 3):
                w.insert(r.randrange(len(w)), word)
        docs.append((i, " ".join(w)))
        if i % 10 < 9:
            labels.append((i, 1, int(bad)))
    docs += [(5000, None), (5001, ""), (None, "you zurk blarg"), (0, docs[0][1])]
    labels += [(None, 1, 1), (7777, 1, None), (0, 1, 1)]
    return (spark.createDataFrame([(*d, "x", 2.0) for d in docs], "doc_id long, text string, toxic string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, data = labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in data)
    right = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["held_out"] and r["doc_id"] < 900:
            right.append(r["predicted"] == int(r["doc_id"] % 6 == 0))
    assert np.mean(right) >= 0.97
    assert {r["predicted"] for r in got if r["doc_id"] in (5000, 5001)} == {0}
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]


def test_toxicity_without_labels_or_rows(spark):
    docs, labels, _ = labelled(spark, 30)
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_clauses_of_the_grammar():
    grammar = toxicity.Grammar({"zurk": 4.0, "blar*": 4.0})
    assert grammar.clauses("You are a ZURK, it is blargish. A zurks zurk!") == {"insult_targeted": 1, "insult": 3}
    assert grammar.clauses("not a zurk; he said \"blarg\" today") == {"insult": 2, "insult_negated": 1, "insult_reported": 1}
    assert grammar.clauses("I will hurt you. They never hurt you. hurt feelings") == {"threat": 2, "threat_held_back": 1}
    assert grammar.clauses("blar azurk zurky " + "word " * 300) == {}


def test_learned_weights_and_order_count():
    grammar = toxicity.Grammar({"zurk": 6.0, "blarg": 2.0})
    strong, weak = (grammar.features(f"a {word} here") for word in ("zurk", "blarg"))
    assert strong[0] == 3 * weak[0] > 0
    assert list(grammar.paths("you blarg zurk")) == [{"insult": 2.0, "insult_targeted": 2.0}]
    # A quote that is closed, or opened after the harm, does not report it.
    assert grammar.clauses("he said \"hello\" to the zurk") == {"insult": 1, "insult_targeted": 1}
    assert grammar.clauses("one wrote zurk on \"paper\"") == {"insult": 1}


def _copies(spark, n, tmp_path):
    docs, labels, _ = labelled(spark, n)
    extra = spark.createDataFrame([r[:5] for r in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    extra = extra.withColumn("doc_id", F.col("doc_id") + 10_000)
    all_docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"))
    all_docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    r = random.Random(9)
    spark.createDataFrame([(0, prose(r, 15)), (1, rows()[2][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")


def test_pipeline_stages(spark, tmp_path):
    _copies(spark, 600, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.written(stage(spark, steps[-1], str(tmp_path)), f"test-{name}"))
        if name != "token_ids":
            assert steps[-1].columns == corpus_pipeline.COLUMNS
    ids = [Counter(r["doc_id"] for r in s.select("doc_id").collect()) for s in steps]
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
    # Of the three rows without an id, one is toxic.
    assert {**{k: v for k, v in ids[0].items() if k not in toxic}, None: ids[0][None] - 1} == ids[1] and None in toxic
    from presslake.llm.simhash_links import near_duplicates
    whole = [Counter(tuple(r) for r in s.select(corpus_pipeline.COLUMNS).collect()) for s in steps[:5]]
    # Near duplicates: whole rows of the stage before, one in each component of its rows.
    numbered = steps[1].withColumn("row", F.monotonically_increasing_id())
    groups = near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    component = {tuple(r[c] for c in corpus_pipeline.COLUMNS): r["component_id"] for r in numbered.join(groups, "row").collect()}
    assert not whole[2] - whole[1] and set(whole[2].values()) == {1}
    assert sorted(component[row] for row in whole[2]) == sorted(set(component.values()))
    leaks = {r["doc_id"] for r in contamination.contained_items(steps[2], spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert set(ids[2]) - set(ids[3]) == leaks and leaks
    # Mixing: whole rows of the stage before; the words the mix takes do not depend on which rows.
    assert not set(whole[4]) - set(whole[3])
    words = sum(n * len(WORD.findall(row[1] or "")) for row, n in whole[4].items())
    assert words == sum(r["taken"] for r in mixing.mixed(steps[3]).collect())
    assert words > 0 and ids[5] == ids[4]
    assert sum(r["n_tokens"] for r in steps[5].collect()) > 0


def test_pipeline_keeps_whole_rows(spark, tmp_path):
    """Rows that share an id but not a text, copies under another id, rows without an id, and one
    text under two sources: decided row by row."""
    text_a, text_b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    text_c = " ".join(f"gamma{i}" for i in range(60))
    data = [(3, text_a, "en", "s", 1), (7, text_a, "en", "s", 1), (7, text_b, "en", "s", 1), (None, text_c, "en", "s", 1), (None, text_c, "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept == sorted([data[0], data[2], data[3]], key=str)
    pair = [(1, text_a, "en", "s", 1), (1, text_a, "de", "t", 1)]
    mixed_rows = corpus_pipeline.to_target_weights(spark, spark.createDataFrame(pair, docs.schema), str(tmp_path)).collect()
    assert {tuple(r) for r in mixed_rows} <= set(pair) and {r["source"] for r in mixed_rows} == {"s", "t"}


def test_pipeline_of_nothing(spark, tmp_path):
    _copies(spark, 6, tmp_path)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_return_a_row_each(spark, name):
    got = queries.queries()[name](spark, SF_DIR)
    if name.startswith("op12"):  # one row a conversation
        source = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id").distinct().count()
    else:
        source = spark.read.parquet(f"{SF_DIR}/{'pages' if name.startswith('op6') else 'documents'}.parquet").count()
    assert got.count() == source or name.startswith(("op1_", "op4_"))


@needs_tables
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF_DIR), connect(SF_DIR), oracle_sql()[name]) == ""


def test_contained_items_recall_against_all_pairs(spark):
    """Recall measured against brute force over every (document, item) pair: items of 14 to 120
    words planted whole, with words changed (containment near 0.8) or in two pieces 600 words
    apart, inside documents of 2,000 to 6,000 words. No pair at or above 0.8 may be missed,
    none below reported."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(6000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(14, 120)))) for i in range(400)]
    docs = []
    for d in range(200):
        body = [r.choice(vocabulary) for _ in range(r.randint(2000, 6000))]
        for item_id, text in r.sample(items, 3):
            w = text.split()
            kind, at = r.randrange(3), r.randrange(len(body))
            if kind == 1:  # a word changed every ~25 words: about 0.8 of the shingles stay
                w = [x if (k + 1) % 25 else "changed" for k, x in enumerate(w)]
            if kind == 2:  # two halves far apart
                body[at:at] = w[len(w) // 2:]
                body[max(0, at - 600):max(0, at - 600)] = w[: len(w) // 2]
            else:
                body[at:at] = w
        docs.append((d, " ".join(body)))

    def grams(text):
        w = text.lower().split()
        return {" ".join(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}

    item_grams = {i: grams(t) for i, t in items}
    holders = defaultdict(set)
    for i, g in item_grams.items():
        for s in g:
            holders[s].add(i)
    truth = set()
    for d, text in docs:
        shared = Counter(i for s in grams(text) for i in holders.get(s, ()))
        truth |= {(d, i) for i, n in shared.items() if n >= 0.8 * len(item_grams[i])}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(row.doc_id, row.item_id) for row in contamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    missed, extra = truth - found, found - truth
    print(f"recall: {len(truth) - len(missed)} of {len(truth)} pairs found, {len(extra)} reported below 0.8")
    assert len(truth) > 300 and not missed and not extra


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_take_very_long_null_and_empty_texts(spark, tmp_path, name):
    """Every registered query over the small tables plus a document and a page of about 1 MB,
    a conversation turn of about 1 MB, and null and empty texts: one row a document (a page,
    a conversation), no failure. Token counts and contamination give their own shapes."""
    r = random.Random(3)
    long_text = prose(r, 170_000)
    assert len(long_text) > 1_000_000
    extra = {
        "documents": [(10**9, long_text, "en", "web", len(long_text)), (10**9 + 1, None, None, None, None), (10**9 + 2, "", "en", "web", 0)],
        "pages": [(10**9, "http://long.example/", "<html><body><p>" + long_text + "</p></body></html>"), (10**9 + 1, None, None), (10**9 + 2, "", "")],
        "conversations": [(10**9, 1, "user", long_text), (10**9, 2, "assistant", None), (10**9 + 1, None, None, "")],
        "labels": [], "benchmark": [],
    }
    for table, rows_ in extra.items():
        given = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
        given.unionByName(spark.createDataFrame(rows_, given.schema)).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = queries.queries()[name](spark, str(tmp_path)).count()
    if name.startswith("op6"):
        assert got == spark.read.parquet(str(tmp_path / "pages.parquet")).count()
    elif name.startswith("op12"):
        assert got == spark.read.parquet(str(tmp_path / "conversations.parquet")).select("conv_id").distinct().count()
    elif not name.startswith(("op1_", "op4_")):
        assert got == spark.read.parquet(str(tmp_path / "documents.parquet")).count()
