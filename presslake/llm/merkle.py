"""Merkle manifest of a table of documents, proved by octopus multiproofs per block of leaves.

Each row is a leaf: H of its fields. Leaves of one lang, ascending by doc_id, make one tree in
which every run of ``FANOUT`` consecutive nodes (the last run may be shorter, even one) becomes
the H of their hex digests, level by level, until one node, the lang's subroot, is left. The
subroots, ordered by lang (null first, bytewise), make the top tree the same way; its last node is
the root. H is the lowercase hex SHA-256 of its inputs concatenated (digests as hex text).

Spark builds the levels: each level is a ``groupBy`` on (tree, index / 8) of the level below and
is written out, so a level is one shuffle of a table eight times smaller than the last one.

Proofs (octopus multiproof): leaves are dealt in blocks of ``FANOUT ** BLOCK_HEIGHT`` consecutive
leaves of one tree, the leaves under one node of level ``BLOCK_HEIGHT``. A block can derive all
interior nodes below that node from its own leaves; what it lacks is the minimal union of node
coordinates its proofs need beyond that: the siblings of its ancestors in the lang tree and of
the lang's subroot in the top tree, at most 7 per level. These coordinates are generated as a
table, fetched once per block by one join with the levels, and the block (a bounded group of a
``cogroup``) derives its shared interiors and expands every leaf's proof locally.

Per row: ``proof_sha256`` is H of all siblings of the leaf's path (the other members of its run
at each level, left to right, from the leaves through the subroot up to the root). Rows where 3
divides the unsigned CRC-32 of the decimal doc_id are tampered: A-Z of the text lower-cased
(null text and null doc_id: not tampered). ``folded_root`` folds the tampered (else the original)
leaf with the original siblings; ``verified`` says whether it equals ``root``.

Edge cases: nulls in any field are ``-`` in the leaf; a null lang is a tree of its own, first in
the top tree; null doc_ids come first in their tree, rows that tie on doc_id are ordered by leaf
(equal leaves are equal rows, so their order does not matter); repeated rows are leaves each; a
tree of one leaf has that leaf as subroot and a top tree of one subroot has it as root; an empty
table gives no rows; very long texts only enter the leaf's SHA-256; other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.ranks import positions
from presslake.llm.staging import ready_for_python, small_side, written

FANOUT = 8
#: Leaves of a block: the subtree under one node of this level (8**4 = 4096 leaves).
BLOCK_HEIGHT = 4
#: Fixed: the fields of a leaf, in this order.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Fixed: letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OUT = "doc_id long, lang string, position long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """H of doc_id, source, lang, n_chars and ``text``: ``-`` for null, else byte count, ``:``, value."""
    fields = [F.col(c) for c in LEAF_FIELDS[:-1]] + [text]
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def tampered_text() -> Column:
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return F.when(chosen, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def _heights(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: the least h with 8**h >= n, from the bit
    length of n - 1, so that it is exact at any size."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.floor((F.length(F.bin(n - 1)) + 2) / 3).cast("int"))


def build_levels(level0: DataFrame, sizes: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Interior nodes (tree, level, idx, digest) above ``level0`` (tree, idx, digest), and the top
    (tree, digest) of every tree; ``sizes`` (tree, n) counts the leaves of each tree."""
    largest = sizes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [level0.join(small_side(sizes.where("n = 1").select("tree")), "tree").select("tree", "digest")]
    current, counts, level = level0, sizes, 0
    while largest > 1:
        level += 1
        going = small_side(counts.where("n > 1").select("tree"))
        run = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        parents = (current.join(going, "tree").groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx"))
                   .agg(F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest")))
        current = written(parents, f"{label}-level{level}")
        counts = counts.where("n > 1").select("tree", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
        levels.append(current.withColumn("level", F.lit(level)))
        tops.append(current.join(small_side(counts.where("n = 1").select("tree")), "tree").select("tree", "digest"))
        largest = (largest + FANOUT - 1) // FANOUT
    empty = level0.sparkSession.createDataFrame([], "tree long, idx long, digest string, level int")
    nodes = empty
    for part in levels:
        nodes = nodes.unionByName(part)
    top = tops[0]
    for part in tops[1:]:
        top = top.unionByName(part)
    return nodes, top


def _siblings(start: DataFrame, sizes: DataFrame, phase: int) -> DataFrame:
    """Coordinates a path needs: for rows (key…, tree, h, from_level, from_idx), the other members of
    the ancestor's run at each level from ``from_level`` to ``h - 1``; sizes (tree, level, n)."""
    steps = start.where(F.col("h") > F.col("from_level")).withColumn("level", F.explode(F.sequence("from_level", F.col("h") - 1)))
    own = F.expr("shiftright(from_idx, 3 * (level - from_level))")
    steps = steps.withColumn("own", own).join(small_side(sizes), ["tree", "level"])
    first = F.col("own") - F.pmod(F.col("own"), F.lit(FANOUT))
    steps = steps.withColumn("idx", F.explode(F.sequence(first, F.least(first + FANOUT - 1, F.col("n") - 1))))
    return steps.where(F.col("idx") != F.col("own")).withColumn("phase", F.lit(phase))


def _level_sizes(sizes: DataFrame, height: Column) -> DataFrame:
    """(tree, level, n) for every level of every tree."""
    levels = sizes.withColumn("h", height).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("h"))))
    n = F.ceil(F.col("n") / F.pow(F.lit(float(FANOUT)), F.col("level"))).cast("long")
    return levels.select("tree", "level", n.alias("n"))


def manifest(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, position in its tree, leaf, subroot, root, proof_sha256,
    folded_root and verified (see the module's description)."""
    spark = documents.sparkSession
    docs = documents.select(*[F.col(c) for c in LEAF_FIELDS])
    docs = docs.select("doc_id", "lang", leaf_digest(F.col("text")).alias("leaf"), leaf_digest(tampered_text()).alias("tampered"))

    # Trees: one per lang, numbered by lang (null first, bytewise) as leaves of the top tree.
    langs = positions(docs.select("lang").distinct().withColumn("_all", F.lit(0)), "_all", [F.col("lang").asc_nulls_first()],
                      name="tree", label="merkle-langs").select("lang", "tree")
    leaves = positions(docs.join(small_side(langs), docs["lang"].eqNullSafe(langs["lang"])).drop(langs["lang"]), "tree",
                       [F.col("doc_id").asc_nulls_first(), F.col("leaf")], name="idx", label="merkle-leaves")
    sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")

    nodes, subroots = build_levels(leaves.select("tree", "idx", F.col("leaf").alias("digest")), sizes, "merkle")
    subroots = written(subroots.join(langs.select("tree"), "tree"), "merkle-subroots")
    top_leaves = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    top_size = top_leaves.groupBy("tree").agg(F.count("*").alias("n"))
    top_nodes, root = build_levels(top_leaves, top_size, "merkle-top")
    all_nodes = nodes.unionByName(top_leaves.withColumn("level", F.lit(0))).unionByName(top_nodes)

    # The minimal union of coordinates each block lacks: lang-tree part, then top-tree part.
    heights = sizes.select("tree", _heights(F.col("n")).alias("h"))
    blocks = leaves.select("tree", F.shiftright("idx", 3 * BLOCK_HEIGHT).alias("block")).distinct().join(small_side(heights), "tree")
    blocks = blocks.withColumn("from_level", F.least(F.col("h"), F.lit(BLOCK_HEIGHT))).withColumn("from_idx", F.col("block"))
    sizes_all = _level_sizes(sizes, _heights(F.col("n"))).unionByName(_level_sizes(top_size, _heights(F.col("n"))))
    in_tree = _siblings(blocks, sizes_all, 0).select("tree", "block", "phase", "level", "idx")
    top_start = heights.select(F.col("tree").alias("lang_tree"), F.lit(-1).cast("long").alias("tree"), F.lit(0).alias("from_level"),
                                F.col("tree").alias("from_idx"))
    top_start = top_start.join(small_side(top_size.select("tree", _heights(F.col("n")).alias("h"))), "tree")
    in_top = _siblings(top_start, sizes_all, 1).select("lang_tree", "tree", "phase", "level", "idx")
    in_top = blocks.select(F.col("tree").alias("lang_tree"), "block").join(in_top, "lang_tree")
    wanted = in_tree.select(F.col("tree").alias("lang_tree"), "block", "tree", "phase", "level", "idx").unionByName(in_top)
    fetched = wanted.join(all_nodes, ["tree", "level", "idx"])
    path = fetched.groupBy(F.col("lang_tree").alias("tree"), "block").agg(
        F.sort_array(F.collect_list(F.struct("phase", "level", "idx", "digest"))).alias("path"))
    # Root and height of the top tree for every lang tree, joined on the top tree's id (-1).
    top_info = (heights.select(F.col("tree").alias("lang_tree"), F.lit(-1).cast("long").alias("tree"))
                .join(small_side(root.select("tree", F.col("digest").alias("root"))), "tree")
                .join(small_side(top_size.select("tree", _heights(F.col("n")).alias("top_h"))), "tree")
                .select(F.col("lang_tree").alias("tree"), "root", "top_h"))
    upper = (blocks.select("tree", "block", "h").join(path, ["tree", "block"], "left")
             .join(small_side(subroots.withColumnRenamed("digest", "subroot")), "tree")
             .join(small_side(top_info), "tree"))
    upper = written(upper, "merkle-paths")

    ready_for_python(spark)
    grouped = leaves.withColumn("block", F.shiftright("idx", 3 * BLOCK_HEIGHT))
    return (grouped.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
            .applyInPandas(_prove, OUT))


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _fold(digest: str, start: int, levels: int, runs: dict[int, list[tuple[int, str]]], first_level: int) -> str:
    """``digest`` at index ``start`` of ``first_level`` hashed with the sibling runs up ``levels`` levels."""
    for j in range(first_level, first_level + levels):
        own = start >> (FANOUT.bit_length() - 1) * (j - first_level)
        run = sorted(runs.get(j, []) + [(own, digest)])
        digest = _h("".join(d for _, d in run))
    return digest


def _prove(key: tuple, leaves: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
    if leaves.empty or upper.empty:
        return pd.DataFrame(columns=OUT_COLUMNS)
    tree, block = int(key[0]), int(key[1])
    info = upper.iloc[0]
    h, top_h = int(info["h"]), int(info["top_h"])
    local_height = min(h, BLOCK_HEIGHT)
    path = list(info["path"]) if info["path"] is not None else []
    runs_tree: dict[int, list[tuple[int, str]]] = {}
    runs_top: dict[int, list[tuple[int, str]]] = {}
    for phase, level, idx, digest in ((p["phase"], p["level"], p["idx"], p["digest"]) for p in path):
        (runs_tree if phase == 0 else runs_top).setdefault(int(level), []).append((int(idx), digest))
    upper_text = "".join(d for runs in (runs_tree, runs_top) for j in sorted(runs) for _, d in sorted(runs[j]))

    leaves = leaves.sort_values("idx", kind="stable")
    base = block << 3 * local_height
    local = (leaves["idx"].to_numpy() - base).tolist()
    # Shared interiors of the block: every level up to its top node.
    level_nodes = [dict(zip(local, leaves["leaf"]))]
    for _ in range(local_height):
        below, above = level_nodes[-1], {}
        for k in sorted({i // FANOUT for i in below}):
            above[k] = _h("".join(below[i] for i in range(k * FANOUT, k * FANOUT + FANOUT) if i in below))
        level_nodes.append(above)

    proofs, folded, rooted = [], [], []
    for i, leaf, changed in zip(local, leaves["leaf"], leaves["tampered"]):
        own_siblings, folds = [], {leaf: None, changed: None}
        for j in range(local_height):
            k = i >> 3 * j
            first = k - k % FANOUT
            own_siblings.extend(level_nodes[j][m] for m in range(first, first + FANOUT) if m != k and m in level_nodes[j])
        proofs.append(hashlib.sha256(("".join(own_siblings) + upper_text).encode()).hexdigest())
        for start in folds:
            digest = start
            for j in range(local_height):
                k = i >> 3 * j
                first = k - k % FANOUT
                digest = _h("".join(digest if m == k else level_nodes[j][m] for m in range(first, first + FANOUT) if m in level_nodes[j]))
            digest = _fold(digest, block, h - local_height, runs_tree, local_height)
            folds[start] = _fold(digest, tree, top_h, runs_top, 0)
        if folds[leaf] != info["root"]:
            raise AssertionError(f"the path of leaf {leaf} in tree {tree} does not lead to the root")
        folded.append(folds[changed])
        rooted.append(folds[changed] == info["root"])
    return pd.DataFrame({
        "doc_id": leaves["doc_id"].astype("Int64"), "lang": leaves["lang"], "position": leaves["idx"].astype("int64"),
        "leaf": leaves["leaf"], "subroot": info["subroot"], "root": info["root"], "proof_sha256": proofs,
        "folded_root": folded, "verified": rooted,
    })


OUT_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
