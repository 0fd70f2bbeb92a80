"""Repair of conversation structure: the cheapest edits that make the roles of a conversation
follow ``(s?(ua)+)?`` (system, then user and assistant in turn), found by depth-first
branch-and-bound.

Spark does everything that is per row or per pair of rows: damage, order, faults, illegal pairs,
counts, gaps, and at the end the hash of the repaired text. The search reads only two small
codes per row (role initial, fault); texts never enter it.

Faults (after damage, rows of a conversation by turn, nulls first; rows of one turn by role and
text): ``blank`` (no character outside space, tab, line feed, vertical tab, form feed, carriage
return), ``duplicate`` (role and text seen in an earlier row), ``truncated`` (the last such
character is not ``.``, ``!`` or ``?``); each row counts its first fault.

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit for blank and
duplicate rows), Insert an empty user or assistant row 2 anywhere; a truncated row that is not
deleted adds 1. The audit string is the edits' initials in order (D, I, K, R); among edits of the
least cost the ASCII-least audit wins.

The search (``repair``): an explicit stack of prefixes (row, automaton state, cost, parent,
edit); children are pushed so that they are popped in ASCII order of their initial. The suffix
lower bounds are the least costs from each (row, state) to an accepted end, computed backwards
over the rows (with inserts relaxed per row). The first incumbent (cost, audit) comes from a dive
along the bounds; the depth-first search then cuts a prefix whose cost plus bound exceeds the
incumbent's cost, or equals it while its audit is already ASCII-greater than the incumbent's, and
a prefix whose (row, state) the dominance table shows reached no dearer by a prefix met earlier
(which is ASCII-less, as two prefixes of one (row, state) never differ only by an ending). A
complete script replaces the incumbent if cheaper or of equal cost and ASCII-less. As the bounds
are exact, the search proves optimality along one path and visits O(4 n) prefixes.

Damage: null conv_id, turn, role and text are one space where they are written out; a row's code is
the unsigned CRC-32 of ``conv_id:turn`` modulo 20: 0 drops it, 1 empties its text, 2 removes its
``.!?``, 3 repeats it (same turn), 4 makes its role ``user``.

Edge cases: a conversation with no rows after damage has zeros, an empty audit and the hash of
the empty string (so has one whose rows are all deleted); roles other than system, user and
assistant (also a space for null, or an empty role) have initials that never keep; very long texts
are only read by Spark expressions and the streaming hash; repeated rows are rows each; extra input
columns are ignored. A conversation's codes are one group (two bytes a row) and its audit one
string, as long as its rows: the result asks for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.ranks import positions
from presslake.llm.staging import ready_for_python, written

#: Fixed: edit costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Fixed: legal pairs of adjacent role initials.
LEGAL_PAIRS = ("su", "ua", "au")
#: Blank, duplicate, truncated; 0: no fault.
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"

# Automaton of (s?(ua)+)?: state 0 start, 1 after system, 2 after user, 3 after assistant.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role a rerole or an insert gives in each state.
EXPECTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
ACCEPTED = (0, 3)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text (nulls of role and text as one space)."""
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_code", F.pmod(F.crc32(key.cast("binary")), F.lit(20)))
    rows = rows.where("_code <> 0").withColumn("_copy", F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = (F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    role = F.when(F.col("_code") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def _last_character(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their place ``pos`` in the conversation, role ``initial`` and first ``fault``."""
    placed = positions(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], label="conversation-rows")
    first = placed.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t")).agg(F.min("pos").alias("_first"))
    seen = placed.join(first, placed["conv_id"].eqNullSafe(first["_c"]) & (placed["role"] == first["_r"]) & (placed["text"] == first["_t"]))
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    fault = (F.when(blank, BLANK).when(F.col("pos") > F.col("_first"), DUPLICATE)
             .when(~_last_character(F.col("text")).isin(".", "!", "?"), CUT).otherwise(0))
    initial = F.coalesce(F.nullif(F.substring("role", 1, 1), F.lit("")), F.lit(" "))
    return written(seen.select(*rows.columns, "pos", initial.alias("initial"), fault.alias("fault")), "conversation-faults")


def repair(initials: list[str], fault: list[int]) -> tuple[int, str, list[tuple[str, str]]]:
    """Least cost, ASCII-least audit, and the script: per edit (initial, role of the row it makes or
    keeps; empty for a delete), in order."""
    n = len(initials)
    # Suffix lower bounds: least cost from (row i, state s) to an accepted end.
    after = [STEP[(s, EXPECTED[s][0])] for s in range(4)]
    bound = [None] * (n + 1)
    bound[n] = [0 if s in ACCEPTED else INSERT * (2 if s == 1 else 1) for s in range(4)]
    for i in range(n - 1, -1, -1):
        cut = TRUNCATED if fault[i] == CUT else 0
        below, here = bound[i + 1], []
        for s in range(4):
            best = DELETE + below[s]
            if fault[i] not in (BLANK, DUPLICATE):
                kept = STEP.get((s, initials[i]))
                if kept is not None:
                    best = min(best, KEEP + cut + below[kept])
                best = min(best, REROLE + cut + below[after[s]])
            here.append(best)
        for _ in range(4):
            here = [min(here[s], INSERT + here[after[s]]) for s in range(4)]
        bound[i] = here

    def children(node: tuple) -> list[tuple]:
        """Child prefixes in ASCII order of their edit: D, I, K, R."""
        i, s, cost = node[0], node[1], node[2]
        out = []
        if i < n:
            out.append((i + 1, s, cost + DELETE, node, "D", ""))
        out.append((i, STEP[(s, EXPECTED[s][0])], cost + INSERT, node, "I", EXPECTED[s]))
        if i < n and fault[i] not in (BLANK, DUPLICATE):
            cut = TRUNCATED if fault[i] == CUT else 0
            kept = STEP.get((s, initials[i]))
            if kept is not None:
                out.append((i + 1, kept, cost + KEEP + cut, node, "K", ""))
            out.append((i + 1, STEP[(s, EXPECTED[s][0])], cost + REROLE + cut, node, "R", EXPECTED[s]))
        return out

    def audit_of(node: tuple) -> list[tuple[str, str]]:
        script = []
        while node[3] is not None:
            script.append((node[4], node[5]))
            node = node[3]
        return script[::-1]

    # A node: (row, state, cost, parent, edit initial, role made).
    root = (0, 0, 0, None, "", "")
    # First incumbent: a dive that follows the bounds, first fitting edit in ASCII order.
    node = root
    while not (node[0] == n and node[1] in ACCEPTED and node[2] == bound[0][0]):
        node = next(c for c in children(node) if c[2] + bound[c[0]][c[1]] == bound[0][0])
    incumbent_cost, incumbent = int(node[2]), audit_of(node)
    letters = "".join(e for e, _ in incumbent)

    # Depth-first branch-and-bound: a prefix carries its depth and how it compares with the
    # incumbent's audit (-1 less, 0 equal so far, 1 greater); ties of cost go to the ASCII-less.
    table: dict[tuple[int, int], int] = {}
    stack = [(root, 0, 0)]
    while stack:
        node, depth, rel = stack.pop()
        i, s, cost = node[0], node[1], node[2]
        least = cost + bound[i][s]
        if least > incumbent_cost or (least == incumbent_cost and rel > 0):
            continue
        if table.get((i, s), least + incumbent_cost + 1) <= cost:
            continue  # dominated: a prefix met earlier reached (row, state) no dearer
        table[(i, s)] = cost
        if i == n and s in ACCEPTED:
            if cost < incumbent_cost or rel < 0:
                incumbent_cost, incumbent = int(cost), audit_of(node)
                letters = "".join(e for e, _ in incumbent)
            continue
        for child in reversed(children(node)):
            edit = child[4]
            child_rel = rel if rel else (1 if depth >= len(letters) or edit > letters[depth] else -1 if edit < letters[depth] else 0)
            stack.append((child, depth + 1, child_rel))
    return incumbent_cost, "".join(e for e, _ in incumbent), incumbent


SCRIPT = "conv_id long, pos long, before string, edit string, role string, cost long, audit string"


def _script_rows(conv, places: list, initials: list[str], faults: list[int]) -> list[tuple]:
    cost, audit, script = repair(initials, faults)
    out, before, i = [], [], 0
    for edit, role in script:
        if edit == "I":
            before.append(role)
            continue
        out.append((conv, places[i], "\n".join(before) or None, edit, role, None, None))
        before, i = [], i + 1
    out.append((conv, None, "\n".join(before) or None, "E", "", cost, audit))
    return out


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows sorted by (conversation, place): the script of each conversation, and one row
    (edit ``E``) with its inserts at the end, cost and audit. Only the codes of one conversation
    are held."""
    columns = [c.split()[0] for c in SCRIPT.split(", ")]
    current, places, initials, faults, done = None, [], [], [], []

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64", "pos": "Int64", "cost": "Int64"})

    for batch in batches:
        for null, conv, pos, initial, fault in zip(batch["_null"], batch["_conv"], batch["pos"], batch["initial"], batch["fault"]):
            key = (bool(null), int(conv))
            if key != current:
                if current is not None:
                    done += _script_rows(None if current[0] else current[1], places, initials, faults)
                current, places, initials, faults = key, [], [], []
            places.append(int(pos))
            initials.append(initial)
            faults.append(int(fault))
        if done:
            yield frame(done)
            done = []
    if current is not None:
        yield frame(_script_rows(None if current[0] else current[1], places, initials, faults))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows sorted by (conversation, place): one SHA-256 of the repaired lines each."""
    current, digest, started, done = None, None, False, []
    for batch in batches:
        for null, conv, before, edit, role, text in zip(batch["_null"], batch["_conv"], batch["before"], batch["edit"], batch["role"], batch["text"]):
            key = (bool(null), int(conv))
            if key != current:
                if current is not None:
                    done.append((None if current[0] else current[1], digest.hexdigest()))
                current, digest, started = key, hashlib.sha256(), False
            lines = [f"{r}:" for r in before.split("\n")] if isinstance(before, str) else []
            if edit in ("K", "R"):
                lines.append(f"{role}:{text}")
            for line in lines:
                digest.update((("\n" if started else "") + line).encode())
                started = True
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})
            done = []
    if current is not None:
        yield pd.DataFrame([(None if current[0] else current[1], digest.hexdigest())], columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the input: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, rows (after damage)."""
    spark = conversations.sparkSession
    rows = faults(damaged(conversations))

    following = rows.select(F.col("conv_id").alias("_c"), (F.col("pos") - 1).alias("_p"), F.col("initial").alias("_next"))
    pairs = rows.join(following, rows["conv_id"].eqNullSafe(following["_c"]) & (rows["pos"] == following["_p"]))
    illegal = pairs.groupBy("conv_id").agg(F.sum((~F.concat("initial", "_next").isin(*LEGAL_PAIRS)).cast("long")).alias("illegal"))
    counts = rows.groupBy("conv_id").agg(
        F.count("*").alias("rows"),
        F.sum((F.col("fault") == BLANK).cast("long")).alias("blank"),
        F.sum((F.col("fault") == DUPLICATE).cast("long")).alias("duplicate"),
        F.sum((F.col("fault") == CUT).cast("long")).alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))

    ready_for_python(spark)
    codes = rows.select(F.col("conv_id").isNull().alias("_null"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("_conv"), "pos", "initial", "fault")
    scripts = written(codes.repartition("_null", "_conv").sortWithinPartitions("_null", "_conv", "pos").mapInPandas(_search, SCRIPT),
                      "conversation-scripts")
    summary = scripts.where("edit = 'E'").select("conv_id", "cost", "audit")
    lines = scripts.join(rows.select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), F.col("role").alias("_role"), "text"),
                         scripts["conv_id"].eqNullSafe(F.col("_c")) & (scripts["pos"] == F.col("_p")), "left")
    role = F.when(F.col("edit") == "K", F.col("_role")).otherwise(F.col("role"))
    lines = lines.select(F.col("conv_id").isNull().alias("_null"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("_conv"),
                         F.coalesce(F.col("pos"), F.lit(2**62)).alias("_pos"), "before", "edit", role.alias("role"), "text")
    hashed = (lines.repartition("_null", "_conv").sortWithinPartitions("_null", "_conv", "_pos")
              .mapInPandas(_hashes, "conv_id long, repaired_sha256 string"))

    every = conversations.select("conv_id").distinct()
    out = every
    for part in (counts, illegal, summary, hashed):
        out = out.join(part.withColumnRenamed("conv_id", "_k"), out["conv_id"].eqNullSafe(F.col("_k")), "left").drop("_k")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.col("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.col("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        F.coalesce(F.col("rows"), zero).alias("rows"))
