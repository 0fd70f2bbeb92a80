"""Toxicity by a weighted finite-state grammar over clauses.

The lexical transducer reads characters and writes harm symbols, insults with their learned
weights; the tokens of the clause around them become symbols too. Three machines for the scope
of a negation, for reported speech and for a target are composed into one automaton (``ARCS``)
that reads these symbols once, in order. Its harm arcs carry the weight of the term; the sums of
the weights on a clause's path are its features by ``KINDS``. A document is scored by the clauses
it matches, never by words outside them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presslake.llm.staging import ready_for_python, forget, written

#: Labelled rows that the lexicon and the clause weights are learned from: those with the
#: smallest hashes of their ids. A bound on training only; every document is scored.
TRAINING_ROWS = 20_000
#: Entries of the learned lexicon.
LEXICON_ROWS = 20_000
PREFIXES = (4, 5, 6)
#: The harms of a document count at most as so many average ones per kind, in steps of 1 / STEPS.
MOST_HARMS, STEPS = 5, 8

# Closed classes of the grammar, in four languages.
TARGETS = set("you your yours yourself they them their he him she her people everyone du dich dir dein ihr euch sie ihnen tu te toi vous votre ils elles lui usted ustedes tus vosotros ellos ellas".split())
NEGATIONS = set("not no never nor isn't aren't don't doesn't wasn't without nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco".split())
REPORTS = set("said says say told wrote quoted claimed called reported according sagte sagt schrieb behauptete dit disait écrit selon dijo dice según escribió".split())
THREATS = set("kill hurt destroy beat burn shoot stab hang töten umbringen verletzen tuer frapper brûler matar golpear quemar".split())

#: Symbols of a matched clause: its harm, and what else the clause says about it.
KINDS = ["insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_held_back"]
#: What the constant and the weights of the symbols are drawn to where labels are few.
PRIOR = np.array([-3.0, 3.0, 1.0, -1.5, -1.5, 4.0, -3.5])
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
TOKEN = re.compile(WORD.pattern + r"|[\"“”«»„]")
CLAUSE_END = re.compile(r"[.,;:!?\n]")
QUOTES = "\"“”«»„"
#: The component machines: from a state and a symbol (target, negation, report, quote, other word, harm) to the next state.
SCOPE = {(s, x): 3 if x == "negation" else s if x == "quote" else max(s - 1, 0) for s in range(4) for x in ("target", "negation", "report", "quote", "word", "harm")}
REPORT = {(s, x): max(s, 1) if x == "report" else (0, 2, 1)[s] if x == "quote" else s for s in range(3) for x in ("target", "negation", "report", "quote", "word", "harm")}
TARGET = {(s, x): int(s or x == "target") for s in range(2) for x in ("target", "negation", "report", "quote", "word", "harm")}
#: Their composition: next state, and the mark that a harm read there gets.
ARCS = {
    ((a, b, c), x): ((SCOPE[a, x], REPORT[b, x], TARGET[c, x]), "reported" if b == 2 else "negated" if a else "plain")
    for a in range(4) for b in range(3) for c in range(2) for x in ("target", "negation", "report", "quote", "word", "harm")
}
SYMBOLS = {w: x for x, closed in (("target", TARGETS), ("report", REPORTS), ("negation", NEGATIONS), ("quote", QUOTES)) for w in closed}


def terms(text: str) -> set[str]:
    """Distinct words and, marked with a star, their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


class Grammar:
    """The composed transducers for one lexicon (term to weight; ``abc*`` stands for all words that begin so)."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list[tuple[int, bool, float]]] = {}
        average = sum(lexicon.values()) / len(lexicon) if lexicon else 1.0
        for term in sorted(lexicon):
            entries.setdefault(term.rstrip("*"), []).append((0, term.endswith("*"), lexicon[term] / average))
        for term in THREATS - entries.keys():
            entries[term] = [(1, False, 1.0)]
        for term, found in entries.items():
            self.automaton.add_word(term, (len(term), found))
        self.automaton.make_automaton()

    def harms(self, text: str) -> list[tuple[int, int, int, float]]:
        """Start, end, class (0 insult, 1 threat) and weight (1 on average) of the harms in lower-cased text."""
        found = {}
        for last, (size, entries) in self.automaton.iter(text):
            start, end = last - size + 1, last + 1
            if start and (text[start - 1].isalnum() or text[start - 1] == "'"):
                continue
            inside = end < len(text) and text[end].isalnum()
            for kind, prefix, weight in entries:
                if prefix if inside else not prefix:
                    found[start] = (start, end, kind, weight)
        return [found[k] for k in sorted(found)]

    def paths(self, text: str) -> Iterator[dict[str, float]]:
        """For each clause with a harm that matches, the weights on its path by kind."""
        text = text.lower()
        harms, at = self.harms(text), 0
        while at < len(harms):
            start, end = harms[at][:2]
            ends = [m.end() for m in CLAUSE_END.finditer(text, max(0, start - 400), start)]
            low = ends[-1] if ends else max(0, start - 400)
            stop = CLAUSE_END.search(text, end, end + 400)
            high = stop.start() if stop else min(len(text), end + 400)
            inside = {}
            while at < len(harms) and harms[at][0] < high:
                inside[harms[at][0]] = harms[at][2:]
                at += 1
            kinds = self._path(text, low, high, inside)
            if kinds:
                yield kinds

    @staticmethod
    def _path(text: str, low: int, high: int, harms: dict[int, tuple[int, float]]) -> dict[str, float]:
        """What the composed automaton writes for a clause, from its harms (class and weight by position)."""
        state, read = (0, 0, 0), [Counter(), Counter()]
        for m in TOKEN.finditer(text, low, high):
            harm = harms.get(m.start())
            state, mark = ARCS[state, "harm" if harm else SYMBOLS.get(m.group(), "word")]
            if harm:
                read[harm[0]][mark] += harm[1]
        insult, threat = read
        out = {}
        if insult:
            out["insult"] = insult.total()
            out |= {f"insult_{mark}": insult[mark] for mark in ("negated", "reported") if insult[mark]}
            if state[2] and insult["plain"]:
                out["insult_targeted"] = insult["plain"]
        if threat and state[2]:
            out["threat"] = threat.total()
            if threat["negated"] or threat["reported"]:
                out["threat_held_back"] = threat["negated"] + threat["reported"]
        return out

    def clauses(self, text: str) -> Counter:
        """Number of matched clauses that have each symbol."""
        return Counter(kind for kinds in self.paths(text) for kind in kinds)

    def features(self, text: str) -> tuple[int, ...]:
        """Weights by kind over all clauses, in steps of 1 / STEPS."""
        found = Counter()
        for kinds in self.paths(text):
            found.update(kinds)
        return tuple(min(round(found[k] * STEPS), MOST_HARMS * STEPS) for k in KINDS)


def _inputs(features: tuple[int, ...]) -> list[float]:
    return [1.0, *np.sqrt(np.array(features) / STEPS)]


def fitted_weights(rows: list[tuple[tuple[int, ...], int, int]]) -> np.ndarray:
    """Logistic weights (constant first) of counted feature rows ``(features, rows, toxic rows)``, drawn to ``PRIOR``."""
    w = PRIOR.copy()
    if not rows:
        return w
    x = np.array([_inputs(f) for f, _, _ in rows], float)
    n, y = (np.array([r[i] for r in rows], float) for i in (1, 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - n * p) - (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Distinct texts and labels of at most ``rows`` labelled documents outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # A text counts once: its copies are no further evidence.
    return texts.join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def learned_lexicon(training: DataFrame) -> dict[str, float]:
    """Terms whose documents are toxic far more often than chance would make any term, with their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, toxic = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                n.update(found)
                if label:
                    toxic.update(found)
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["term", "n", "toxic"])

    total, bad = training.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < total:
        return {}
    counted = written(training.mapInArrow(count, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "toxic-terms")
    base, tested = bad / total, math.log(max(counted.count(), 1))
    least = max(3.0, 0.5 * math.log(2 * (total - bad)))  # grows with the clean texts that could have held the term
    p = F.col("toxic") / F.col("n")
    surprise = F.col("toxic") * F.log(p / base) + F.when(p < 1, (F.col("n") - F.col("toxic")) * F.log((1 - p) / (1 - base))).otherwise(0)
    odds = F.log((F.col("toxic") + 0.5) / bad) - F.log((F.col("n") - F.col("toxic") + 0.5) / (total - bad))
    rows = (
        counted.where("toxic > 0").withColumn("odds", odds).where((p > 0.5) & (surprise > tested + 2.3) & (F.col("odds") > least) & (F.col("toxic") >= 0.01 * bad))
        .orderBy(F.desc("odds"), "term").limit(LEXICON_ROWS).select("term", "odds").collect()
    )
    forget(counted)
    return {r.term: r.odds for r in rows}


def with_score(docs: DataFrame, labels: DataFrame, name: str = "score", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """All columns of ``docs`` and the score of ``text``, learned from the labelled rows among them."""
    ready_for_python(docs.sparkSession)
    training = written(_training(docs, labels, training_rows), "toxic-training")
    lexicon = learned_lexicon(training)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            counted: dict[tuple[int, ...], list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both = counted.setdefault(grammar.features(text), [0, 0])
                both[0] += 1
                both[1] += label
            yield pa.RecordBatch.from_arrays([
                pa.array([list(f) for f in counted], pa.list_(pa.int32())),
                pa.array([n for n, _ in counted.values()], pa.int64()), pa.array([t for _, t in counted.values()], pa.int64()),
            ], ["f", "n", "toxic"])

    rows = training.mapInArrow(featured, "f array<int>, n long, toxic long").groupBy("f").agg(F.sum("n"), F.sum("toxic")).collect()
    weights = fitted_weights(sorted((tuple(f), n, t) for f, n, t in rows))
    forget(training)
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            x = np.array([_inputs(grammar.features(t or "")) for t in batch.column(at).to_pylist()], float).reshape(-1, len(PRIOR))
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score`` and ``predicted``, from the text alone.

    Labels are read only where crc32 of the id is not divisible by 5, from at most
    ``training_rows`` rows. Null and empty texts match no clause and get the score of such
    texts; a null id is not held out; repeated rows are scored alike; without labels the
    grammar's prior weights hold and no insult is known. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return with_score(texts, labels, training_rows=training_rows).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
