"""Toxicity scores from a learned lexicon, fuzzy matching, and the context of each hit.

Terms and word beginnings that mark toxic training texts form a trie. A Levenshtein automaton (one
edit) runs along the trie, its states determinised as words ask for them, so that a misspelled term is
found in one pass over the word. Each hit is scored in its window: quotation marks and words of
reporting near it speak for a quotation, further hits near it for abuse. A logistic regression over the
sums of these hits gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import hash_below, held_out, share_of, table

#: About so many labelled training rows are read to fit lexicon and regression.
SAMPLE_ROWS = 16_000
STEM_LENGTHS = (4, 5, 6)
FUZZY_LEAST = 5
WINDOW = 8
TOKENS = regex.compile(r"\p{L}[\p{L}\p{M}'’-]*|[\"“”„«»‘]")
QUOTES = frozenset("\"“”„«»‘")
#: Fixed words of reporting and mentioning in four languages.
REPORTING = frozenset(
    "said says wrote called quote quoted word words term comment reported sagte schrieb nannte wort zitat zitiert begriff dit écrit mot cite citation terme dijo escribió palabra cita término llamó".split()
)
FEATURES = ("exact", "stem", "fuzzy", "quoted", "dense", "any_exact", "any_stem", "any_fuzzy", "rate", "log_words")


class Lexicon:
    """Terms and stems with weights, and the automaton over them."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.terms, self.stems = terms, stems
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[float] = [0.0]
        for term, weight in terms.items():
            if len(term) >= FUZZY_LEAST:
                node = 0
                for ch in term:
                    if ch not in self.next[node]:
                        self.next[node][ch] = len(self.next)
                        self.next.append({})
                        self.ends.append(0.0)
                    node = self.next[node][ch]
                self.ends[node] = max(self.ends[node], weight)
        self.state_of: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.accepts: list[float] = []
        self.moves: list[dict[str, int]] = []
        self.begin = self._state(self._close({(0, 0)}))
        self.memo: dict[str, tuple[int, float] | None] = {}

    def _close(self, places: set[tuple[int, int]]) -> frozenset:
        """Places (trie node, edits used), with those that a missing letter leads to; none where fewer edits do."""
        out = dict.fromkeys(n for n, e in places if e == 0)
        more = {n for n, e in places if e == 1} | {c for n in out for c in self.next[n].values()}
        return frozenset([(n, 0) for n in out] + [(n, 1) for n in more if n not in out])

    def _state(self, places: frozenset) -> int:
        if places not in self.state_of:
            self.state_of[places] = len(self.states)
            self.states.append(places)
            self.accepts.append(max((self.ends[n] for n, _ in places), default=0.0))
            self.moves.append({})
        return self.state_of[places]

    def _move(self, state: int, ch: str) -> int:
        new: set[tuple[int, int]] = set()
        for node, edits in self.states[state]:
            if ch in self.next[node]:
                new.add((self.next[node][ch], edits))
            if edits == 0:
                new.add((node, 1))  # one letter too many
                new.update((child, 1) for child in self.next[node].values())  # another letter
        to = self._state(self._close(new))
        self.moves[state][ch] = to
        return to

    def fuzzy(self, word: str) -> float:
        """The weight of the best term within one edit of the word."""
        state, dead = self.begin, self._state(frozenset())
        for ch in word:
            state = self.moves[state][ch] if ch in self.moves[state] else self._move(state, ch)
            if state == dead:
                return 0.0
        return self.accepts[state]

    def hit(self, word: str) -> tuple[int, float] | None:
        """(0 exact, 1 stem or 2 fuzzy; weight) of a lower-case word."""
        if word in self.memo:
            return self.memo[word]
        out = None
        if word in self.terms:
            out = (0, self.terms[word])
        else:
            best = max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS), default=0.0)
            if best:
                out = (1, best)
            elif len(word) >= FUZZY_LEAST and (weight := self.fuzzy(word)):
                out = (2, weight)
        if len(self.memo) > 400_000:
            self.memo.clear()
        if len(self.states) > 50_000:  # the automaton is rebuilt as words ask for it
            self.state_of, self.states, self.accepts, self.moves = {}, [], [], []
            self.begin = self._state(self._close({(0, 0)}))
        self.memo[word] = out
        return out

    def features(self, text: str | None) -> list[float]:
        words = TOKENS.findall((text or "").lower())
        hits = [(i, *h) for i, w in enumerate(words) if (h := self.memo[w] if w in self.memo else self.hit(w))]
        sums, quoted, dense, counts = [0.0, 0.0, 0.0], 0.0, 0.0, [0, 0, 0]
        for k, (i, kind, weight) in enumerate(hits):
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            marks = (any(w in QUOTES for w in words[max(0, i - WINDOW) : i]) and any(w in QUOTES for w in words[i + 1 : i + WINDOW + 1])) + any(w in REPORTING for w in near)
            others = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(hits) and abs(hits[j][0] - i) <= WINDOW)
            sums[kind] += weight
            counts[kind] += 1
            quoted += weight * marks / 2
            dense += weight * others / 2
        n = len(words)
        return [*map(np.log1p, sums), np.log1p(quoted), np.log1p(dense), *(float(c > 0) for c in counts), 100 * sum(counts) / max(n, 1), np.log1p(n)]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -20.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts by term, for toxic and other texts; stems are marked by a star."""
    for batch in batches:
        total: dict[str, list[int]] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = {w for w in TOKENS.findall((text.as_py() or "").lower()) if w not in QUOTES and len(w) >= 3}
            for w in words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}:
                total.setdefault(w, [0, 0])[label] += 1
        n = np.array(list(total.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(n[:, 1]), pa.array(n[:, 0])], names=["term", "toxic", "other"])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> Model:
    """Lexicon and regression from about ``sample_rows`` labelled rows that are not held out, chosen by a hash.

    A document labelled more than once is toxic if any of its labels says so; null labels are none. The
    sample's ids are joined to the texts (they are few by that parameter, not by the data's size).
    Without both kinds of label nothing is learned and every score is near 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    share = share_of(known.count(), sample_rows)
    chosen = known.where(hash_below(share, "doc_id", seed=5)).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(chosen), "doc_id").select("label", "text").repartition(12).persist()  # bounded by sample_rows
    try:
        n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
        if not n.get(0) or not n.get(1):
            return Model()
        least = max(4, n[1] // 200)
        found = rows.mapInArrow(_terms, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("other") + 0.5) / (n[0] + 1))
        found = found.where(F.col("toxic") >= least).withColumn("weight", ratio).where("weight > 3")
        found = found.select("term", "weight").collect()  # terms of the sample's texts, bounded as they are
        stems = {r[0][:-1]: r[1] for r in found if r[0].endswith("*")}
        model = Model({r[0]: r[1] for r in found if not r[0].endswith("*")}, stems)
        marked = rows.mapInArrow(_measured(docs, model, ["label"]), f"label int, {', '.join(f'{f} double' for f in FEATURES)}").toPandas()
    finally:
        rows.unpersist()
    x, y = marked[list(FEATURES)].to_numpy(float), marked["label"].to_numpy(float)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights, model.bias = _fit((x - model.mean) / model.scale, y)
    return model


def _measured(docs: DataFrame, model: Model, keep: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.stems))  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            x = np.array([lexicon.features(t.as_py()) for t in batch.column(len(keep))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=[*keep, *FEATURES])

    return run


def rate(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with score and the features of every row.

    A null text is an empty one, and has the score of a text without hits. Rows are independent: repeated
    rows and null ids pass through. Other columns aren't read. An empty table gives an empty table.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(k).alias(a) for k, a in zip(keep, names)), F.col(text).cast("string").alias("_text"))
    kinds = ", ".join(f"{a} {src.schema[a].dataType.simpleString()}" for a in names)
    out = src.mapInArrow(_measured(docs, model, names), f"{kinds}, " + ", ".join(f"{f} double" for f in FEATURES))
    z = F.lit(model.bias)
    for f, m, s, w in zip(FEATURES, model.mean, model.scale, model.weights):
        z = z + (F.col(f) - float(m)) / float(s) * float(w)
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return out.withColumn("score", score).withColumnsRenamed(dict(zip(names, keep)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rate(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
