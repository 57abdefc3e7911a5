"""Language of a document as a mixture.

Letter trigrams of the labelled training rows give one multinomial per language. For each document,
expectation-maximisation estimates the proportions in which the languages produced its trigrams; the
set of languages is the one of best penalised likelihood, so that a second language must earn its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import hash_below, held_out, table

BITS = 16
SMOOTH = 0.5
#: About so many training rows of each language are read; all of a language that has fewer.
ROWS_PER_LANGUAGE = 3000
#: Overlapping trigrams repeat each other's evidence, so a language costs more than half a log.
PENALTY = 4.0
TEMPERATURE = 3.0
ROUNDS = 40


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point, of every plane, is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Hashes of the trigrams of a text's letters, lower-cased, all else as one space; none without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[codes]
    if not alpha.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[32], np.where(alpha, codes, 32), [32]]).astype(np.uint32)
    space = codes == 32
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    if len(codes) < 3:
        codes = np.concatenate([codes, np.full(3 - len(codes), 32, np.uint32)])
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    return (mixed * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)).astype(np.int64)


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of counts n under a mixture of the rows of p."""
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(ROUNDS):
        joint = share[:, None] * p
        new = joint @ (n / joint.sum(0)) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(share @ p))


def infer(p: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Proportions (zero outside the chosen set), the leading language, and the score of that choice."""
    at, n = np.unique(grams, return_counts=True)
    p = p[:, at]
    alone = np.log(p) @ n
    best = int(alone.argmax())
    shares, value = np.zeros(len(p)), float(alone[best])
    shares[best] = 1.0
    if len(p) > 1:
        order = np.argsort(-mixture(p, n)[0], kind="stable")
        cost = PENALTY * np.log(n.sum() + 1)
        for k in range(2, len(p) + 1):
            own, found = mixture(p[order[:k]], n)
            if found - cost * (k - 1) <= value:
                break
            value, shares = found - cost * (k - 1), np.zeros(len(p))
            shares[order[:k]] = own
    lead = int(shares.argmax())
    rivals = np.exp((alone - alone.max()) / TEMPERATURE)
    sure = rivals[lead] / rivals.sum() if shares[lead] > 0.999 else 1.0
    return shares, lead, float(min(1.0, shares[lead] * sure))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The languages and their trigram distributions, from rows that are not held out.

    A bounded sample suffices for the fit: about ``rows_per_language`` whole texts of each language,
    chosen by a hash of the id. Tasks' counts are summed by language (eight at most of each) before they come to the
    driver, as a table of 2**BITS counts per language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, 1 << BITS))
    chosen = F.lit(False)
    for name in names:
        chosen = F.when(F.col("lang") == name, hash_below(min(1.0, rows_per_language / sizes[name]), "doc_id")).otherwise(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.setdefault(name, np.zeros(1 << BITS, np.int64))
                np.add.at(total[name], trigrams(t.as_py()), 1)
        for name, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.tobytes()], pa.binary())], names=["lang", "n"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n.as_py(), np.int64) for n in part.column("n"))
        return pa.table({"lang": part.column("lang").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    parts = rows.where(chosen).select("lang", "text").repartition(8).mapInArrow(run, "lang string, n binary")
    n = np.zeros((len(names), 1 << BITS))
    for name, part in parts.groupBy("lang").applyInArrow(add, "lang string, n binary").collect():
        n[names.index(name)] = np.frombuffer(part, np.int64)
    n += SMOOTH
    return names, n / n.sum(1, keepdims=True)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with lang_pred, score and lang_mix (language to proportion) of every row.

    A null text, or one without a letter, is ``und`` with score 0 and an empty mix; so is every text if
    nothing was learned. Ties go to the language that sorts first. Rows are independent.
    """
    names, p = model
    columns = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(k).alias(a) for k, a in zip(keep, columns)), F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(p.astype(np.float64))  # 2**BITS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            pred, score, mix = [], [], []
            for t in batch.column(len(columns)):
                grams = trigrams(t.as_py())
                if not len(grams) or not names:
                    pred.append("und"), score.append(0.0), mix.append([])
                    continue
                shares, lead, sure = infer(p, grams)
                pred.append(names[lead]), score.append(sure), mix.append([(names[i], float(shares[i])) for i in np.flatnonzero(shares)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(columns))), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))],
                names=[*columns, "lang_pred", "score", "lang_mix"],
            )

    kinds = ", ".join(f"{a} {src.schema[a].dataType.simpleString()}" for a in columns)
    out = src.mapInArrow(run, f"{kinds}, lang_pred string, score double, lang_mix map<string,double>")
    return out.withColumnsRenamed(dict(zip(columns, keep)))


def accept(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with a score of ``least`` or more, or as a mixture.

    A mixture's score is its leading language's share, which says nothing of the fit.
    """
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))  # the row's own names can't clash
    marked = identify(whole, train(docs), ("row",))
    return marked.where((F.col("lang_pred") != "und") & ((F.col("score") >= least) | (F.size("lang_mix") > 1))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.array_join(F.transform(F.map_entries("lang_mix"), lambda e: F.concat_ws(":", e["key"], F.round(e["value"], 3).cast("string"))), ",").alias("mix"))
