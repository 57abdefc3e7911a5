"""Quality by perplexity under an interpolated modified Kneser-Ney model of letters.

The model is of order four over code points (later ones as two symbols each), trained on the trusted texts that
aren't held out. Its counts, continuation counts and probabilities are tables keyed by n-gram, made and joined by
Spark; they hold every n-gram of the corpus (those that trusted text lacks with count zero), so that each gets its
interpolated probability by the same joins. Texts are read once, into blocks of some megabytes: a block carries its
texts, packed, and each of its different n-grams once. The n-grams of all blocks meet the model in one join by
n-gram; a block's own probabilities, bounded as its text is, then meet its pack, a few blocks in each task.
Documents are kept below a quantile of the perplexity of held-out trusted documents of their language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import held_out, pack, table, unpack, written

ORDER = 4
BITS = 12
END = 1
#: Code points from here on are two symbols, of their upper bits and of their lower ten; no two texts share symbols.
DIRECT = 1920
UPPER = DIRECT + 2
LOWER = UPPER + (0x110000 >> 10)
#: The quantile of trusted documents' perplexity up to which a document is kept.
QUANTILE = 0.99
#: A text too short to be trusted says little: so many standard errors of its mean count in its favour.
SPREAD = 2.0
LEAST_CHARS = 200
#: Code points of a block's texts, and blocks of a task that scores them.
BLOCK_CHARS = 1 << 24
TASK_BLOCKS = 2
#: Symbols that a task counts at once; its arrays are some hundred bytes for each.
COUNT_CHARS = 1 << 19


def symbols(text: str | None) -> np.ndarray:
    """The symbols of a text, lower-cased, ended: one of a code point below DIRECT, else two."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    if codes.size and codes.max() >= DIRECT:
        pairs = np.column_stack([np.where(codes < DIRECT, codes + 2, UPPER + (codes >> 10)), np.where(codes < DIRECT, -1, LOWER + (codes & 1023))]).ravel()
        return np.append(pairs[pairs >= 0], END)
    return np.append(codes + 2, END)


def grams(text: str | None) -> np.ndarray:
    """The n-grams that end at each symbol of a text; 0 stands before its begin."""
    s = np.concatenate([np.zeros(ORDER - 1, np.int64), symbols(text)])
    out = np.zeros(len(s) - ORDER + 1, np.int64)
    for k in range(ORDER):
        out |= s[k : k + len(out)] << (BITS * (ORDER - 1 - k))
    return out


#: Beyond these letters words may hold combining marks, or not be parted by spaces.
SIMPLE = re.compile("[\u0000-\u08ff\u1e00-\u2bff]*")
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"
UNSPACED_LETTER = regex.compile(rf"[{UNSPACED}]")
WORD = regex.compile(rf"[{UNSPACED}]\p{{M}}*+|(?:(?![{UNSPACED}])[\p{{L}}\p{{M}}\u200c\u200d])++")
PLAIN = regex.compile(r"[\p{L}\p{M}\s\u200c\u200d]|(?<=[\p{L}\p{M}])\p{P}")


def trusted(text: str | None) -> bool:
    """Long enough, nearly all letters and spaces, and words that vary: text to learn from."""
    text = text or ""
    if len(text) < LEAST_CHARS:
        return False
    if not SIMPLE.fullmatch(text):
        found = WORD.findall(text)
        unspaced = sum(1 for w in found if UNSPACED_LETTER.match(w))
        units = list(zip(found, found[1:])) if 2 * unspaced > len(found) else found  # single letters repeat, pairs vary
        return len(PLAIN.findall(text)) >= 0.9 * len(text) and len(set(units)) >= 0.3 * min(len(units), 2000)
    words = text.split()
    plain = sum(map(len, filter(str.isalpha, (w.strip(".,;:!?\"'()") for w in words))))
    return plain + len(words) >= 0.9 * len(text) and len(set(words)) >= 0.3 * min(len(words), 2000)


def _source(docs: DataFrame, id_col: str, lang: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang).cast("string").alias("lang"), held_out(id_col).alias("held_out"), F.col(text).cast("string").alias("text"))


def blocked(src: DataFrame, trust: Callable[[str | None], bool] = trusted) -> DataFrame:
    """block, pack, gram, n: the rows of a block, compressed, its different n-grams, and their counts in trusted texts that aren't held out.

    Blocks are cut as a task reads its rows, so the table is written before it is used; a task that is run again cuts its own anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, weights, size, chars = [], [], 0, 0

        def count() -> None:
            nonlocal keys, counts, parts, weights, size
            new, at = np.unique(np.concatenate([keys, *parts]), return_inverse=True)
            keys, counts = new, np.bincount(at, np.concatenate([counts, *weights])).astype(np.int64)
            parts, weights, size = [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal k, held, keys, counts, chars
            count()
            row = pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k]), pa.array([pack(held, level=9)], pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                names=["block", "pack", "gram", "n"],
            )
            k, held, chars = k + 1, [], 0
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return row

        for batch in batches:
            begin = 0
            for i, (out, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                text = text.as_py()
                for g in _pieces(grams(text)):
                    parts.append(g)
                    weights.append(np.full(len(g), float(not out and trust(text))))
                    size += len(g)
                    if size > COUNT_CHARS:
                        count()
                chars += len(text or "")
                if chars >= BLOCK_CHARS or i + 1 == batch.num_rows:
                    held.append(batch.slice(begin, i + 1 - begin))
                    begin = i + 1
                if chars >= BLOCK_CHARS:
                    yield emit()
        if held:
            yield emit()

    return src.mapInArrow(run, "block bigint, pack binary, gram array<bigint>, n array<bigint>")


def _pieces(g: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(g), COUNT_CHARS):
        yield g[i : i + COUNT_CHARS]


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from its counts of counts."""
    n = counts.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))  # type: ignore[return-value]


def probabilities(found: DataFrame) -> DataFrame:
    """gram, logp (natural) of every n-gram in ``found`` (gram, n); n sums to its count in trusted text."""
    tables = {ORDER: written(found.groupBy("gram").agg(F.sum("n").alias("c")), "order4")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        tables[k] = written(tables[k + 1].groupBy(shorter.alias("gram")).agg(F.count_if(F.col("c") > 0).alias("c")), f"order{k}")
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[k])
        rows = tables[k].withColumns({"context": F.shiftright("gram", BITS), "suffix": F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))})
        stats = rows.groupBy("context").agg(
            F.sum("c").alias("total"), (d1 * F.count_if(F.col("c") == 1) + d2 * F.count_if(F.col("c") == 2) + d3 * F.count_if(F.col("c") > 2)).alias("held")
        )
        rows = rows.join(stats, "context")
        if below is None:
            v = tables[1].count() + 1  # one more symbol for all that is unknown
            rows = rows.withColumn("low", F.lit(1.0 / v))
        else:
            rows = rows.join(below.withColumnsRenamed({"gram": "suffix", "p": "low"}), "suffix")
        cut = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        p = F.when(F.col("total") > 0, (F.greatest(F.col("c") - cut, F.lit(0.0)) + F.col("held") * F.col("low")) / F.col("total")).otherwise(F.col("low"))
        below = written(rows.select("gram", p.alias("p")), f"p{k}")
    return below.select("gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, trust: Callable[[str | None], bool] = trusted, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, lang, held_out, trusted, n_grams, perplexity and its lower bound at_least, of every row."""
    src = _source(docs, id_col, lang, text)
    kind = src.schema["doc_id"].dataType.simpleString()
    parts = written(blocked(src, trust), "blocks")
    every = parts.select("block", F.explode(F.arrays_zip("gram", "n")).alias("g")).select("block", "g.gram", "g.n")
    logp = written(probabilities(every.select("gram", "n")), "logp")
    tasks = max(1, -(-parts.count() // TASK_BLOCKS))
    listed = every.select("block", "gram").join(logp, "gram").repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("gram", "logp")).alias("model"))
    met = parts.select("block", "pack").repartition(tasks, "block").join(listed, "block").select("pack", F.col("model.gram").alias("gram"), F.col("model.logp").alias("logp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, values = batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy()
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
                for part in unpack(batch.column(0)[i].as_py()):
                    own, n, ppl, low = [], [], [], []
                    for t in part.column(3):
                        t = t.as_py()
                        v = values[np.searchsorted(keys, grams(t))]
                        own.append(trust(t)), n.append(len(v)), ppl.append(float(np.exp(-v.mean()))), low.append(float(np.exp(-v.mean() - SPREAD * v.std() / np.sqrt(len(v)))))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, pa.bool_()), pa.array(n, pa.int64()), pa.array(ppl, pa.float64()), pa.array(low, pa.float64())], names=["doc_id", "lang", "held_out", "trusted", "n_grams", "perplexity", "at_least"])

    return met.mapInArrow(run, f"doc_id {kind}, lang string, held_out boolean, trusted boolean, n_grams bigint, perplexity double, at_least double")


def judge(docs: DataFrame, quantile: float = QUANTILE, trust: Callable[[str | None], bool] = trusted, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, lang, held_out, trusted, n_grams, perplexity, at_least, threshold and kept of every row.

    A text is kept up to its language's quantile of perplexity; one too short to be trusted is held against it
    by at_least, its perplexity less SPREAD standard errors. Quantiles are those of trusted texts that the model
    didn't learn from. A null or empty text is one end symbol and isn't kept. A language (null is one) without
    held-out trusted texts takes the threshold of all of them; without any, every text is kept. A null id is held
    out. Repeated rows are rows of their own; ``docs`` may be any query, read once; other columns aren't read.
    Empty in, empty out.
    """
    scored = written(perplexities(docs, trust, id_col, lang, text), "scored")
    own = scored.where("trusted and held_out")
    by = written(own.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own")), "quantiles")
    whole = own.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("own", F.lit(whole).cast("double"))).drop("_lang", "own")
    measure = F.when(F.col("n_grams") <= LEAST_CHARS, F.col("at_least")).otherwise(F.col("perplexity"))
    return out.withColumn("kept", (F.col("n_grams") > 1) & F.coalesce(measure <= F.col("threshold"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
