"""Quality rules per document, and verdicts on whole hosts.

Every document gets counts and a base verdict. The failures of each host (here: ``source``) are summed,
the hosts' failure rates are shrunk with a beta prior whose mean and strength are fitted to all hosts,
and hosts whose shrunk rate is high lose all their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import table, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(ids: np.ndarray, window: int = 8) -> int:
    """Words inside a window of ``window`` words (a power of two) that the text has twice or more."""
    if len(ids) <= window:
        return 0
    width = 1
    while width < window:  # exact: windows of twice the width are pairs of windows
        a, b = ids[:-width], ids[width:]
        _, ids = np.unique(a.astype(np.int64) * (int(ids.max()) + 1) + b, return_inverse=True)
        width *= 2
    again = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(again) + window, np.int64)
    cover[:-window] += again
    cover[window:] -= again
    return int((np.cumsum(cover) > 0).sum())


def counts(text: str | None, window: int = 8) -> tuple[int, int, int, int, int]:
    """The five counts of one text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes: the six ASCII white-space characters only
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    order = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated(order, window)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The ``keep`` columns with the five counts and base_failed of every row."""
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(k).alias(a) for k, a in zip(keep, names)), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t.as_py()) for t in batch.column(len(names))], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *(pa.array(found[:, k]) for k in range(5))], names=[*names, *COUNTS])

    kinds = ", ".join(f"{a} {src.schema[a].dataType.simpleString()}" for a in names)
    out = src.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} bigint" for c in COUNTS)).withColumnsRenamed(dict(zip(names, keep)))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_rates(measured: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """host, n, failures and the shrunk failure rate of every host (a null host is a host of its own).

    The prior is beta(m s, (1 - m) s): m the failure rate of all documents, s by the moments of the
    hosts' rates, each weighted by its documents; s lies between 1 and 10 000, the latter where hosts
    differ no more than chance allows.
    """
    by = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"))
    by = written(by, "hosts")
    moments = by.agg(
        F.count("*").alias("k"),
        F.sum("n").cast("double").alias("all_n"),
        (F.sum("failures") / F.sum("n")).alias("m"),
        F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("n")).alias("s2"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
    )
    # weighted variance between hosts: sum n (p - m)^2 = sum f^2/n - m^2 N
    between = F.col("s2") - F.col("m") * F.col("m") * F.col("all_n")
    chance = (F.col("k") - 1) * F.col("m") * (1 - F.col("m"))
    rho = F.try_divide(between - chance, F.col("m") * (1 - F.col("m")) * (F.col("all_n") - F.col("n2") / F.col("all_n") - (F.col("k") - 1)))
    strength = F.least(F.greatest(F.coalesce(F.try_divide(1 - rho, rho), F.lit(1e4)), F.lit(1.0)), F.lit(1e4))
    prior = moments.select(F.coalesce("m", F.lit(0.0)).alias("m"), F.when(rho > 0, strength).otherwise(1e4).alias("s"))
    # one row of four numbers, so the driver carries it and no join is needed
    m, s = prior.first()
    return by.select("host", "n", "failures", ((F.col("failures") + F.lit(m * s)) / (F.col("n") + F.lit(s))).alias("rate"))


def judge(docs: DataFrame, host: str = "source", worst: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rate and kept of every row.

    kept is false for rows that fail themselves and for all rows of hosts whose shrunk rate exceeds
    ``worst``. A null or empty text has zero counts and fails. Repeated rows count as often as they
    occur; a row without a host belongs to the null host. Other columns are not read; an empty table
    gives an empty table. The hosts' table is joined by size: broadcast below Spark's threshold, else
    sorted and split where one host holds many rows.
    """
    rows = written(measure(docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text")), ("doc_id", "host")), "measured")
    rates = written(host_rates(rows, "host").select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")), "rates")
    out = rows.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= worst))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
wins AS (SELECT rid, p, array_to_string(ws[p:p + 7], ' ') AS win
         FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM rep) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, line, count(*) AS c FROM ln
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
s AS (SELECT w.rid, doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
      coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
h AS (SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (base_failed))::DOUBLE AS f FROM b GROUP BY host),
m AS (SELECT count(*) AS k, sum(n) AS a, sum(f) / sum(n) AS m, sum(f * f / n) AS s2, sum(n * n) AS n2 FROM h),
r AS (SELECT m, (s2 - m * m * a - (k - 1) * m * (1 - m)) / nullif(m * (1 - m) * (a - n2 / a - (k - 1)), 0) AS rho FROM m),
p AS (SELECT m, CASE WHEN rho > 0 THEN least(greatest((1 - rho) / rho, 1.0), 10000.0) ELSE 10000.0 END AS s FROM r),
v AS (SELECT host, (f + p.m * p.s) / (n + p.s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM b JOIN v ON b.host IS NOT DISTINCT FROM v.host
"""
