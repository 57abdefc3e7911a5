"""Mixing sources to target weights.

Sources form a tree: root, domain, language, source. A token budget goes down the tree by weight. A node
never gets more than its subtree can supply (its tokens times the epochs allowed), so what one child
can't supply goes to its siblings, and only what a whole subtree can't supply goes to the siblings of
its parent. Each leaf then supplies whole epochs and a token-prefix of one more epoch, in that epoch's
seeded order.

Everything is DataFrame functions. The prefix of a leaf is found without sorting it: token sums of 256
ranges of the order key, then of the 256 ranges inside the range where the prefix ends, and only there
row by row. The outcome is one cut key a leaf, so the documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import table, written

LEVELS = ("domain", "lang", "source")
#: Weights of siblings relative to each other; a name that isn't listed weighs 1, and so does every source.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
BUDGET_PERCENT = 60
MAX_EPOCHS = 2
SEED = "7"


def weight(column: str, weights: dict[str, int]) -> Column:
    """The weight of a name; 1 for a name without one."""
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def leaf_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domains: int = 4) -> DataFrame:
    """doc_id, the leaf (domain, lang, source) and n_tokens (words) of each row. Null names count as empty ones."""
    named = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("n_tokens"),
    )
    domain = F.concat(F.lit("d"), (F.crc32(F.col("source").cast("binary")) % domains).cast("string"))
    return named.select("doc_id", domain.alias("domain"), "lang", "source", "n_tokens")


def order_key(epoch: Column | str, seed: str = SEED, doc_id: Column | str = "doc_id") -> Column:
    """The place of a document in an epoch's order."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat_ws(":", F.lit(seed), col(epoch), F.coalesce(col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Water-filling: nodes (parents, name, w, cap, budget of the parent) to each node's own share ``got``.

    Children in order of cap / w fill up first; child i is full if the level that it and the later ones
    could reach, (budget - caps before) / (weights from it on), is at least cap / w. All in integers.
    """
    big = lambda c: F.col(c).cast("decimal(18,0)")
    w = Window.partitionBy(*parents).orderBy((F.col("cap") / F.col("w")).asc(), F.col(name).asc())
    every = Window.partitionBy(*parents)
    ranked = nodes.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "onward": F.sum("w").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    full = ranked.withColumn("full", big("cap") * big("onward") <= big("w") * (F.col("budget") - F.col("before")).cast("decimal(18,0)"))
    rest = full.withColumns(
        {
            "used": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)),
            "open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(every), F.lit(0)),
        }
    )
    share = F.expr("(cast(budget - used as decimal(18,0)) * cast(w as decimal(18,0))) div greatest(open, 1)")
    return rest.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", share)).cast("bigint")).drop("before", "onward", "full", "used", "open", "budget")


def leaf_targets(leaves: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """domain, lang, source, tokens and target of each leaf. ``leaves`` has one row a leaf with its tokens."""
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANGUAGE_WEIGHTS, "source": {}}
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    root = leaves.agg(F.expr(f"least(sum(cap), (coalesce(sum(tokens), 0) * {percent}) div 100)").alias("budget"))
    top = domains.join(F.broadcast(root)).withColumns({"w": weight("domain", weights["domain"]), "r": F.lit(0)})  # one row
    top = _fill(top, ["r"], "domain").select("domain", F.col("got").alias("budget"))
    mid = langs.join(top, "domain").withColumn("w", weight("lang", weights["lang"]))
    mid = _fill(mid, ["domain"], "lang").select("domain", "lang", F.col("got").alias("budget"))
    low = leaves.join(mid, ["domain", "lang"]).withColumn("w", weight("source", weights["source"]))
    return _fill(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("got").alias("target"))


def plan(rows: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """One row a leaf: tokens, target, whole epochs, and the cut key of the epoch that is taken in part.

    ``rows`` as from leaf_rows. Documents of the partial epoch are taken up to and including the cut key
    (null: none): in key order, as long as the running token sum doesn't exceed what is left.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    goal = leaf_targets(leaves.where("tokens > 0"), percent, max_epochs, weights)
    goal = goal.withColumns({"epochs": F.expr("target div tokens"), "left": F.expr("target % tokens")})
    goal = written(goal, "targets")
    keyed = rows.join(goal.select(*LEVELS, "epochs", "left"), list(LEVELS)).withColumn("key", order_key("epochs", seed))
    keyed = keyed.select(*LEVELS, "left", "key", "n_tokens")

    def narrow(base: DataFrame | None, at: int) -> DataFrame:
        """The next two hex digits of the key at which each leaf's prefix ends, with the tokens before."""
        inside = keyed.withColumn("spent", F.lit(0).cast("bigint")) if base is None else keyed.join(base.withColumnRenamed("left", "_l").drop("_l"), list(LEVELS)).where(F.col("key").startswith(F.col("head")))
        sums = inside.groupBy(*LEVELS, "left", "spent", F.substring("key", 1, at).alias("head")).agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy(*LEVELS).orderBy("head")
        sums = sums.withColumn("upto", F.col("spent") + F.sum("n").over(w))
        ends = sums.where(F.col("upto") > F.col("left"))
        first = ends.groupBy(*LEVELS, "left").agg(F.min(F.struct("head", "upto", "n")).alias("e"))
        return written(first.select(*LEVELS, "left", F.col("e.head").alias("head"), (F.col("e.upto") - F.col("e.n")).alias("spent")), "heads")

    one = narrow(None, 2)
    two = narrow(one, 4)
    last = keyed.join(two.drop("left"), list(LEVELS)).where(F.col("key").startswith(F.col("head")))
    run = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("spent") + F.sum("n_tokens").over(run)).where(F.col("upto") <= F.col("left"))
    cut = last.groupBy(*LEVELS).agg(F.max("key").alias("key"))
    return goal.join(two.drop("left", "spent"), list(LEVELS), "left").join(cut, list(LEVELS), "left").select(*LEVELS, "tokens", "target", "epochs", F.coalesce("key", "head").alias("cut"))


def choose(rows: DataFrame, leaves: DataFrame, seed: str = SEED) -> DataFrame:
    """``rows`` (with a leaf and doc_id) that the plan takes, with n_epochs, how often each is taken."""
    marked = rows.join(leaves.drop("tokens", "target"), list(LEVELS))
    extra = F.coalesce((order_key("epochs", seed) <= F.col("cut")).cast("bigint"), F.lit(0))
    return marked.withColumn("n_epochs", F.col("epochs") + extra).where("n_epochs > 0").drop("epochs", "cut")


def mix(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, weights: dict[str, dict[str, int]] | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and n_epochs of the documents taken.

    Repeated rows of one doc_id share a key and are taken or left together. A null text has no tokens; a
    row without doc_id has the key of an empty id. A leaf without any token has no target and supplies
    nothing. A source or language that is null counts with the empty name. Empty in, empty out.
    """
    rows = written(leaf_rows(docs, id_col, text, lang, source), "leaf_rows")
    return choose(rows, written(plan(rows, percent, max_epochs, seed, weights), "plan"), seed)


def sample(docs: DataFrame, percent: int = BUDGET_PERCENT, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that one epoch at most supplies, each once, with the columns of ``docs``.

    Rows of one doc_id and leaf share a key and are taken or left together. A null text has no tokens, a null doc_id
    the key of an empty id, and a null source or language the empty name. Columns of ``docs`` may have any names
    besides. Empty in, empty out.
    """
    rows = written(leaf_rows(docs), "leaf_rows")
    leaves = written(plan(rows, percent, 1, seed), "plan").select(*LEVELS, "epochs", "cut")
    whole = docs.select(F.struct("*").alias("row"))  # the row's own names can't clash
    row = F.col("row")
    domain = F.concat(F.lit("d"), (F.crc32(F.coalesce(row["source"], F.lit("")).cast("binary")) % 4).cast("string"))
    same = (domain == F.col("domain")) & (F.coalesce(row["lang"], F.lit("")) == F.col("lang")) & (F.coalesce(row["source"], F.lit("")) == F.col("source"))
    taken = (F.col("epochs") > 0) | (order_key("epochs", seed, row["doc_id"]) <= F.col("cut"))
    return whole.join(leaves, same & F.coalesce(taken, F.lit(False)), "left_semi").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _fill_sql(source: str, parents: str, name: str, keep: str) -> str:
    over = f"PARTITION BY {parents} ORDER BY cap / w, {name}"
    return f"""SELECT {keep}, CASE WHEN isfull THEN cap ELSE least(cap, ((budget - used) * w) // greatest(opn, 1)) END::HUGEINT AS got FROM (
  SELECT *, coalesce(sum(cap) FILTER (isfull) OVER (PARTITION BY {parents}), 0)::HUGEINT AS used,
         coalesce(sum(w) FILTER (NOT isfull) OVER (PARTITION BY {parents}), 0)::HUGEINT AS opn FROM (
  SELECT *, cap * onward <= w * (budget - bef) AS isfull FROM (
  SELECT *, coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS bef,
         (sum(w) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS onward FROM {source})))"""


def _domain_sql() -> str:
    """DuckDB has no crc32, so the domain of each source name is worked out here for the names src0 to src99 and the empty one."""
    from zlib import crc32

    names = ["", *(f"src{i}" for i in range(100))]
    return "CASE " + " ".join(f"WHEN src = '{n}' THEN 'd{crc32(n.encode()) % 4}'" for n in names) + " END"


def _case(column: str, weights: dict[str, int]) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END)::HUGEINT"


ORACLE = rf"""
WITH r0 AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS src,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS n FROM documents),
r AS (SELECT doc_id, {_domain_sql()} AS domain, lang, src, n FROM r0),
leaf AS (SELECT domain, lang, src, sum(n)::HUGEINT AS tokens, sum(n)::HUGEINT * {MAX_EPOCHS} AS cap FROM r GROUP BY ALL HAVING sum(n) > 0),
lg AS (SELECT domain, lang, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL),
dm AS (SELECT domain, sum(cap)::HUGEINT AS cap FROM lg GROUP BY ALL),
root AS (SELECT least(sum(cap), (sum(tokens)::HUGEINT * {BUDGET_PERCENT}) // 100)::HUGEINT AS budget FROM leaf),
top0 AS (SELECT domain, cap, budget, 0 AS r, {_case("domain", DOMAIN_WEIGHTS)} AS w FROM dm, root),
top AS ({_fill_sql("top0", "r", "domain", "domain")}),
mid0 AS (SELECT lg.domain, lang, lg.cap, got AS budget, {_case("lang", LANGUAGE_WEIGHTS)} AS w FROM lg JOIN top USING (domain)),
mid AS ({_fill_sql("mid0", "domain", "lang", "domain, lang")}),
low0 AS (SELECT leaf.domain, leaf.lang, src, tokens, cap, got AS budget, 1::HUGEINT AS w FROM leaf JOIN mid ON leaf.domain = mid.domain AND leaf.lang = mid.lang),
low AS ({_fill_sql("low0", "domain, lang", "src", "domain, lang, src, tokens")}),
goal AS (SELECT *, got // tokens AS epochs, got % tokens AS rest FROM low),
k AS (SELECT r.*, epochs, rest, md5('{SEED}:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM r JOIN goal ON r.domain = goal.domain AND r.lang = goal.lang AND r.src = goal.src),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, src ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, domain, lang, src AS source, n::BIGINT AS n_tokens, (epochs + (upto <= rest)::INT)::BIGINT AS n_epochs
FROM c WHERE epochs + (upto <= rest)::INT > 0
"""
