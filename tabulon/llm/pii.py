"""Personal data in texts: strict base rules, and further spans chosen by boosted trees.

The base rules find e-mail addresses, IP addresses, card numbers and phone numbers. Besides, generators
of high recall propose overlapping spans of these kinds and of secrets (keys, tokens), which no base rule finds.
Gradient-boosted trees score each proposal by its format and its context; they are fitted on a bounded sample of
proposals. Personal data are, besides what a base rule of the kind accepts, the same spans with the trait that the
rule checks altered (an address with (at), a mistyped card number, a phone number without its plus), proposals with
evidence of format and context, and secrets that are assigned to a telling name, also out of that context.
A threshold of each kind is calibrated by score histograms over the whole fold that the trees don't learn from.

Texts are handled by DataFrame functions alone: spans are arrays inside the row, nothing is shuffled.
Patterns are written so that matching never goes back: a run is only tried from its first character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import hash_below, held_out, let, share_of, table, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds of added spans: those of the base rules, and one that has none.
EVERY = (*KINDS, "secret")
SECRET = len(KINDS)
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only runs of 13 to 19 digits, as whole as the plain pattern takes them
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|＠|\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]++(?:[.,:][0-9]++){3}+(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]{0,2}+[0-9]){11,}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])\(?[0-9]++\)?(?:[\x20./-]{0,2}+\(?[0-9]++\)?)*+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+=*+",
}
#: What a proposal must have besides: a short number alone is no phone number.
PROPOSED: dict[str, Callable[[Column], Column]] = {"phone": lambda m: m.rlike("[0-9][^0-9]+[0-9]") | (n_digits(m) >= 7)}
FEATURES = ("digits", "length", "separators", "groups", "longest_group", "first_digit", "at", "dots", "brackets", "left_space", "left_equals", "left_cue", "right_space", "right_word", "others", "letters", "capitals", "hexadecimal", "left_secret")
CUES = r"(?i)(tel|phone|call|fax|mobil|card|visa|ip|host|server|addr|mail|contact|correo|karte|carte)"
SECRET_CUES = r"(?i)(token|secret|passw|pwd|api|key|auth|bearer|credential)"
#: Documents that the trees' sample is drawn from, and trees.
SAMPLE_DOCS = 20_000
TREES = 24
PRECISION = 0.98
LEAST_SEEN = 30
#: Scores of a histogram's bin are one by this apart; formats are learned from so many altered spans, the commonest.
BINS = 100
LEAST_FORMAT = 5
FORMATS = 50


def located(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """array<struct<start, match, left, right>> of the valid matches; left and right: what stands between matches."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))

    def spans(s: Column) -> Column:
        numbered = F.transform(s["m"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        return F.transform(
            F.filter(numbered, lambda e: valid(e["x"])),
            lambda e: F.struct(
                (total(F.slice(s["p"], 1, e["i"] + 1)) + total(F.slice(s["m"], 1, e["i"]))).alias("start"),
                e["x"].alias("match"),
                F.right(F.get(s["p"], e["i"]), F.lit(24)).alias("left"),
                F.left(F.get(s["p"], e["i"] + 1), F.lit(12)).alias("right"),
            ),
        )

    return let(found, spans)


def n_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def luhn(m: Column) -> Column:
    def total(rev: Column) -> Column:
        doubled = F.transform(F.sequence(F.lit(1), F.length(rev)), lambda i: F.substring(rev, i, F.lit(1)).cast("int") * (2 - i % 2))
        return F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))

    return let(F.reverse(F.regexp_replace(m, "[^0-9]", "")), total) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.lit(False))),
    "card": luhn,
    "phone": lambda m: n_digits(m).between(9, 15),
}


#: A base span with the trait changed that its rule checks.
ALTERED: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.replace(m, F.lit("@"), F.lit("(at)")),
    "ip": lambda m: F.regexp_replace(m, "^[0-9]+", "392"),
    "card": lambda m: F.concat(F.left(m, F.length(m) - 1), ((F.right(m, F.lit(1)).cast("int") + 1) % 10).cast("string")),
    "phone": lambda m: F.substring(m, 2, 1000),
}


def gate(kind: str, text: Column) -> Column:
    """Cheap tests that a text must pass before a pattern is tried."""
    if kind == "email":
        return text.rlike(r"[@＠]|[(\[{]at[)\]}]")
    return text.rlike("[0-9]")


NO_SPANS = "array<struct<start:int,match:string,left:string,right:string>>"


def gated(kind: str, text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    return F.when(gate(kind, text), located(text, pattern, valid)).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> Column:
    """array<struct<kind (index), start, end>> of the base rules, by kind and start."""

    def of(k: int, kind: str) -> Column:
        return F.transform(gated(kind, text, BASE[kind], VALID[kind]), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def features(c: Column, others: Column) -> Column:
    """The features of a proposal as array<double>, in the order of FEATURES; others: the text's base spans."""
    m, left, right = c["match"], c["left"], c["right"]
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    cols = [
        n_digits(m),
        F.length(m),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")),
        F.size(groups),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        F.coalesce(F.regexp_extract(m, "([0-9])", 1).try_cast("int"), F.lit(-1)),
        m.contains("@"),
        F.length(m) - F.length(F.replace(m, F.lit("."), F.lit(""))),
        m.rlike(r"[()\[\]]"),
        left.rlike(r"(^|\s)\+?$"),
        left.rlike(r"[=:\"]\s?\S?$"),
        left.rlike(CUES),
        right.rlike(r"^($|\s)"),
        right.rlike(r"^[A-Za-z0-9_]"),
        others,
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(m, "[^A-Z]", "")),
        m.rlike("^[0-9a-f]+$") | m.rlike("^[0-9A-F]+$"),
        left.rlike(SECRET_CUES),
    ]
    return F.array(*(x.cast("int").cast("double") for x in cols))


def proposals(text: Column, base: Column, others: Column | None = None) -> Column:
    """array<struct<kind, start, end, match, strict, covered, f>>: proposals of all generators; strict: a base span of the kind overlaps."""

    def of(k: int, kind: str) -> Column:
        def one(s: Column) -> Column:
            end = s["start"] + F.length(s["match"])
            return F.struct(
                F.lit(k).alias("kind"),
                s["start"].alias("start"),
                end.alias("end"),
                s["match"].alias("match"),
                F.exists(base, lambda b: (b["kind"] == k) & (b["start"] < end) & (s["start"] < b["end"])).alias("strict"),
                F.exists(base, lambda b: (b["start"] < end) & (s["start"] < b["end"])).alias("covered"),
                features(s, F.size(base) if others is None else others).alias("f"),
            )

        return F.transform(gated(kind, text, GENERATORS[kind], PROPOSED.get(kind, lambda m: F.lit(True))), one)

    return F.concat(*(of(k, kind) for k, kind in enumerate(EVERY)))


class Trees:
    """Boosted trees of depth two for log-odds, and a threshold of each kind."""

    def __init__(self) -> None:
        self.start, self.trees = 0.0, []
        self.threshold = {k: float("inf") for k in range(len(EVERY))}

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float]:
        best = (0.0, -1, 0.0)
        all_g, all_h = g.sum(), h.sum()
        for j, cut in enumerate(cuts):
            for t in cut:
                low = x[:, j] <= t
                gl, hl = g[low].sum(), h[low].sum()
                if min(hl, all_h - hl) < 1:
                    continue
                gain = gl**2 / (hl + 1) + (all_g - gl) ** 2 / (all_h - hl + 1) - all_g**2 / (all_h + 1)
                if gain > best[0] + 1e-9:
                    best = (float(gain), j, float(t))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray, rate: float = 0.3) -> Trees:
        p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p0 / (1 - p0)))
        score = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 12)))[:12] for j in range(x.shape[1])]
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            _, j, t = self._split(x, g, h, cuts)
            if j < 0:
                break
            sides = []
            for side in (x[:, j] <= t, x[:, j] > t):
                _, k, u = self._split(x[side], g[side], h[side], cuts)
                below = x[:, k] <= u if k >= 0 else np.ones(len(x), bool)
                leaves = [float(rate * g[side & b].sum() / (h[side & b].sum() + 1)) for b in (below, ~below)]
                score[side & below] += leaves[0]
                score[side & ~below] += leaves[1]
                sides.append((max(k, 0), u if k >= 0 else float("inf"), leaves[0], leaves[1]))
            self.trees.append((j, t, sides))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, t, (low, high) in self.trees:
            for side, (k, u, a, b) in ((x[:, j] <= t, low), (x[:, j] > t, high)):
                out += np.where(side, np.where(x[:, k] <= u, a, b), 0.0)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> Trees:
        """The least score above which enough proposals of the kind were seen, nearly all of them accepted."""
        score = self.score(x)
        for k in self.threshold:
            own, hit = score[kind == k], y[kind == k]
            order = np.argsort(-own, kind="stable")
            right, seen = np.cumsum(hit[order]), np.arange(1, len(order) + 1)
            good = np.flatnonzero((seen >= LEAST_SEEN) & (right >= PRECISION * seen))
            good = good[own[order][good] > np.concatenate([own[order], [-np.inf]])[good + 1]] if len(good) else good  # ties stay together
            if len(good):
                self.threshold[k] = float(own[order][good[-1]])
        return self

    def calibrate_counts(self, counts: list[tuple[int, int, int, int]]) -> Trees:
        """The same from a histogram: (kind, bin, proposals, accepted ones) of scores from bin / BINS on."""
        for k in self.threshold:
            seen = right = 0
            for _, at, n, hit in sorted((c for c in counts if c[0] == k), key=lambda c: -c[1]):
                seen, right = seen + n, right + hit
                if seen >= LEAST_SEEN and right >= PRECISION * seen:
                    self.threshold[k] = at / BINS
        return self

    def column(self, f: Column) -> Column:
        def leaf(side: tuple) -> Column:
            k, u, a, b = side
            return F.lit(a) if u == float("inf") else F.when(f[k] <= u, a).otherwise(b)

        out = F.lit(self.start)
        for j, t, (low, high) in self.trees:
            out = out + F.when(f[j] <= t, leaf(low)).otherwise(leaf(high))
        return out

    def reaches(self, kind: Column, score: Column) -> Column:
        out = F.lit(False)
        for k, t in self.threshold.items():
            if t != float("inf"):
                out = out | ((kind == k) & (score >= t - 1e-9))
        return out


def format_of(m: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(m, "[0-9]", "9"), "[A-Za-z]+", "a")


def assigned(c: Column) -> Column:
    """Whether a secret stands as the value of a name that tells of one."""
    return (c["kind"] == SECRET) & (c["f"][10] > 0) & (c["f"][18] > 0)


def evident(c: Column, formats: dict[int, list[str]]) -> Column:
    """Whether format and context speak for a proposal: a written-out at sign; a cue before it, or a format of altered spans."""
    digits, dots, cue = c["f"][0], c["f"][7], c["f"][11] > 0
    known = lambda k: format_of(c["match"]).isin(formats[k]) if formats.get(k) else F.lit(False)
    return (
        F.when(c["kind"] == 0, c["match"].rlike(r"[(\[{]at[)\]}]|＠"))
        .when(c["kind"] == 1, (cue & (dots == 3)) | known(1))
        .when(c["kind"] == 2, digits.between(13, 19) & (cue | known(2)))
        .when(c["kind"] == SECRET, assigned(c))
        .otherwise(digits.between(9, 15) & (cue | known(3)))
    )


def proposed(rows: DataFrame) -> DataFrame:
    """c: the proposals of ``rows`` (text), but for those that meet a base span of another kind and can't be added."""
    found = rows.select(F.explode(let(base_spans(F.col("text")), lambda b: proposals(F.col("text"), b))).alias("c"))
    return found.where(F.col("c.strict") | addable(F.col("c")))


def addable(c: Column) -> Column:
    """A secret may hold what a base rule takes for a card number; other proposals don't add to base spans that they meet."""
    return ~c["covered"] | (c["kind"] == SECRET)


def altered(rows: DataFrame) -> DataFrame:
    """c: the proposals that meet the base spans of ``rows`` (text), each altered within its own context; and assigned secrets without theirs."""

    def of(k: int, kind: str, text: Column) -> Column:
        return F.transform(gated(kind, text, BASE[kind], VALID[kind]), lambda s: F.struct(F.lit(k).alias("kind"), s["left"].alias("left"), ALTERED[kind](s["match"]).alias("match"), s["right"].alias("right")))

    spans = rows.select(F.concat(*(of(k, kind, F.col("text")) for k, kind in enumerate(KINDS))).alias("all")).select(F.explode("all").alias("s"), (F.size("all") - 1).alias("others"))
    parts = spans.select("s.kind", "others", F.length("s.left").alias("at"), (F.length("s.left") + F.length("s.match")).alias("to"), F.concat("s.left", "s.match", "s.right").alias("text"))
    secrets = proposed(rows).where(assigned(F.col("c"))).select("c.match", F.col("c.f")[14].cast("int").alias("others"))
    parts = parts.unionByName(secrets.select(F.lit(SECRET).alias("kind"), "others", F.lit(1).alias("at"), (F.length("match") + 1).alias("to"), F.concat(F.lit(" "), "match", F.lit(" ")).alias("text")))
    found = parts.select("kind", "at", "to", F.explode(let(base_spans(F.col("text")), lambda b: proposals(F.col("text"), b, F.col("others")))).alias("c"))
    return found.where((F.col("c.kind") == F.col("kind")) & addable(F.col("c")) & (F.col("c.start") < F.col("to")) & (F.col("c.end") > F.col("at"))).select("c")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text: str = "text") -> Trees:
    """Trees fitted on the proposals of about ``sample_docs`` documents, chosen by a hash of the id, and calibrated on all held-out ones.

    Null texts and texts without a digit or an at sign propose nothing. Rows that repeat an id are held out, or chosen,
    together; a null id is held out. Among splits of equal gain the first feature and the least cut are taken. An empty
    table, or one without both kinds of proposal, gives trees that add nothing.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull() & F.col("text").rlike(r"[0-9@＠]|[(\[{]at[)\]}]"))
    # written first: Spark would else work out the proposals of every row before it tests the hash
    fold = written(rows.where(~held_out() & hash_below(share_of(docs.count(), sample_docs), "doc_id", seed=29)), "fold")
    test = written(rows.where(held_out()).select("text"), "test")
    changed = altered(fold).select("c.kind", format_of(F.col("c.match")).alias("format"), "c.f").collect()
    formats: dict[int, list[str]] = {}
    for k in range(1, SECRET):
        seen = Counter(r["format"] for r in changed if r["kind"] == k and not r["format"].isdigit())
        formats[k] = [f for f, n in sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:FORMATS] if n >= LEAST_FORMAT]
    label = F.col("c.strict") | (addable(F.col("c")) & evident(F.col("c"), formats))
    got = [(r[0], float(r[1]), r[2]) for r in proposed(fold).select("c.kind", label, "c.f").collect()] + [(r["kind"], 1.0, r["f"]) for r in changed]
    if not got:
        return Trees()
    kind, y = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    if not 0 < y.sum() < len(y):
        return Trees()
    trees = Trees().fit(np.column_stack([np.array([r[2] for r in got], float), kind]), y)
    every = proposed(test).select("c", label.alias("y")).unionByName(altered(test).select("c", F.lit(True).alias("y")))
    at = F.floor(trees.column(F.concat("c.f", F.array(F.col("c.kind").cast("double")))) * BINS)
    counts = every.groupBy(F.col("c.kind").alias("kind"), at.alias("at")).agg(F.count("*").alias("n"), F.count_if("y").alias("hit")).collect()
    return trees.calibrate_counts([tuple(r) for r in counts])


def all_spans(text: Column, trees: Trees) -> Column:
    """struct<base, added>: arrays of struct<kind, start, end>; added spans overlap no better added one and, but for secrets, no base span."""

    def scored(b: Column) -> Column:
        marked = F.transform(
            F.filter(proposals(text, b), addable),
            lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), trees.column(F.concat(c["f"], F.array(c["kind"].cast("double")))).alias("score")),
        )
        return F.filter(marked, lambda c: trees.reaches(c["kind"], c["score"]))

    def best(s: Column) -> Column:
        rank = lambda c: F.struct(-c["score"], c["start"], c["kind"], c["end"])
        kept = F.filter(s, lambda c: ~F.exists(s, lambda o: overlap(o, c) & (rank(o) < rank(c))))
        return F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    if not any(t != float("inf") for t in trees.threshold.values()):
        return let(base_spans(text), lambda b: F.struct(b.alias("base"), F.slice(b, 1, 0).alias("added")))
    return let(base_spans(text), lambda b: F.struct(b.alias("base"), let(scored(b), best).alias("added")))


def find(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``base`` and ``spans``: arrays of struct<kind, start, end> by kind, then start.

    Offsets are code points, ends exclusive. A null or empty text has no spans. Rows are independent, so
    repeated rows and null ids pass through; an empty table gives an empty table.
    """
    got = docs.select(*keep, all_spans(F.coalesce(F.col(text).cast("string"), F.lit("")), trees).alias("_spans"))
    return got.select(*keep, F.col("_spans.base").alias("base"), F.array_sort(F.concat("_spans.base", "_spans.added")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, EVERY))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", trees: Trees | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans are replaced as one.

    ``n_chars``, where there is one, follows the new text. A null text stays null, an empty one empty. Rows are
    independent, so repeated rows and null ids pass through; other columns stay as they are. Empty in, empty out.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in EVERY))
    t = F.col(text)

    def cut(spans: Column) -> Column:
        by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        put = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
        return F.aggregate(by_start, begin, put, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))

    spans = let(all_spans(t, trees or train(docs, text=text)), lambda s: F.concat(s["base"], s["added"]))
    new = F.when(t.isNull(), t).otherwise(let(spans, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(t)))
    out = docs.withColumn(text, new)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
