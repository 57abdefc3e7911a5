"""Fitted operators by held-out accuracy or against brute force; mixing against a plain allocation."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import language_id, mixing, neighbours, perplexity, toxicity
from tabulon.llm.graph import components

SF = "/root/testdata/sf0.001"
random.seed(5)


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_languages_held_out(spark):
    docs = read(spark, "documents")
    found = language_id.query(spark, SF).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.95


def test_language_of_odd_texts_and_mixtures(spark):
    en, de = "the weather with that other thing there ", "der nicht schöne und über auch schließlich "
    rows = [(i, (en if i % 2 else de) * 6, "en" if i % 2 else "de", 1) for i in range(1, 80)]
    odd = [(500, None, "en", 1), (501, "", None, 1), (502, "123 !?", "de", 1), (503, en * 10 + de * 10, "en", 1), (503, en * 10 + de * 10, "en", 1), (None, en, None, 1), (504, en * 3000, "en", 1)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    got = language_id.identify(d, language_id.train(d)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by[500]["score"] == 0.0
    assert set(by[503]["lang_mix"]) == {"de", "en"} and by[None]["lang_pred"] == "en" and set(by[504]["lang_mix"]) == {"en"}
    nothing = language_id.identify(d, language_id.train(d.limit(0)))
    assert {r[0] for r in nothing.select("lang_pred").distinct().collect()} == {"und"}
    assert sorted(r["doc_id"] for r in language_id.accept(d).where("doc_id >= 500").collect()) == [503, 503, 504]


def test_em_recovers_proportions():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(300) * 0.2, 3) + 1e-9
    p /= p.sum(1, keepdims=True)
    n = rng.multinomial(6000, 0.7 * p[0] + 0.3 * p[2]).astype(float)
    share, _ = language_id.mixture(p, n)
    assert np.abs(share - [0.7, 0, 0.3]).max() < 0.05


def test_toxic_documents_held_out(spark):
    calm, rude = "quiet river under green hills with people walking home".split(), ["morons", "gorbleg"]
    rows, labels = [], []
    for i in range(600):
        words = random.choices(calm, k=30)
        if i % 5 == 0:
            for term in rude:
                words[random.randrange(30)] = term
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000, "quiet river gorblegg walking", 0.5), (1001, None, 0.5), (1002, "", 0.5), (1003, "gorbleg " * 9000, 0.5), (None, "quiet", 0.5), (1002, "", 0.5)]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    assert "gorbleg" in model.terms
    by = {r["doc_id"]: r["score"] for r in toxicity.rate(d, model).collect()}
    held = [i for i in range(600) if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(by[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    assert by[1001] == by[1002] < 0.5 < by[1003]
    assert toxicity.rate(d, toxicity.train(d, lab.limit(0))).agg(F.max("score")).first()[0] < 0.5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_the_automaton_accepts_what_is_within_one_edit():
    terms = ["idiot", "moron", "trash", "stupid", "stupor"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 2.0), {})
    words = {t[:i] + c + t[j:] for t in terms for i in range(len(t) + 1) for j in (i, i + 1, i + 2) for c in ("", "x", "o")} | {"", "a", "stup", "idiotx y"}
    for w in words:
        assert bool(lexicon.fuzzy(w)) == any(distance(w, t) <= 1 for t in terms), w


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {})
    quoted = dict(zip(toxicity.FEATURES, lexicon.features('he said "you idiot" to them')))
    plain = dict(zip(toxicity.FEATURES, lexicon.features("you idiot idiot")))
    assert quoted["quoted"] > 0 == plain["quoted"] and plain["dense"] > 0 == quoted["dense"]


def plain_kneser_ney(texts, order=4):
    """Probabilities from dictionaries, as the definition has it."""
    counts = [None] * (order + 1)
    counts[order] = Counter(int(g) for t in texts for g in perplexity.grams(t))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g & ((1 << (12 * k)) - 1) for g in counts[k + 1])

    def d(k):
        n = Counter(min(c, 5) for c in counts[k].values())
        if not n[1] or not n[2] or not n[3]:
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw))

    cuts = {k: d(k) for k in range(1, order + 1)}
    by_context = {k: defaultdict(list) for k in cuts}
    for k in cuts:
        for g, c in counts[k].items():
            by_context[k][g >> 12].append(c)

    def p(g, k, v):
        low = 1 / v if k == 1 else p(g & ((1 << (12 * (k - 1))) - 1), k - 1, v)
        seen = by_context[k].get(g >> 12)
        if not seen:
            return low
        cut = lambda c: 0 if c == 0 else cuts[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return (max(c - cut(c), 0) + sum(map(cut, seen)) * low) / sum(seen)

    return p


def test_perplexity_is_kneser_neys(spark):
    texts = ["the cat sat on the mat and the dog ran", "a dog and a cat ran to the mat", "zzz qqq", "", None, "the cat " * 500]
    held = next(i for i in range(10, 99) if crc32(str(i).encode()) % 5 == 0)
    ids = [i if crc32(str(i).encode()) % 5 else i + 1000 for i in range(len(texts))]
    ids[1] = held  # the one trusted text that the model doesn't learn from
    d = spark.createDataFrame([(i, t, "en" if k else None, 1) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, text string, lang string, perplexity int")
    good = lambda t: bool(t) and "z" not in t
    found = {r["doc_id"]: r for r in perplexity.judge(d, trust=good).collect()}
    got = [found[i] for i in ids]
    p = plain_kneser_ney([t for i, t in zip(ids, texts) if good(t) and crc32(str(i).encode()) % 5])
    v = len({int(s) for t in texts for s in perplexity.symbols(t)}) + 1
    for i, t in enumerate(texts):
        logs = [math.log(p(int(g), 4, v)) for g in perplexity.grams(t)]
        assert got[i]["perplexity"] == np.float64(math.exp(-sum(logs) / len(logs))).round(9) or abs(got[i]["perplexity"] - math.exp(-sum(logs) / len(logs))) < 1e-6
        assert got[i]["n_grams"] == len(logs)
    assert not got[3]["kept"] and not got[4]["kept"] and got[1]["kept"] and not got[2]["kept"]
    assert perplexity.judge(d.limit(0)).count() == 0


def test_probabilities_sum_to_one(spark):
    d = spark.createDataFrame([(1, "abab abba baab " * 9, "en")], "doc_id long, text string, lang string")
    found = perplexity.blocked(perplexity._source(d, "doc_id", "lang", "text"), lambda t: True)
    found = found.select(F.explode(F.arrays_zip("gram", "n")).alias("g")).select("g.*")
    grams = np.unique(np.concatenate([perplexity.grams("abab abba baab " * 9)]))
    letters, some = sorted({int(g) & 4095 for g in grams}), int(grams[5]) >> 12
    every = spark.createDataFrame([(some << 12 | w, 0) for w in letters], "gram long, n long")
    logp = perplexity.probabilities(found.unionByName(every)).where(F.shiftright("gram", 12) == some).collect()
    v = len(letters) + 1
    total = sum(math.exp(r["logp"]) for r in logp)
    assert len(logp) == len(letters) and 1 - 1 / v <= total <= 1 + 1e-9


def test_nearest_have_the_recall_and_the_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 24))  # four times the rows that nearness is estimated from
    x[100:400] = x[100]
    assert len(x) - 300 > 4 * neighbours.SAMPLE
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5020, [0.0] * 24, 1), (5040, [float("nan")] + [1.0] * 23, 1), (5060, [None] + [1.0] * 23, 1), (None, x[0].tolist(), 1), (40, x[40].tolist(), 1), (5080, [1.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = defaultdict(list)
    for r in neighbours.search(d, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 9000, 20))
    recall = []
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        best = sorted((i for i in range(9000) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and max(abs(s[v] - y) for _, v, y in found) < 1e-9
        recall.append(len({v for _, v, _ in found} & set(best)) / 20)
        if q in range(100, 400) and found[0][2] == s[best[0]]:
            assert [v for _, v, _ in found] == best
    assert np.mean(recall) >= 0.9
    assert neighbours.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_query_with_few_rows_in_its_buckets_meets_all(spark):
    x = np.random.default_rng(3).normal(size=(9, 8))
    d = spark.createDataFrame([(20 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.search(d, F.col("vec_id") >= 0).collect()}
    for q in range(9):
        assert [got[20 * q, k] for k in range(1, 9)] == [20 * i for i in sorted((i for i in range(9) if i != q), key=lambda i: -(x[q] @ x[i]))]


def test_buckets_are_visited_in_order_of_their_chance():
    h = neighbours.Hashes.drawn(6, 1.0, 3, 1)
    q = np.random.default_rng(4).normal(size=(5, 6))
    p = h.chances(q, 0)
    assert np.allclose(p.sum(2), 1)
    for r, (buckets, first) in enumerate(h.visits(q, 0, 0.97)):
        every = {a | b << 3 | c << 6: p[r, 0, a] * p[r, 1, b] * p[r, 2, c] for a in range(8) for b in range(8) for c in range(8)}
        order = sorted(every.values(), reverse=True)
        got = [every[b] for b in buckets.tolist()]
        assert np.allclose(got, order[: len(got)]) and sum(got[:-1]) < 0.97 <= sum(got) and sum(got[: first - 1]) < neighbours.FIRST <= sum(got[:first])


def plain_fill(budget, nodes):
    """Shares of (name, weight, cap) by repeated filling."""
    got, open_ = {}, sorted(nodes, key=lambda n: (n[2] / n[1], n[0]))
    while open_:
        w = sum(n[1] for n in open_)
        name, weight, cap = open_[0]
        if cap * w <= weight * budget:
            got[name], budget, open_ = cap, budget - cap, open_[1:]
        else:
            got |= {n: min(c, budget * k // w) for n, k, c in open_}
            break
    return got


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * random.randrange(0, 60)), random.choice(["en", "de", "fr", None]), random.choice(["src0"] * 6 + ["src1", "src2", "src3", None]), 1) for i in range(700)]
    rows += [rows[3], rows[3], (None, "a b c", "en", "src0", 1), (900, None, "en", "src9", 1), (901, "x " * 5000, "es", "src0", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int")
    got = mixing.mix(d).collect()
    leaf = lambda r: (f"d{crc32((r[3] or '').encode()) % 4}", r[2] or "", r[3] or "")
    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += len((r[1] or "").split())
    tokens = {k: v for k, v in tokens.items() if v}
    cap = lambda *at: sum(2 * v for k, v in tokens.items() if k[: len(at)] == at)
    top = plain_fill(min(cap(), sum(tokens.values()) * 60 // 100), [(a, mixing.DOMAIN_WEIGHTS[a], cap(a)) for a in {k[0] for k in tokens}])
    want = Counter()
    for a, b in top.items():
        mid = plain_fill(b, [(x, mixing.LANGUAGE_WEIGHTS.get(x, 1), cap(a, x)) for x in {k[1] for k in tokens if k[0] == a}])
        for x, c in mid.items():
            for y, t in plain_fill(c, [(y, 1, cap(a, x, y)) for y in {k[2] for k in tokens if k[:2] == (a, x)}]).items():
                own = [r for r in rows if leaf(r) == (a, x, y)]
                epochs, left = divmod(t, tokens[a, x, y])
                key = lambda r: hashlib.md5(f"{mixing.SEED}:{epochs}:{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: B023, E731
                for r in own:
                    upto = sum(len((o[1] or "").split()) for o in own if key(o) <= key(r))
                    if n := epochs + (upto <= left):
                        want[r[0], n] += 1
    assert Counter((r["doc_id"], r["n_epochs"]) for r in got) == want
    assert mixing.mix(d.limit(0)).count() == 0
    once = mixing.sample(d)
    assert once.columns == d.columns and 0 < once.count() < len(rows)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_text_is_held_to_the_quantile_itself(spark):
    rows = perplexity.judge(read(spark, "documents")).collect()
    own = defaultdict(list)
    for r in rows:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["trusted"] and r["held_out"]:
            own[r["lang"]].append(r["perplexity"])
    assert own and all(r["threshold"] in own[r["lang"]] for r in rows if own[r["lang"]])
    long = [r for r in rows if r["n_grams"] > perplexity.LEAST_CHARS]
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in long)
    assert any(r["threshold"] < r["perplexity"] <= 1.25 * r["threshold"] for r in long)


def test_no_two_code_points_share_symbols_and_scripts_without_spaces_are_trusted():
    every = [chr(c) for c in [*range(14, 0x3100), *range(0x4E00, 0x5200), *range(0xAC00, 0xB000), 0xFFFD, 0x1F600, 0x10FFFF] if chr(c).lower() == chr(c)]
    assert len({tuple(perplexity.symbols(c)) for c in every}) == len(every)
    assert max(int(perplexity.symbols(c).max()) for c in every) < 1 << perplexity.BITS
    rng = random.Random(1)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    hindi = [a + b for a in ("नमस्ते", "दुनिया", "हिन्दी", "भाषा", "किताब", "विद्यालय") for b in ("", "में", "से", "की", "को", "ने", "पर")]
    assert perplexity.trusted("".join(f"{han(12)}，{han(9)}。" for _ in range(20)))
    assert perplexity.trusted("".join(chr(0xE01 + rng.randrange(44)) for _ in range(300)))
    assert perplexity.trusted(" ".join(rng.choice(hindi) for _ in range(90)))
    assert not perplexity.trusted("天气" * 200) and not perplexity.trusted("天气 1234 # " * 60)


def test_an_even_mixture_of_four_languages_is_accepted(spark):
    words = {"en": "the weather with that other thing there ", "de": "der nicht schöne und über auch schließlich ", "fr": "où les garçons étaient très fatigués hier soir ", "es": "mañana el niño pequeño quería jugar allí "}
    rows = [(4 * i + k, t * 6, lang) for i in range(1, 40) for k, (lang, t) in enumerate(words.items())]
    d = spark.createDataFrame([*rows, (500, "".join(t * 10 for t in words.values()), "en"), (501, "12 34", "en")], "doc_id long, text string, lang string")
    found = language_id.identify(d, language_id.train(d)).where("doc_id = 500").first()
    assert len(found["lang_mix"]) == 4 and found["score"] < 0.3
    assert [r["doc_id"] for r in language_id.accept(d).where("doc_id >= 500").collect()] == [500]


def test_perplexity_of_a_joined_input_in_many_blocks(spark, monkeypatch):
    docs = read(spark, "documents")
    want = {r["doc_id"]: (r["perplexity"], r["kept"]) for r in perplexity.judge(docs).collect()}
    monkeypatch.setattr(perplexity, "BLOCK_CHARS", 5000)
    other = read(spark, "labels").select(F.col("doc_id").alias("other")).groupBy("other").count()
    got = perplexity.judge(docs.join(other, docs.doc_id == other.other, "left").repartition(7)).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r["perplexity"] - want[r["doc_id"]][0]) < 1e-9 and r["kept"] == want[r["doc_id"]][1]
