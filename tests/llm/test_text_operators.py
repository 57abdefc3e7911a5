"""Operators on texts against plain versions: tokens, quality counts, fingerprints, personal data, main text."""

import hashlib
import random
import re

import numpy as np
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import bpe, main_text, pii, quality_rules, simhash

random.seed(3)
WORDS = ["alpha", "beta", "gamma", "delta", "x1", "naïve", "#tag", "|", "end."]
#: Nulls, empty and very long texts, ties, repeated rows.
ODD = [None, "", " \n\t", "a", "a b", "a b c", "x" * 20_000, ("word " * 9 + "\n") * 400, "same text here", "same text here", "É ß 日本語 😀 end", "l1\nl1\n\nl2\nl1"]
TEXTS = ODD + [" ".join(random.choices(WORDS, k=random.randrange(1, 90))) for _ in range(40)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, ids int"


def docs(spark, texts=TEXTS, source="s"):
    rows = [(i if i != 5 else None, t, None if i == 3 else "en", None if i == 4 else source, 0, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary()


def test_bpe_equals_tiktoken_and_round_trips(spark, vocabulary):
    tokens = bpe.load_ranks(vocabulary[0])
    known = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    d = docs(spark, [*TEXTS, "<|endoftext|>", "='" * 900, "1234567890" * 90])
    got = bpe.round_trip(d, *vocabulary, keep=("doc_id", "text")).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert r["ids"] == known.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    one = bpe.digests(bpe.round_trip(d.where("doc_id = 4"), *vocabulary)).first()
    ids = known.encode_ordinary(TEXTS[4])
    assert tuple(one)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TEXTS[4].encode()).hexdigest())
    assert bpe.round_trip(d.limit(0), *vocabulary).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_bpe_on_any_text(text):
    codec, known = _codec()
    ids, counts = codec.encode([text])
    assert ids.tolist() == known.encode_ordinary(text) and codec.decode(ids, counts)[0].tobytes().decode() == text


def _codec(memo={}):  # noqa: B006
    if not memo:
        data, pattern = bpe.vocabulary()
        tokens = bpe.load_ranks(data)
        memo["c"] = bpe.Codec(tokens, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return memo["c"]


def test_long_and_short_merges_agree():
    codec, _ = _codec()
    for word in ("abcabc" * 70, "ththeheinin" * 40):
        assert codec.merge_long(word.encode()).tolist() == codec.merge_matrix([word.encode()], 512)[0].tolist()


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(8)} if len(wins) < 500 else None
    if hit is None:
        from collections import Counter

        n = Counter(wins)
        hit = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(8)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts_and_verdicts(spark):
    got = quality_rules.judge(docs(spark)).collect()
    assert len(got) == len(TEXTS)
    want = sorted(plain_counts(t) for t in TEXTS)
    assert sorted(tuple(r[c] for c in quality_rules.COUNTS) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(docs(spark).limit(0)).count() == 0


def test_a_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(40))
    bad = spark.createDataFrame([(i, "short" if i % 10 else good, "bad") for i in range(200)] + [(1000 + i, good if i % 21 else "short", f"g{i % 5}") for i in range(500)], "doc_id long, text string, source string")
    got = quality_rules.judge(bad).groupBy("host").agg(F.count_if("kept").alias("k"), F.first("host_rate").alias("r")).collect()
    rows = {r["host"]: (r["k"], r["r"]) for r in got}
    assert rows["bad"][0] == 0 and 0.5 < rows["bad"][1] < 0.91
    assert all(k > 80 for h, (k, _) in rows.items() if h != "bad")


def plain_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = list(root)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


@pytest.mark.parametrize("most, common", [(4096, 1000), (2, 1000), (4096, 20)])
def test_simhash_groups(spark, monkeypatch, most, common):
    monkeypatch.setattr("tabulon.llm.common.COMMON", common)
    long = [" ".join(random.choices(WORDS, k=400)) for _ in range(6)]
    texts = TEXTS + long + [t + " tail" for t in long] + [t.upper() for t in long]
    got = simhash.groups(docs(spark, texts), most=most).collect()
    assert len(got) == len(texts)
    prints = [plain_print(t) for t in texts]
    part, least = plain_components(prints), {}
    for i, p in enumerate(prints):
        if i != 5:
            least[part[p]] = min(least.get(part[p], i), i)
    want = sorted((-1 if i == 5 else i, p, least.get(part[p], -1)) for i, p in enumerate(prints))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fp"] % (1 << 64), -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    assert simhash.groups(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n", [5, 300])
def test_bit_sliced_pairs(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n // 3 + 1).astype(np.uint64)
    x = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6), base ^ np.uint64(7 << 40)]))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 2}
    assert set(zip(*map(list, simhash.bucket_pairs(x)))) == want
    assert set(zip(*map(list, simhash.shifted_pairs(x, np.zeros(len(x), np.int64))))) == want


def test_deduplicate_keeps_one_of_each(spark):
    d = docs(spark, ["one two three four", "one two three four", "five six seven eight nine", None, "", "a", "q r s t"])
    kept = simhash.deduplicate(d.union(d.where("doc_id = 2")))
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 0, 2, 3, 6]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if accepted(k, m[0]))


PERSONAL = [
    "a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890123 5 4111111111111111  4111111111111111",
    "+1 (555) 555-1234, +49.30.1234567- x +1", "+ +1+2 (3) 4567890-", "é +1 (555) 555-1234 ñ@b.de x@@y.z a@b..c", "😀 joe@x.org 4111111111111111", "9 9-9 9" * 30, "0" * 5000, "a" * 5000 + "@", "1.1.1.1 " * 300,
]


def test_base_spans(spark):
    alphabet = "a1 2@.+-(4"
    texts = [*ODD, *PERSONAL, *("".join(random.choices(alphabet, k=60)) for _ in range(120))]
    d = docs(spark, texts)
    got = pii.find(d, pii.Trees(), keep=("text",)).select("text", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["b"] == plain_spans(r["text"]) == r["s"]


def test_chosen_spans_add_to_base_ones_and_are_redacted(spark):
    good = [f"mail me at user{i}@site{i % 7}.example.org today" for i in range(150)]
    near = ["write to someone(at)site.example.org today"]
    d = docs(spark, [*good, *near, None, ""])
    trees = pii.train(d)
    found = pii.find(d, trees, keep=("text",)).collect()
    assert all({tuple(b) for b in r["base"]} <= {tuple(s) for s in r["spans"]} for r in found)
    out = pii.redact(d, trees=trees)
    assert out.columns == d.columns
    texts = [r["text"] for r in out.collect()]
    assert texts[:150] == ["mail me at [EMAIL] today"] * 150 and texts[-2:] == [None, ""]


def test_spans_that_miss_only_the_checked_trait_are_added_where_they_are_common(spark):
    rng = random.Random(4)
    number = lambda: f"{rng.randrange(10, 99)} ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    good = [f"mail user{i}@site{i % 7}.org or ring +{number()} at noon" for i in range(400)]
    near = [f"mail user{i}(at)site{i % 7}.org or ring {number()} at noon" for i in range(400)]
    other = [f"in {1900 + i % 90} some {i} of {i * 7} were 3.5 or 12-{i % 60}" for i in range(400)]
    d = docs(spark, [*good, *near, *other])
    texts = [r["text"] for r in pii.redact(d).collect()]
    assert texts[400:800] == ["mail [EMAIL] or ring [PHONE] at noon"] * 400 and texts[800:] == other


def test_trees_separate_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    t = pii.Trees().fit(x[:1000], y[:1000]).calibrate(x[1000:], y[1000:], np.zeros(1000, int))
    s = t.score(x[1000:])
    assert ((s > 0) == (y[1000:] > 0)).mean() > 0.95
    assert y[1000:][s >= t.threshold[0]].mean() >= 0.98 and t.threshold[1] == float("inf")


HTML = [
    ("<html><body class='has-sidebar'><div class=header>H</div><div id=content><p>One &amp; two<p>Three<br>four &nbsp; five<ul><li>a<li>b</ul></div><div class='sidebar'>x</div><footer>f</footer>", "One & two Three four five a b"),
    ("", ""), (None, ""), ("<p>plain", "plain"), ("text &lt; 5 <b>b</b>old", "text < 5 bold"),
    ("<nav>n</nav><article><h1>T</h1><p>Te<b>x</b>t<p>two</article><section class=comments><article>c</article></section>", "T Text two"),
    ("<article><p>a<script>var x='</p>'</script>b<!-- c --></p><form>f</form><table><tr><td>1<td>2</table></article>tail", "ab 1 2"),
    ("<div class='cookie-notice'>c</div><main><p>m</p><aside>s</aside></main>", "m"), ("<p title='a>b'>q</p>", "q"),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x", h, 1) for i, (h, _) in enumerate(HTML)] + [(99, None, "<p>x", 1)] * 2, "page_id long, url string, html string, text int")
    got = main_text.extract(pages).orderBy("page_id").collect()
    assert [r["text"] for r in got] == [w for _, w in HTML] + ["x", "x"]
    assert main_text.extract(pages.limit(0)).count() == 0


def test_site_templates_go_and_articles_stay(spark):
    box = "<div class=zz><p>Buy our <b>stuff</b> now</p></div>"
    rows = [(i, "http://h.org/a", f"<body>{box}<div><p>own text {i}</p><p>and more {i}</p></div></body>") for i in range(30)]
    rows += [(100 + i, "http://k.org/a", f"<body>{box}<p>k {i}</p>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "own text 3 and more 3" and got[100] == "Buy our stuff now k 0"
    same = [(i, "http://h.org/a", "<article><p>The same words</p></article>") for i in range(30)]
    assert {r["text"] for r in main_text.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()} == {"The same words"}


def test_site_templates_go_from_articles_too(spark):
    notice, link = "<p>Read our <b>terms</b> first</p>", "<a href=/a>About us</a>"
    rows = [(i, "http://h.org/a", f"<article><h1>T{i}</h1>{notice}<p>own {i} <b>terms</b></p><ul><li>Share this</ul><div>{link} {link}</div><address>Box 1</address></article>") for i in range(12)]
    rows += [(100 + i, "http://h.org/b", f"<footer><p>Legal line</p></footer><article><p>more {i}</p></article>") for i in range(12)]
    rows += [(200, "http://h.org/c", "<article><p>Legal line</p><p>last</p></article>"), (300, "http://k.org/a", f"<article>{notice}<p>k</p></article>")]
    got = {r["page_id"]: r["text"] for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 own 3 terms" and got[200] == "last" and got[300] == "Read our terms first k"


def test_a_box_on_a_small_part_of_a_large_host_goes(spark):
    box = "<div><p>Section news</p></div>"
    rows = [(i, "http://h.org/a", f"<article>{box if i % 20 == 0 else ''}<p>own {i}</p>{'<p>by chance</p>' if i < 6 else ''}</article>") for i in range(400)]
    got = {r["page_id"]: r["text"] for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] == "own 20" and got[1] == "own 1 by chance"


def test_the_pattern_is_the_public_one(vocabulary):
    assert regex.findall(vocabulary[1], "it's 12 ok  ") == ["it", "'s", " 12", " ok", "  "]


def test_deduplicate_tells_texts_of_one_id_apart(spark):
    rows = [(1, "one two three four five", 1), (1, "one two three four five", 1), (1, "one two three four five", 2), (1, "quite another text with other words", 1), (2, None, 1), (3, "", 1), (4, "one two three four five", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, component_id int").withColumns({"hash": F.lit("clash"), "all": F.create_map(F.lit("k"), F.lit(1))})
    kept = simhash.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, "one two three four five"), (1, "quite another text with other words"), (2, "")]
    assert simhash.deduplicate(d.limit(0)).count() == 0


def test_names_set_parts_apart_only_as_whole_words():
    for name in ("ad", "ad-slot", "ad-300x250", "site-footer", "cookie-notice", "sidebar_left", "related-posts"):
        assert main_text.set_apart(name, False), name
    for name in ("share-of-market", "header-image", "has-sidebar", "post-title", "adverb", ""):
        assert not main_text.set_apart(name, False), name
    assert main_text.set_apart("header", False) and not main_text.set_apart("header", True)
    text = lambda h: " ".join(t for t, *_ in main_text.blocks(h)[0])
    assert text('<article><div class="share-of-market"><p>inside</div><div class="share-buttons">no</div></article>') == "inside"
    assert text('<div class="header-image"><p>lead</div>') == "lead"


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<div>a" * 100_000, "<p>a<b>" * 50_000, "<ul><li>a" * 50_000, "<i>a</b>" * 50_000])
def test_deep_pages_take_time_in_proportion(source):
    import time

    begin = time.perf_counter()
    found = main_text.blocks(source)[0]
    assert time.perf_counter() - begin < 10 and "".join(t for t, *_ in found).strip("ax") == ""


def test_secrets_are_added_with_and_without_their_name_and_identifiers_are_not(spark):
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    keys = [key() for _ in range(420)]
    good = [f'then they set token = "{k}" at noon' for k in keys[:400]]
    bare = [f"we saw {k} there" for k in keys[400:]]
    other = [f"read chapter-{i}-of-the-long-book and part-{i % 7}-by-another-hand today" for i in range(400)]
    d = docs(spark, [*good, *bare, *other])
    trees = pii.train(d)
    found = {r["text"]: r["s"] for r in pii.find(d, trees, keep=("text",)).select("text", pii.listed("spans").alias("s")).collect()}
    wrong = {t: found[t] for t, k in zip([*good, *bare], keys) if not found[t].endswith(f"secret:{t.index(k)}:{t.index(k) + 40}")}
    assert not wrong
    assert {found[t] for t in other} == {""}
    assert {r["text"] for r in pii.redact(d, trees=trees).collect()} == {'then they set token = "[SECRET]" at noon', "we saw [SECRET] there", *other}
    none = pii.train(d.limit(0))
    assert not none.trees and pii.redact(d.limit(0)).count() == 0


def test_proposals_have_no_bound_of_length():
    local = "a" * 300
    for kind, text in {"email": f"{local}(at)" + "b" * 90 + ".c" * 9, "card": "1 2" * 30, "phone": "12-345" * 40, "ip": "12345.6.7.8", "secret": "a1" * 400}.items():
        assert regex.fullmatch(pii.GENERATORS[kind], text), kind
