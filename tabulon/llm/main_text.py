"""The main text of web pages, without what the site repeats.

Each page is parsed once into blocks of text and the hashes of all its element subtrees, wherever they
stand. Spark counts on how many different pages of a host each subtree occurs; subtrees that recur on many
pages of their host are the site's template and are deleted. What names itself a menu, notice, advert and so
on is left out in any case, and within a page that marks its article only the article is read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import let, spread_join, table, written

#: A subtree is the site's if it is on so many different pages of the host; above a hundred pages, where more recurs
#: by chance, on half the square root of their number (16 of 1,000, 159 of 100,000).
LEAST_PAGES = 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html li option optgroup tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
P_SCOPE = frozenset("table td th caption button object template html".split())
#: An opening tag ends an open element of the second set, unless one of the third stands between.
SIBLINGS = [
    (frozenset(["li"]), frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd"]), frozenset(["dl"])),
    (frozenset(["td", "th"]), frozenset(["td", "th"]), frozenset(["tr", "table"])),
    (frozenset(["tr"]), frozenset(["tr"]), frozenset(["table"])),
    (frozenset(["option"]), frozenset(["option"]), frozenset(["select"])),
]
LEFT_OUT = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg math object canvas dialog menu noframes noembed audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Fixed names by which pages mark parts that are no content.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar widget widgets cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments disqus respond replies pagination pager toolbar skip".split()
)
#: Parts that a class may hold besides such a name and still mean the same (ad-slot, site-footer), unlike share-of-market.
BESIDES = frozenset(
    "area article bar block blog body box button buttons column container content entry form global group icon icons inner inside item items left link links list main module outer page panel post posts primary region right row secondary section site slot small space story top bottom unit wide wrap wrapper zone".split()
)
BESIDE = frozenset("comment comments replies respond disqus related recommended recommendations sidebar".split())
MARKED = re.compile(r"^(?:content|main|article|post|entry|story)$|^(?:main|article|post|entry|story|page)[-_](?:content|body|text)$", re.I)


class Node:
    __slots__ = ("tag", "attributes", "kids", "hash", "holds_article", "words")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.kids = tag, attributes, []
        self.hash, self.holds_article, self.words = 0, tag in ("article", "main"), False

    def close(self) -> None:
        parts = [self.tag]
        for kid in self.kids:
            if isinstance(kid, Node):
                parts.append(f"{kid.hash:x}")
                self.holds_article |= kid.holds_article
                self.words |= kid.words
            elif text := " ".join(kid.split()):
                parts.append(text)
                self.words = True
        self.hash = xxhash.xxh64_intdigest("\x00".join(parts))

    def named(self) -> dict[str, str]:
        return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(self.attributes)} if self.attributes.strip(" /") else {}


def parse(source: str) -> Node:
    """A tree from HTML of any quality; end tags may be missing."""
    root = Node("#root", "")
    stack = [root]
    depths: dict[str, list[int]] = {}  # of the open elements of each tag, so that none is sought through the stack

    def end(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.close()
            if node is not root:
                depths[node.tag].pop()

    def last(tags: frozenset) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def find(tags: frozenset, stops: frozenset) -> int:
        """The depth of the last open element of ``tags``, 0 if one of ``stops`` stands above it."""
        i = last(tags)
        return i if i > last(stops) else 0

    at = 0
    while True:
        m = TOKEN.search(source, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(source[at : m.start()]))
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            i = find(frozenset([tag]), frozenset() if tag in BLOCK else BLOCK)
            if i:
                end(i)
            continue
        if tag in CLOSES_P and (i := find(frozenset(["p"]), P_SCOPE)):
            end(i)
        for opening, ends, stops in SIBLINGS:
            if tag in opening and (i := find(ends, stops)):
                end(i)
        node = Node(tag, attributes)
        stack[-1].kids.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            node.close()
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
            node.close()
        else:
            depths.setdefault(tag, []).append(len(stack))
            stack.append(node)
    if at < len(source):
        stack[-1].kids.append(html.unescape(source[at:]))
    end(0)
    return root


def left_out(node: Node, inside: bool) -> bool:
    """Whether the element says of itself that it is no main content. inside: it stands in an article."""
    if node.tag in LEFT_OUT or node.tag == "header" and not inside:
        return True
    names = node.named()
    if not names:
        return False
    if "hidden" in names or names.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", names.get("style", ""), re.I):
        return True
    if names.get("role", "").lower() in ROLES:
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    if node.holds_article:  # a wrapper of the content, unless it holds the articles of readers or of other pages
        return bool(BESIDE.intersection(f"{names.get('class', '')} {names.get('id', '')}".lower().split()))
    return any(set_apart(token, inside) for token in f"{names.get('class', '')} {names.get('id', '')}".lower().split())


def set_apart(token: str, inside: bool) -> bool:
    """Whether a class or id names such a part: every word of it does, or says nothing else. A header may stand in an article."""
    words = [w for w in re.split(r"[-_]+", token) if w]
    return any(w in NAMES and not (inside and w == "header") for w in words) and all(w in NAMES or w in BESIDES or re.fullmatch(r"\d+(?:x\d+)?", w) for w in words)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashes(node: Node, into: dict[int, None]) -> None:
    """Add the hashes of an element and of those below it that hold text."""
    todo = [node]
    while todo:
        node = todo.pop()
        if node.words and node.tag != "#root":
            into[signed(node.hash)] = None
            todo += [k for k in node.kids if isinstance(k, Node)]


def marked_content(node: Node) -> bool:
    names = node.named()
    return any(MARKED.match(t) for t in f"{names.get('class', '')} {names.get('id', '')} {names.get('role', '')}".split())


def blocks(source: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]], list[int]]:
    """The blocks of a page's main text, the elements of the content, and the hashes of all other elements with text.

    Pieces of text are counted from 0 through the content. A block (text, begin, end) holds pieces begin to end, and so
    does an element (hash, begin, end): blocks whose pieces all stand in deleted elements go, while the site's link
    or phrase in a sentence of the page's own leaves it whole.
    """
    root = parse(source or "")
    has_article, marked = root.holds_article, False
    if not has_article:
        todo = [root]
        while todo and not marked:
            for kid in (k for k in todo.pop().kids if isinstance(k, Node)):
                marked |= marked_content(kid)
                todo.append(kid)
    out: list[tuple[str, int, int]] = []
    elements: list[list[int]] = []
    others: dict[int, None] = {}
    now: list[str] = []
    n = begin = 0

    def flush() -> None:
        nonlocal begin
        if text := " ".join("".join(now).split()):
            out.append((text, begin, n))
        now.clear()
        begin = n

    # (node or text, inside the content, the place of an element to leave or None)
    todo: list = [(root, not has_article and not marked, None)]
    while todo:
        item, inside, place = todo.pop()
        if isinstance(item, str):
            if inside:
                now.append(item)
                n += bool(item.strip())
            continue
        if place is not None:
            if item.tag in BLOCK:
                flush()
            elements[place][2] = n
            continue
        if item.tag == "br":
            now.append(" ")
            continue
        if item.tag != "#root" and left_out(item, inside and has_article):
            hashes(item, others)
            if item.tag in BLOCK:
                flush()
            continue
        if item.tag in BLOCK or item.tag == "hr":
            flush()
        if not inside:
            if has_article:
                inside = item.tag in ("article", "main") and not (item.tag == "main" and any(isinstance(k, Node) and k.holds_article for k in item.kids))
            elif marked:
                inside = marked_content(item)
        if item.tag in BLOCK or item.words and item.tag != "#root":
            todo.append((item, inside, len(elements)))
            elements.append([signed(item.hash) if item.words else 0, n, n])
        todo.extend((kid, inside, None) for kid in reversed(item.kids))
    flush()
    held = [tuple(e) for e in elements if e[2] > e[1]]
    inner = {e[0] for e in held}
    others.update(dict.fromkeys(e[0] for e in elements if e[0]))
    return out, held, [h for h in others if h not in inner]


PARSED = "page_id {id}, url string, host string, page bigint, tree bigint, blocks array<struct<text:string,begin:int,end:int>>, elements array<struct<hash:bigint,begin:int,end:int>>, others array<bigint>"


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, hashes of the page's main text and of all its elements, its blocks and elements, of every row."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    kind = src.schema["page_id"].dataType.simpleString()
    triple = lambda a, t: pa.list_(pa.struct([(a, t), ("begin", pa.int32()), ("end", pa.int32())]))
    digest = lambda parts: xxhash.xxh64_intdigest("\x00".join(parts)) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [blocks(h.as_py()) for h in part.column(3)]
                page = [digest(t for t, *_ in b) for b, *_ in found]
                tree = [digest(map(str, sorted({*o, *(h for h, *_ in e)}))) for _, e, o in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3], pa.array(page, pa.int64()), pa.array(tree, pa.int64()),
                        pa.array([[{"text": t, "begin": i, "end": j} for t, i, j in b] for b, *_ in found], triple("text", pa.string())),
                        pa.array([[{"hash": h, "begin": i, "end": j} for h, i, j in e] for _, e, _ in found], triple("hash", pa.int64())),
                        pa.array([o for *_, o in found], pa.list_(pa.int64())),
                    ],
                    names=["page_id", "url", "host", "page", "tree", "blocks", "elements", "others"],
                )

    return src.mapInArrow(run, PARSED.format(id=kind))


def templates(parsed: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, site: the hashes of the elements that recur on a host. Pages of one main text count once, as the one of least tree.

    Their number grows at most as the square root of the host's pages. The elements of a common host aren't brought to
    one task before that.
    """
    every = F.array_distinct(F.concat("elements.hash", "others"))
    different = parsed.groupBy("host", "page").agg(F.min_by(every, "tree").alias("subtrees"))
    n = written(different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages), "hosts")
    counts = different.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("on")).where(F.col("on") >= least_pages)
    total = n.agg(F.sum("pages")).first()[0] or 0
    site = spread_join(written(counts, "counts"), n, "host", "pages", total).where(F.col("on") >= F.sqrt("pages") / 2)
    return site.groupBy("host").agg(F.collect_list("subtree").alias("site"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url and text of every row.

    A null or empty page has an empty text. Pages without a host (null or odd url) form one host. Repeated
    rows and repeated ids stay rows of their own. Long and deeply nested pages take time in proportion to their
    length. Other columns aren't read. Empty in, empty out. Hosts' templates are joined by size: broadcast below
    Spark's threshold, else by a join that splits hot hosts.
    """
    parsed = written(parse_pages(pages), "pages")
    site = written(templates(parsed, least_pages), "site")
    joined = parsed.join(site, "host", "left")

    def cuts(own: Column) -> Column:
        """The outermost deleted elements, in page order; elements come before those they hold."""
        gone = F.filter("elements", lambda e: F.array_contains(own, e["hash"]))
        begin = F.struct(F.lit(0).alias("to"), F.slice("elements", 1, 0).alias("outer"))
        put = lambda a, e: F.when(e["end"] > a["to"], F.struct(e["end"].alias("to"), F.concat(a["outer"], F.array(e)).alias("outer"))).otherwise(a)
        return F.aggregate(gone, begin, put, lambda a: a["outer"])

    def rest(outer: Column) -> Column:
        covered = lambda b: F.aggregate(outer, F.lit(0), lambda a, e: a + F.greatest(F.least(e["end"], b["end"]) - F.greatest(e["begin"], b["begin"]), F.lit(0)))
        return F.filter("blocks", lambda b: covered(b) < b["end"] - b["begin"])

    own = F.array_intersect("elements.hash", "site")
    kept = F.when(F.col("site").isNull(), F.col("blocks")).otherwise(let(own, lambda o: F.when(F.size(o) == 0, F.col("blocks")).otherwise(let(cuts(o), rest))))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
