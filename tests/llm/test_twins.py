"""Whole queries against plain-Python twins on the given tables."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

from tabulon.llm import main_text

SF, PAGES = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


class Tree(HTMLParser):
    """Nested lists [tag, kids...] of pages whose only unclosed elements stand in paragraphs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [["#root"]]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "ul", "div", "article", "footer", "nav") and any(n[0] == "p" for n in self.stack):
            self.handle_endtag("p")
        node = [tag]
        self.stack[-1].append(node)
        if tag not in ("br", "meta"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1].append(data)


def content(node):
    return "".join(k if isinstance(k, str) else " " if k[0] == "br" else "" if k[0] in ("script", "style") else content(k) for k in node[1:])


def key(node):
    """An element as text: its tag and what it holds, runs of white space as one."""
    parts, run = [], ""
    for k in [*node[1:], ["#end"]]:
        if isinstance(k, str):
            run += k
            continue
        if run.strip():
            parts.append(" ".join(run.split()))
        run = ""
        parts.append(key(k) if k[0] != "#end" else "")
    return f"<{node[0]}>{'|'.join(parts)}</>"


def below(node):
    for k in node[1:]:
        if not isinstance(k, str):
            yield k
            yield from below(k)


def test_main_text_of_every_page(spark):
    rows, parsed = spark.read.parquet(f"{PAGES}/pages.parquet").collect(), []
    for r in rows:
        tree = Tree()
        tree.feed(r["html"] or "")
        tree.close()
        root = tree.stack[0]
        article = next((n for n in below(root) if n[0] == "article"), ["article"])
        paragraphs = [k for k in article[1:] if not isinstance(k, str) and content(k).strip()]
        host = re.match(r"[^:]+://([^/:?#]*)", r["url"] or "")
        parsed.append((r["page_id"], host.group(1).lower() if host else "", [(key(k), " ".join(content(k).split()), [b for b in k[1:] if not isinstance(b, str) and b[0] == "b"]) for k in paragraphs], {key(n) for n in below(root) if content(n).strip()}))
    pages = defaultdict(dict)
    for _, host, blocks, keys in parsed:
        pages[host].setdefault(" ".join(t for _, t, _ in blocks), []).append(keys)
    got = {r["page_id"]: r["text"] for r in main_text.query(spark, PAGES).collect()}
    changed = 0
    for i, host, blocks, _ in parsed:
        n = len(pages[host])
        on = Counter(k for copies in pages[host].values() for k in copies[0])
        site = {k for k, c in on.items() if c >= 5 and 2 * c >= n**0.5}
        stays = [t for k, t, bold in blocks if k not in site and not (bold and all(key(b) in site for b in bold) and " ".join("".join(content(b) for b in bold).split()) == t)]
        changed += len(stays) < len(blocks)
        assert got[i] == " ".join(stays), i
    assert len(got) == len(rows) and changed > 0
