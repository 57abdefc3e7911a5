"""Tables out of HTML: a Python UDTF on the standard library's parser.

Spark has no HTML scan, so this is the one place where rows are made by Python; everything after it works
on the long ``cells`` relation.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tabulon.config import STYLE_MARK

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ROW_PARTS = frozenset(["thead", "tbody", "tfoot"])


class Element:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self):
        """Elements below, in document order."""
        for kid in self.kids:
            if isinstance(kid, Element):
                yield kid
                yield from kid.walk()

    def text(self, stop: str = "") -> str:
        """The text below, hidden spans left out and styled ones marked."""
        parts = []
        for kid in self.kids:
            if isinstance(kid, str):
                parts.append(kid)
            elif kid.tag == "br":
                parts.append(" ")
            elif kid.tag in ("script", "style") or kid.tag == stop:
                continue
            else:
                inner = kid.text(stop)
                style = kid.attrs.get("style") if kid.tag == "span" else None
                parts.append(inner if style is None else "" if "none" in style else f"{STYLE_MARK}{inner}{STYLE_MARK}")
        return "".join(parts)


class _Tree(HTMLParser):
    CLOSES = {"tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}, "p": {"p"}, "table": {"p"}, "div": {"p"}, "li": {"li"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = self.CLOSES.get(tag, set())
        while self.at.tag in ends:
            self.at = self.at.parent
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag == "table" and tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "p"):
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(source: str) -> Element:
    tree = _Tree()
    tree.feed(source)
    tree.close()
    return tree.root


def own_rows(table: Element) -> list[tuple[Element, bool]]:
    """The table's rows, without those of nested tables, and whether each stands in its head."""
    out = []
    for kid in table.kids:
        if isinstance(kid, Element):
            if kid.tag == "tr":
                out.append((kid, False))
            elif kid.tag in ROW_PARTS:
                out += [(r, kid.tag == "thead") for r in kid.kids if isinstance(r, Element) and r.tag == "tr"]
    return out


def _span(value: str | None, most: int | None = None) -> int:
    m = re.match(r"\s*(\d+)", value or "")
    n = max(1, int(m[1])) if m else 1
    return n if most is None else min(n, most)


#: The HTML standard's bound of a column span: a larger one stands for it. Row spans end with their table's rows.
COLUMN_SPAN = 1000


def grid(table: Element) -> tuple[list[list[str]], int]:
    """All rows with row and column spans filled in, and the number of header rows.

    Header rows are those of the head, else the leading rows that hold header cells only.
    """
    rows, heads, carried = [], [], {}
    for tr, in_head in own_rows(table):
        cells = [k for k in tr.kids if isinstance(k, Element) and k.tag in ("td", "th")]
        row, at = [], 0

        def carry() -> None:
            nonlocal at
            while at in carried:
                text, left = carried.pop(at)
                row.append(text)
                if left > 1:
                    later[at] = (text, left - 1)
                at += 1

        later: dict[int, tuple[str, int]] = {}
        for cell in cells:
            carry()
            text = " ".join(cell.text("table").replace("\xa0", "\x00").split()).replace("\x00", "\xa0")
            down = _span(cell.attrs.get("rowspan"))
            for _ in range(_span(cell.attrs.get("colspan"), COLUMN_SPAN)):
                row.append(text)
                if down > 1:
                    later[at] = (text, down - 1)
                at += 1
        carry()
        for place in sorted(carried):
            while len(row) < place:
                row.append("")
            row.append(carried[place][0])
            if carried[place][1] > 1:
                later[place] = (carried[place][0], carried[place][1] - 1)
        carried = later
        if row:
            rows.append(row)
            heads.append(in_head or all(c.tag == "th" for c in cells))
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    depth = next((i for i, h in enumerate(heads) if not h), len(heads))
    return rows, depth


def wanted_tables(root: Element, css_class: str) -> list[tuple[Element, str | None]]:
    """The tables of a class, each with the text of the paragraphs before it, back to the nearest ``div`` in document order (null without any)."""
    found, before = [], []
    for node in root.walk():
        if node.tag == "div":
            before = []
        elif node.tag == "p":
            before.append(node)
        elif node.tag == "table" and css_class in node.attrs.get("class", ""):
            found.append((node, "\n".join(p.text().strip() for p in before) if before else None))
    return found


@udtf(returnType="dom_idx int, paragraph string, header_depth int, header array<string>, row_idx int, values array<string>")
class HtmlTables:
    """One row a table row; a table without rows below its header has one row with a null row_idx."""

    def eval(self, html: str, css_class: str):
        if not html:
            return
        for i, (table, paragraph) in enumerate(wanted_tables(parse(html), css_class)):
            rows, depth = grid(table)
            width = len(rows[0]) if rows else 0
            if not depth:
                header = [str(k) for k in range(width)]
            else:
                seen: dict[str, int] = {}
                header = []
                for k, name in enumerate(rows[0]):
                    name = name or f"Unnamed: {k}"
                    n = seen.get(name, 0)
                    seen[name] = n + 1
                    header.append(f"{name}.{n}" if n else name)
            body = rows[depth:]
            for r, row in enumerate(body):
                yield i, paragraph, depth, header, r, [v if v != "" else None for v in row]
            if not body:
                yield i, paragraph, depth, header, None, None


def table_rows(pages: DataFrame, css_class: str = "wikitable") -> DataFrame:
    """page_id, url and the rows of every table whose class attribute contains ``css_class``."""
    spark = pages.sparkSession
    spark.udtf.register("tabulon_html_tables", HtmlTables)
    pages.createOrReplaceTempView("_tabulon_pages")
    return spark.sql("SELECT p.page_id, p.url, t.* FROM _tabulon_pages p, LATERAL tabulon_html_tables(p.html, :css_class) t", args={"css_class": css_class})


def cells(rows: DataFrame) -> DataFrame:
    """table_id (page and place), row_idx, col_idx, col_name, raw."""
    name = F.concat_ws("_", F.col("page_id").cast("string"), F.col("dom_idx").cast("string"))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("values") - 1), lambda i: F.struct(i.alias("col_idx"), F.get("header", i).alias("col_name"), F.get("values", i).alias("raw"))))
    return rows.where("row_idx is not null and size(values) > 0").select(name.alias("table_id"), "row_idx", each.alias("c")).select("table_id", "row_idx", "c.*")


def tables(rows: DataFrame) -> DataFrame:
    """One row a table: table_id, page_id, url, dom_idx, paragraph, header, header_depth, n_rows, n_cols, filled."""
    by = rows.groupBy("page_id", "url", "dom_idx").agg(
        F.first("paragraph").alias("paragraph"), F.first("header").alias("header"), F.first("header_depth").alias("header_depth"), F.count("row_idx").alias("n_rows"),
        F.sum(F.coalesce(F.size(F.filter("values", lambda v: v.isNotNull())), F.lit(0))).alias("filled"),
    )
    return by.select(F.concat_ws("_", F.col("page_id").cast("string"), F.col("dom_idx").cast("string")).alias("table_id"), "*", F.size("header").cast("bigint").alias("n_cols"))
