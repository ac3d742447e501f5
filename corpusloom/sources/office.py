"""DOCX files, and PDF layout from characters.

DOCX is read as a zip of XML. PDF layout starts from a table of characters (doc_id, page, text,
size, fontname, top, bottom, x0, x1), as layout extractors give it; `pdf_pages` uses pypdf where
that is installed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clusters import silhouette, splits
from ..session import broadcast_if_small, checkpointed

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DOCX = "doc_id string, `order` int, type string, content string, level int, max_font_pt double, headers array<string>, rows array<array<string>>"


def style_level(style: str) -> int | None:
    """Heading level that a style name tells."""
    if m := re.match(r"(?:heading|标题)\s*([1-6])", style, re.IGNORECASE):
        return int(m[1])
    return 1 if re.search(r"title|head", style, re.IGNORECASE) else None


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def docx_rows(content: bytes) -> Iterator[tuple]:
    """(order, type, content, level, largest font, headers, rows) of paragraphs and tables in turn."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    order = 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            sizes = [int(s.get(f"{_W}val", "0")) / 2 for s in node.iter(f"{_W}sz")]
            level = style_level(style.get(f"{_W}val", "")) if style is not None else None
            yield order, "heading" if level and _text(node).strip() else "paragraph", _text(node), level, max(sizes, default=0.0), None, None
            order += 1
        elif node.tag == f"{_W}tbl":
            rows = [["".join(_text(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            if rows:
                yield order, "table", "", None, 0.0, rows[0], rows[1:]
                order += 1


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of files (doc_id, content); a file that isn't a DOCX gives a block of type 'error'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    out += [(doc, *r) for r in docx_rows(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((doc, 0, "error", str(e), None, 0.0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "order", "type", "content", "level", "max_font_pt", "headers", "rows"]).astype({"level": "Int32"})

    return files.select("doc_id", "content").mapInPandas(run, _DOCX)


def pdf_pages(files: DataFrame) -> DataFrame:
    """doc_id, page, text of files (doc_id, content): one paragraph a page that has text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader  # an optional package

        for batch in batches:
            out = [(doc, n, t) for doc, content in zip(batch["doc_id"], batch["content"], strict=True) for n, page in enumerate(PdfReader(io.BytesIO(bytes(content))).pages) if (t := (page.extract_text() or "").strip())]
            yield pd.DataFrame(out, columns=["doc_id", "page", "text"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page int, text string")


def body_font(chars: DataFrame) -> DataFrame:
    """doc_id, body: middle character size without those above median + 3 * interquartile range
    (elements by rank, not interpolated)."""
    sizes = F.array_sort(F.collect_list("n"))
    counted = chars.groupBy("doc_id", "size").agg(F.count("*").alias("c")).select("doc_id", F.struct("size", "c").alias("n"))
    lists = counted.groupBy("doc_id").agg(sizes.alias("s"))

    def rank(s: Column, share: float) -> Column:
        total = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x["c"])
        at = F.floor(total * share)
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["c"] > at), x["size"]).otherwise(a["v"]).alias("v"))
        return F.aggregate(s, start, step, lambda a: a["v"])

    lists = lists.withColumn("_top", rank(F.col("s"), 0.5) + 3 * (rank(F.col("s"), 0.75) - rank(F.col("s"), 0.25)))
    return lists.select("doc_id", rank(F.filter("s", lambda x: x["size"] <= F.col("_top")), 0.5).alias("body"))


def text_lines(chars: DataFrame) -> DataFrame:
    """doc_id, page, line, text, size, top, bottom, x0: characters whose tops are within 0.7 of a
    character's height of the line's."""
    along = Window.partitionBy("doc_id", "page").orderBy("top", "x0")
    before = F.lag("top").over(along)
    new = (before.isNull() | (F.col("top") - before > 0.7 * (F.col("bottom") - F.col("top")))).cast("int")
    rows = chars.withColumn("_new", new).withColumn("line", F.sum("_new").over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda c: c["text"]), "")
    return rows.groupBy("doc_id", "page", "line").agg(text.alias("text"), F.max("size").alias("size"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("x0").alias("x0"))


# Numbered headings.
_HEADINGS = [r"^第[一二三四五六七八九十百千零0-9]+[章编]", r"^第[一二三四五六七八九十百千零0-9]+节", r"^[一二三四五六七八九十]+、"]


def line_heading(text: Column, size: Column, body: Column) -> Column:
    """Level by the ratio of sizes (1.6, 1.35, 1.2), else by a number in front, else null."""
    out = F.when(size >= 1.6 * body, 1).when(size >= 1.35 * body, 2).when(size >= 1.2 * body, 3)
    for i, pattern in enumerate(_HEADINGS):
        out = out.when(text.rlike(pattern) & (F.length(text) <= 40), i + 1)
    return out


def continues(size: Column, before_size: Column, x0: Column, before_x0: Column, body: Column) -> Column:
    """Does a page's first line go on with the paragraph of the page before?"""
    return (F.abs(size - before_size) <= 1) & (size < 1.2 * body) & (F.abs(x0 - before_x0) <= 5)


def layout_blocks(chars: DataFrame) -> DataFrame:
    """doc_id, order, page, type, content, level: headings and paragraphs; a gap above 1.8 of the
    size begins a paragraph, a page break only where the text doesn't go on."""
    rows = text_lines(chars).join(body_font(chars), "doc_id")
    rows = rows.withColumn("level", line_heading(F.trim("text"), F.col("size"), F.col("body")))
    along = Window.partitionBy("doc_id").orderBy("page", "line")
    for c in ("page", "bottom", "size", "x0", "level"):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(along))
    apart = F.when(F.col("page") == F.col("_page"), F.col("top") - F.col("_bottom") > 1.8 * F.col("size")).otherwise(~continues(F.col("size"), F.col("_size"), F.col("x0"), F.col("_x0"), F.col("body")))
    new = F.col("_page").isNull() | F.col("level").isNotNull() | F.col("_level").isNotNull() | apart
    rows = rows.withColumn("_island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "")
    one = rows.groupBy("doc_id", "_island").agg(F.min("page").alias("page"), F.max("level").alias("level"), text.alias("content")).where(F.trim("content") != "")
    w = Window.partitionBy("doc_id").orderBy("_island")
    return one.select("doc_id", (F.row_number().over(w) - 1).alias("order"), "page", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph").alias("type"), "content", "level")


def merged_tables(tables: DataFrame) -> DataFrame:
    """doc_id, page, headers, rows: a table that goes on at the top (30 %) of the next page, with as
    many columns and four fifths of the headers equal, joins the one before; pairs only."""
    along = Window.partitionBy("doc_id").orderBy("page", "table_no")
    rows = tables
    for c in ("page", "headers", "rows", "table_top_ratio"):
        rows = rows.withColumn(f"_{c}", F.lead(c).over(along))
    same = F.size(F.filter(F.zip_with("headers", "_headers", lambda a, b: a == b), lambda x: x))
    joins = (F.col("_page") == F.col("page") + 1) & (F.size("headers") == F.size("_headers")) & (same >= 0.8 * F.size("headers")) & (F.col("_table_top_ratio") <= 0.3)
    rows = rows.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    # in a chain of joins every second table is taken by the one before
    run = F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_run", F.coalesce(run, F.lit(0)))
    place = F.row_number().over(Window.partitionBy("doc_id", "_run").orderBy("page", "table_no"))
    rows = rows.withColumn("_place", place).where(F.col("_place") % 2 == 1)
    return rows.select("doc_id", "page", "table_no", "headers", F.when(F.col("_joins"), F.concat("rows", "_rows")).otherwise(F.col("rows")).alias("rows"))


def image_texts(images: DataFrame, chars: DataFrame, reach: float = 50.0) -> DataFrame:
    """Images (doc_id, page, image, top, bottom, x0, x1) with alt: characters of the page that are
    within `reach` above or below and overlap horizontally."""
    c = chars.select("doc_id", "page", F.col("text").alias("_t"), F.col("top").alias("_top"), F.col("bottom").alias("_bottom"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    near = (F.col("_top") <= F.col("bottom") + reach) & (F.col("_bottom") >= F.col("top") - reach) & (F.col("_x0") < F.col("x1")) & (F.col("_x1") > F.col("x0"))
    found = images.join(c, ["doc_id", "page"]).where(near).groupBy("doc_id", "page", "image").agg(F.array_sort(F.collect_list(F.struct("_top", "_x0", "_t"))).alias("_c"))
    found = found.select("doc_id", "page", "image", F.array_join(F.transform("_c", lambda x: x["_t"]), "").alias("alt"))
    return images.join(found, ["doc_id", "page", "image"], "left")


def column_order(lines: DataFrame, most: int = 4) -> DataFrame:
    """Lines (doc_id, page, line, x0, ...) with column and reading order: the number of columns of a
    document is what most of its pages have, a page's columns are the clusters of least squares, 2 to
    `most`, whose silhouette is the best above 0.3, else one. A page is one group; its clusters of
    every number are made in one pass, and the document's number picks among them."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x0"].to_numpy(float)
        own = splits(x, most)
        best, chosen = 0.3, 1
        for k in range(2, min(most, len(set(x))) + 1):
            s = silhouette(x, own[k - 1])
            if s > best + 1e-9:
                best, chosen = s, k
        return pdf.assign(_own=[list(map(int, c)) for c in zip(*own, strict=True)], _columns=chosen)

    counted = checkpointed(lines.groupBy("doc_id", "page").applyInPandas(page, f"{_ddl(lines)}, _own array<int>, _columns int"))
    votes = counted.select("doc_id", "page", "_columns").distinct().groupBy("doc_id").agg(F.mode("_columns").alias("columns"))
    placed = counted.join(broadcast_if_small(votes, 1_000_000), "doc_id").withColumn("column", F.element_at("_own", F.col("columns"))).drop("_own", "_columns")
    return placed.withColumn("reading", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "column", "line")) - 1)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
