"""Markdown and legal paragraphs as typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chinese_to_arabic

# Line kinds of a Markdown text.
HEADING = r"^(#{1,6})\s+(.*?)\s*$"
FENCE = r"^\s*```\s*([A-Za-z0-9_+-]*)\s*$"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 0), content."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))


def markdown_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, content, kind: fence, code, blank, heading or text, and level and language."""
    rows = lines(docs, key, text).withColumn("_fence", F.col("content").rlike(FENCE))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_open", F.coalesce(F.sum(F.col("_fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    kind = F.when(F.col("_fence"), "fence").when(F.col("_open"), "code").when(F.trim("content") == "", "blank").when(F.col("content").rlike(HEADING), "heading").otherwise("text")
    rows = rows.withColumn("kind", kind)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("content", HEADING, 1)))
    language = F.when(F.col("_fence"), F.regexp_extract("content", FENCE, 1))
    return rows.select(key, "line", "content", "kind", level.alias("level"), language.alias("language"), "_open")


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, order, type, content, level, language: headings, paragraphs (lines joined), code blocks;
    a code block that never ends is dropped."""
    rows = markdown_tokens(docs, key, text)
    along = Window.partitionBy(key).orderBy("line")
    opens = (F.col("kind") == "fence") & ~F.col("_open")
    closes = (F.col("kind") == "fence") & F.col("_open")
    before = F.lag("kind").over(along)
    starts = opens | (F.col("kind") == "heading") | ((F.col("kind") == "text") & ~F.coalesce(before == "text", F.lit(False)))
    rows = rows.withColumn("_start", starts.cast("int")).withColumn("_island", F.sum("_start").over(along)).withColumn("_closes", closes)
    rows = rows.where((F.col("kind") != "blank"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "fence", F.struct("line", "content")))), lambda x: x["content"]), "\n")
    one = rows.groupBy(key, "_island").agg(F.min("line").alias("_line"), F.min_by("kind", "line").alias("_kind"), content.alias("content"), F.max("level").alias("level"), F.min_by("language", "line").alias("language"), F.max("_closes").alias("_closed"))
    one = one.where((F.col("_kind") != "fence") | F.col("_closed"))
    kind = F.when(F.col("_kind") == "fence", "code").when(F.col("_kind") == "heading", "heading").otherwise("paragraph")
    body = F.when(F.col("_kind") == "heading", F.regexp_extract("content", HEADING, 2)).otherwise(F.col("content"))
    w = Window.partitionBy(key).orderBy("_line")
    return one.select(key, (F.row_number().over(w) - 1).alias("order"), kind.alias("type"), body.alias("content"), "level", F.when(F.col("_kind") == "fence", F.col("language")).alias("language"))


_CN = "[一二三四五六七八九十百千零〇]+"


def heading_level(text: Column, font: Column) -> Column:
    """1 for large print, 2 for preface, chapters and appendices, 3 for sections."""
    chapters = text.rlike(r"^序\s*言") | text.rlike(f"^第{_CN}章") | text.rlike(f"^附件{_CN}")
    return F.when(font >= 22, 1).when(chapters, 2).when(text.rlike(f"^第{_CN}节"), 3)


def is_legal(paragraphs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, legal: are there at least two paragraphs that aren't empty?"""
    return paragraphs.groupBy(key).agg((F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) != "") >= 2).alias("legal"))


def legal_blocks(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, order, type, content, level, kind, article_number, chapter, section, article of legal
    paragraphs (key, idx, text, max_font_pt). A table of contents reaches to the next blank line."""
    rows = paragraphs.withColumn("content", F.trim(F.coalesce("text", F.lit(""))))
    along = Window.partitionBy(key).orderBy("idx")
    toc = F.col("content").rlike(r"^目\s*录$")
    rows = rows.withColumn("_last_toc", F.last(F.when(toc, F.col("idx")), True).over(along)).withColumn("_last_blank", F.last(F.when(F.col("content") == "", F.col("idx")), True).over(along))
    inside = F.col("_last_toc").isNotNull() & (F.coalesce("_last_blank", F.lit(-1)) < F.col("_last_toc"))
    rows = rows.where((F.col("content") != "") & ~inside).withColumn("level", heading_level(F.col("content"), F.col("max_font_pt")))
    number = F.regexp_extract("content", f"^第({_CN})条", 1)
    article = F.col("level").isNull() & (number != "")
    dated = F.startswith("content", F.lit("（")) & (F.contains("content", F.lit("通过")) | F.contains("content", F.lit("公布")))
    kind = F.when(F.col("level").isNotNull(), "heading").when(article, "article").when(dated, "enactment_date").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("article_number", F.when(article, chinese_to_arabic(number)))
    rows = rows.withColumn("chapter", F.last(F.when(F.col("level") == 2, F.col("content")), True).over(along))
    # a section belongs to the chapter it follows
    rows = rows.withColumn("_at", F.last(F.when(F.col("level") == 2, F.col("idx")), True).over(along)).withColumn("_sat", F.last(F.when(F.col("level") == 3, F.col("idx")), True).over(along))
    rows = rows.withColumn("section", F.when(F.col("_sat") > F.coalesce("_at", F.lit(-1)), F.last(F.when(F.col("level") == 3, F.col("content")), True).over(along)))
    rows = rows.withColumn("article", F.last("article_number", True).over(along))
    kinds = F.when(F.col("kind") == "heading", "heading").otherwise("paragraph")
    return rows.select(key, (F.row_number().over(along) - 1).alias("order"), kinds.alias("type"), "content", "level", "kind", "article_number", "chapter", "section", "article")


def heading_paths(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks with heading_path: for each level the last heading before, unless a higher one came after it."""
    along = Window.partitionBy(key).orderBy("order")
    rows = blocks
    for k in range(1, 7):
        here = F.when((F.col("type") == "heading") & (F.col("level") == k), F.struct("order", "content"))
        above = F.when((F.col("type") == "heading") & (F.col("level") < k), F.col("order"))
        rows = rows.withColumn(f"_h{k}", F.last(here, True).over(along)).withColumn(f"_a{k}", F.last(above, True).over(along))
    parts = [F.when(F.col(f"_h{k}.order") > F.coalesce(F.col(f"_a{k}"), F.lit(-1)), F.col(f"_h{k}.content")) for k in range(1, 7)]
    return rows.withColumn("heading_path", F.filter(F.array(*parts), lambda x: x.isNotNull())).select(*blocks.columns, "heading_path")
