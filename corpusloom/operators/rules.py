"""Rule scan of texts, annotation of lines, reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_space, snippet
from ..session import broadcast_if_small, checkpointed

#: This many patterns are compiled into one expression at most.
MAX_PATTERNS = 20_000


def scan(docs: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row a rule and document that has one of its patterns: the first in the rule's order;
    pos is its first place (1-based), snippet the characters around it.

    Up to MAX_PATTERNS patterns, after a count, are read into an expression, so that each document is
    looked at where it lies, without a join: array of (rule, pattern, position), of which the first
    pattern of each rule stays. More are joined (`scan_join`).
    """
    some = rules.where(F.coalesce(F.col("status"), F.lit("enabled")) != "disabled").select("rule_id", "trigger.patterns")
    if (some.agg(F.sum(F.size("patterns"))).first()[0] or 0) > MAX_PATTERNS:
        return scan_join(docs, rules, key, text)
    rows = some.orderBy("rule_id").collect()
    table = F.array(*[F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.array(*[F.lit(p) for p in r["patterns"] or () if p]).cast("array<string>").alias("patterns")) for r in rows])
    body = F.coalesce(F.col(text), F.lit(""))
    if not rows:
        table = F.array().cast("array<struct<rule_id:string,patterns:array<string>>>")
    first = F.transform(table, lambda r: F.struct(r["rule_id"].alias("rule_id"), F.get(F.filter(r["patterns"], lambda p: F.instr(body, p) > 0), 0).alias("pattern")))
    hits = docs.select(key, text, F.explode(F.filter(first, lambda h: h["pattern"].isNotNull())).alias("h"))
    hits = hits.select(key, "h.rule_id", "h.pattern", F.instr(body, F.col("h.pattern")).alias("pos"), snippet(body, F.instr(body, F.col("h.pattern"))).alias("snippet"))
    # rows that share a key are one document: the first place counts
    first = hits.groupBy(key, "rule_id").agg(F.min(F.struct("pos", "pattern", "snippet")).alias("h"))
    return first.select(key, "rule_id", "h.pattern", "h.pos", "h.snippet")


#: Characters of the piece of a pattern that texts are searched for.
GRAM = 4
#: Documents, about, that the pieces' frequencies are taken from; no result depends on them.
SAMPLE_DOCS = 2_000
FEW = 200_000


def _pieces(rows: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """keys, gram: the distinct runs of so many characters of each text; of a text shorter than
    every size, the text."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in enumerate(batch.column(len(keys)).to_pylist()):
                found = pa.array(sorted({body[i : i + n] for n in sizes for i in range(len(body) - n + 1)}), pa.string())
                for lo in range(0, len(found), 1 << 16):
                    some = found[lo : lo + (1 << 16)]
                    same = pa.array([at] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(same) for j in range(len(keys))), some], names=[*keys, "gram"])

    return rows.select(*keys, text).mapInArrow(run, f"{kinds}, gram string")


def scan_join(docs: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """What `scan` gives, for any number of rules: each pattern is keyed by its rarest piece of GRAM
    characters (itself, if it is shorter), texts give their distinct pieces, both meet in a join, and
    only patterns whose piece a text has are looked for in it. The rules stay a table."""
    each = rules.where(F.coalesce(F.col("status"), F.lit("enabled")) != "disabled").select("rule_id", F.posexplode("trigger.patterns").alias("o", "pattern")).where("pattern <> ''")
    each = checkpointed(each.withColumn("size", F.least(F.length("pattern"), F.lit(GRAM))))
    sizes = sorted(r[0] for r in each.select("size").distinct().collect())  # GRAM values at most
    docs = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_row", F.xxhash64(key, "_text"))
    total = docs.count()
    some = docs.where(F.pmod("_row", F.lit(1_000_003)) < F.lit(1 + 1_000_003 * SAMPLE_DOCS // max(1, total)))
    common = _pieces(some, ["_row"], "_text", sizes).groupBy("gram").agg(F.count("*").alias("n"))
    # a pattern's pieces all have one size
    own = [_pieces(each.where(F.col("size") == n), ["rule_id", "o", "pattern"], "pattern", [n]) for n in sizes]
    if not own:
        return docs.select(key, F.lit("").alias("rule_id"), F.lit("").alias("pattern"), F.lit(0).alias("pos"), F.lit("").alias("snippet")).limit(0)
    pieces = reduce(DataFrame.union, own).join(common, "gram", "left")
    anchors = checkpointed(pieces.groupBy("rule_id", "o", "pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    met = _pieces(docs, [key, "_row"], "_text", sizes).join(broadcast_if_small(anchors, FEW), "gram")
    asked = met.groupBy(key, "_row").agg(F.collect_set(F.struct("rule_id", "o", "pattern")).alias("_asked"))
    found = docs.join(asked.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (docs["_row"] == asked["_row"]))
    hits = F.filter(F.transform("_asked", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["o"].alias("o"), r["pattern"].alias("pattern"), F.instr("_text", r["pattern"]).alias("pos"))), lambda h: h["pos"] > 0)
    found = found.select(key, "_text", F.array_sort(hits).alias("_hits"))
    # of each rule the first pattern in its order
    first = F.filter("_hits", lambda h, i: (i == 0) | (h["rule_id"] != F.get("_hits", i - 1)["rule_id"]))
    told = F.transform(first, lambda h: F.struct(h["pos"].alias("pos"), h["pattern"].alias("pattern"), snippet(F.col("_text"), h["pos"]).alias("snippet"), h["rule_id"].alias("rule_id")))
    rows = found.select(key, F.explode(told).alias("h")).groupBy(key, F.col("h.rule_id").alias("rule_id")).agg(F.min("h").alias("h"))
    return rows.select(key, "rule_id", "h.pattern", "h.pos", "h.snippet")


def with_rules(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """hits with dimension, risk_level, risk_desc, suggestion, basis, source of their rules."""
    facts = rules.select("rule_id", "dimension", "risk_level", "risk_desc", F.col("suggestion_template").alias("suggestion"), "basis", "source")
    return hits.join(facts, "rule_id")


def counts(risks: DataFrame, keys: list[str]) -> DataFrame:
    """high, medium, low, total of each group."""
    level = lambda x: F.count_if(F.col("risk_level") == x).alias(x)
    return risks.groupBy(*keys).agg(level("high"), level("medium"), level("low"), F.count("*").alias("total"))


def tip(risk: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(risk["risk_level"], F.lit("medium")), F.lit("] "), F.coalesce(risk["risk_desc"], F.lit("")), F.lit(" → "), F.coalesce(risk["suggestion"], F.lit("")))


def risk_key(*candidates: Column) -> Column:
    """The first that isn't blank, without blanks and quotes around it."""
    cleaned = [F.trim(F.trim(F.coalesce(c, F.lit(""))), F.lit("\"'")) for c in candidates]
    return F.coalesce(*[F.when(c != "", c) for c in cleaned], F.lit(""))


def line_has(line: Column, key: Column) -> Column:
    """Does a line have the key, or its first 20 (if 6 or more) or 10 (4 or more) characters? Blanks don't count."""
    line, key = normalise_space(line), normalise_space(key)
    head = lambda n, least: (F.least(F.length(key), F.lit(n)) >= least) & F.contains(line, F.left(key, F.lit(n)))
    return (key != "") & (F.contains(line, key) | head(20, 6) | head(10, 4))


def annotated(docs: DataFrame, risks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, annotated, n_placed, n_unplaced: a line of advice after each line that a risk is found
    in; risks found nowhere are listed at the end. `risks` has key, snippet and the rule's facts."""
    risk = F.struct(risk_key(F.col("snippet")).alias("k"), F.col("rule_id"), "risk_level", "risk_desc", "suggestion")
    each = risks.select(key, risk.alias("r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("r.rule_id").alias("o"), "r"))).alias("_risks"))
    out = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(each, key, "left")
    none = F.array().cast(each.schema["_risks"].dataType)
    out = out.withColumn("_risks", F.coalesce("_risks", none)).withColumn("_lines", F.split("_text", "\\r\\n|\\r|\\n"))
    say = lambda r: F.concat(F.lit("> **风险提示** "), tip(r))
    under = F.transform("_lines", lambda x: F.concat(F.array(x), F.transform(F.filter("_risks", lambda r: line_has(x, r["r"]["k"])), lambda r: say(r["r"]))))
    lost = F.filter("_risks", lambda r: ~F.exists("_lines", lambda x: line_has(x, r["r"]["k"])))
    out = out.withColumn("_under", F.flatten(under)).withColumn("_lost", lost)
    tail = F.flatten(F.transform("_lost", lambda r: F.concat(F.array(say(r["r"])), F.when(r["r"]["k"] != "", F.array(F.concat(F.lit("> 相关片段："), F.left(r["r"]["k"], F.lit(120))))).otherwise(F.array().cast("array<string>")))))
    head = F.array(F.lit(""), F.lit("> # 未定位到原文段落的批注汇总"))
    whole = F.when(F.size("_lost") > 0, F.concat("_under", head, tail)).otherwise(F.col("_under"))
    return out.select(key, F.array_join(whole, "\n").alias("annotated"), (F.size("_under") - F.size("_lines")).alias("n_placed"), F.size("_lost").alias("n_unplaced"))


def _entry() -> Column:
    return F.concat(
        F.lit("### ["), "risk_level", F.lit("] "), F.coalesce("dimension", F.lit("")), F.lit(" — "), "rule_id", F.lit("\n- 说明："), F.coalesce("risk_desc", F.lit("")),
        F.lit("\n- 建议："), F.coalesce("suggestion", F.lit("")), F.lit("\n- 原文片段："), F.col("snippet"), F.lit("\n"),
    )


_TITLE = "# 合同审查报告\n\n- 合同："


def _totals() -> Column:
    count = lambda c: F.col(c).cast("string")
    return F.concat(F.lit("\n- 风险总数："), count("total"), F.lit("（高 "), count("high"), F.lit(" / 中 "), count("medium"), F.lit(" / 低 "), count("low"), F.lit("）\n\n## 风险清单\n\n"))


def report(risks: DataFrame, keys: list[str], file: str) -> DataFrame:
    """keys, report: a Markdown report of each group's risks, by file and rule, as one text; groups of
    any size are for `report_pieces`."""
    one = counts(risks, keys)
    parts = risks.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(file).cast("string").alias("f"), F.col("rule_id").alias("r"), _entry().alias("t")))), lambda x: x["t"]), "\n").alias("_body"),
        F.array_join(F.array_sort(F.collect_set(F.col(file).cast("string"))), ", ").alias("_files"),
    )
    return one.join(parts, keys).select(*keys, F.concat(F.lit(_TITLE), "_files", _totals(), "_body").alias("report"))


def report_pieces(risks: DataFrame, keys: list[str], file: str) -> DataFrame:
    """keys, part, file, rule_id, place, piece: the pieces of each group's report, which put together in
    the order of (part, file, rule_id, place) are the text of `report`. No row grows with its group, so a
    group is as many rows as it has risks and files; `write_reports` puts them into files."""
    rows = risks.select(*keys, F.col(file).cast("string").alias("file"), "rule_id", "risk_level", _entry().alias("piece"))
    one = counts(rows, keys).join(rows.groupBy(*keys).agg(F.min(F.struct("file", "rule_id")).alias("_least")), keys)
    none = F.lit(None).cast("string")
    head = one.select(*keys, F.lit(0).alias("part"), none.alias("file"), none.alias("rule_id"), F.lit(_TITLE).alias("piece"))
    totals = one.select(*keys, F.lit(2).alias("part"), none.alias("file"), none.alias("rule_id"), _totals().alias("piece"))
    least = one.select(*keys, "_least")
    files = rows.select(*keys, "file").distinct().join(least, keys)
    files = files.select(*keys, F.lit(1).alias("part"), "file", none.alias("rule_id"), F.concat(F.when(F.col("file").eqNullSafe(F.col("_least.file")), F.lit("")).otherwise(F.lit(", ")), "file").alias("piece"))
    first = (F.col("place") == 1) & F.col("file").eqNullSafe(F.col("_least.file")) & F.col("rule_id").eqNullSafe(F.col("_least.rule_id"))
    body = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "file", "rule_id").orderBy("piece"))).join(least, keys)
    body = body.select(*keys, F.lit(3).alias("part"), "file", "rule_id", F.concat(F.when(first, F.lit("")).otherwise(F.lit("\n")), "piece").alias("piece"), "place")
    return head.union(files).union(totals).withColumn("place", F.lit(1)).unionByName(body)


def write_reports(pieces: DataFrame, keys: list[str], path: str) -> None:
    """Pieces below path, a folder for each group, in files whose names and rows are in the order of
    the report; a large group has several."""
    order = ["part", "file", "rule_id", "place"]
    pieces.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).json(path)


def version_class(name: Column, folder: Column | None = None) -> Column:
    """Which version of a document a file name (and folder) tells."""
    out = F.when(F.contains(name, F.lit("批注")) | F.contains(F.lower(name), F.lit("annotated")), F.lit("annotated"))
    out = out.when(F.contains(name, F.lit("报告")) | F.contains(F.lower(name), F.lit("report")), F.lit("report"))
    out = out.when(F.contains(name, F.lit("脱敏")) | F.contains(F.lower(name), F.lit("redacted")), F.lit("redacted"))
    if folder is not None:
        out = out.when(F.contains(F.lower(folder), F.lit("redacted")), F.lit("redacted"))
    return out.otherwise(F.lit("original"))
