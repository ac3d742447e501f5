"""Queries on documents: chunks, blocks, citations, redaction, rules; each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as qu
from ..functions import text as tx
from ..operators import bm25, chunking, history, redact, retrieval, rules, store
from ..session import spread, table
from ..sources import markup

PARENT, CHILD = (1000, 200), (250, 50)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


# -- chunking ----------------------------------------------------------------------------------


def parent_child_windows(spark, d):
    rows = chunking.parent_child_windows(_docs(spark, d), parent=PARENT, child=CHILD)
    return rows.select("doc_id", "parent_no", "child_no", F.substring("parent_id", 7, 16).alias("parent"), F.substring("chunk_id", 7, 16).alias("child"), F.sha1("text").alias("text_sha1"))


def chunk_links(spark, d):
    rows = chunking.windows(_docs(spark, d).select("doc_id", "text"), ["doc_id"], "text", 1000, 200, "pos")
    rows = rows.withColumn("chunk_id", tx.chunk_id(F.col("doc_id").cast("string"), F.col("pos")))
    return chunking.links(rows, ["doc_id"], "pos").select("doc_id", "pos", "chunk_id", "prev_chunk_id", "next_chunk_id")


def parent_child_search(spark, d):
    children = chunking.parent_child_windows(_docs(spark, d), parent=PARENT, child=CHILD).withColumn("chunk_id", F.concat_ws(":", "doc_id", "child_no")).withColumn("parent_id", F.concat_ws(":", "doc_id", "parent_no"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.parent_child(children.select("chunk_id", "parent_id", "text"), items, 5)


def greedy_packing(spark, d):
    parts = chunking.packed(F.split("text", "\n"), 400)
    return _docs(spark, d).select("doc_id", F.posexplode(parts).alias("pos", "piece"))


def hard_split(spark, d):
    return chunking.split_texts(_docs(spark, d), "doc_id", "text", how="anywhere")


def structural_chunks(spark, d):
    blocks = markup.markdown_blocks(_docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    empty = blocks.withColumn("headers", F.lit(None).cast("array<string>")).withColumn("rows", F.lit(None).cast("array<array<string>>"))
    return chunking.structural(empty).select("doc_id", "order", "chunk_level", "chunk_id", "parent_chunk_id", "prev_chunk_id", "next_chunk_id", "token_count")


def line_blocks(spark, d):
    return markup.markdown_blocks(_docs(spark, d)).select("doc_id", "order", "type", F.sha1("content").alias("content_sha1"))


def adjacent_dedupe(spark, d):
    kept = chunking.without_repeats(F.split("text", "\n"))
    return _docs(spark, d).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"), F.sha1(F.array_join(kept, "\n")).alias("text_sha1"))


def chunk_merge_reorder(spark, d):
    rows = chunking.windows(_docs(spark, d).select("doc_id", "text"), ["doc_id"], "text", 1000, 0, "order").select("doc_id", "order", F.col("piece").alias("text"))
    first = rows.where(F.col("order") % 3 == 0).select("doc_id", "order")
    return chunking.merge_next(rows, first).select("doc_id", F.col("order").cast("long").alias("order"), F.sha1("text").alias("text_sha1"))


def keyset_page(spark, d):
    return store.page(_docs(spark, d).select("source", "doc_id", "n_chars"), ["source", "doc_id"], ["src15", 100], 200)


def split_suggestion(spark, d):
    return _docs(spark, d).select("doc_id", chunking.split_suggestion(F.replace("text", F.lit(". "), F.lit("。"))).cast("long").alias("cut"))


# -- identity, caches, citations ---------------------------------------------------------------


def doc_identity(spark, d):
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", tx.document_id(text).alias("content_id"), tx.chunk_id(F.col("doc_id").cast("string"), F.lit(0)).alias("chunk_id"), tx.content_chunk_id(text).alias("text_id"), tx.embedding_key("m", text).alias("cache_key"), tx.token_estimate(text).cast("long").alias("tokens"))


def embedding_cache_misses(spark, d):
    keys = _docs(spark, d).select("doc_id", tx.embedding_key("m", F.coalesce("text", F.lit(""))).alias("cache_key"))
    cache = keys.where(F.col("doc_id") % 3 == 0).select("cache_key").distinct()
    return store.cache_misses(keys, cache, "cache_key")


def first_occurrence(spark, d):
    return store.first_seen(_docs(spark, d).select("text", "doc_id", "source"), ["text"], ["doc_id"]).select("doc_id", "source")


def manifest_changeset(spark, d):
    now = _docs(spark, d).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("relpath"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "doc_id")
    known = now.where(F.col("doc_id") % 7 != 0).withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.sha1("content_hash")).otherwise(F.col("content_hash")))
    return store.change_set(known, now.where(F.col("doc_id") % 11 != 0))


def _citations(spark, d):
    """Each benchmark item cites the lines of its text as articles; documents have theirs."""
    lines = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split("text", "\n"))).alias("article_no")).where(F.length("article_no") > 20)
    cited = lines(table(spark, d, "benchmark"), "item_id").withColumn("law_name", F.lit("corpus"))
    chunks = _docs(spark, d).select(F.lit("corpus").alias("law_name"), F.filter(F.split("text", "\n"), lambda x: F.length(x) > 20).alias("articles"))
    return cited, chunks


def citations_checked(spark, d):
    from ..functions.citations import verify

    out = verify(*_citations(spark, d))
    return out.select("item_id", F.sha1("article_no").alias("article_sha1"), "status")


def article_locate(spark, d):
    """The least document that has each cited article."""
    cited, _ = _citations(spark, d)
    having = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("article_no"))
    found = cited.join(having, "article_no").groupBy("item_id", "article_no").agg(F.min("doc_id").alias("doc_id"))
    return found.select("item_id", F.sha1("article_no").alias("article_sha1"), "doc_id")


# -- redaction ---------------------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"


def pii_scan_email(spark, d):
    found = F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))
    return _docs(spark, d).select("doc_id", F.posexplode(found).alias("pos", "value")).select("doc_id", F.col("pos").cast("long").alias("pos"), "value")


def pii_scan_digits(spark, d):
    runs = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x).between(16, 19))
    return _docs(spark, d).select("doc_id", F.posexplode(runs).alias("pos", "value")).select("doc_id", F.col("pos").cast("long").alias("pos"), "value")


def pii_category_counts(spark, d):
    email = F.size(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)))
    digits = F.size(F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x).between(16, 19)))
    return _docs(spark, d).groupBy("source").agg(F.sum(F.coalesce(email, F.lit(0))).alias("emails"), F.sum(F.coalesce(digits, F.lit(0))).alias("digit_runs"))


def mask_values(spark, d):
    each = _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("value")).distinct()
    category = F.lit("email")
    return each.select("value", redact.middle_mask(F.col("value"), category).alias("middle"), redact.middle_mask(F.col("value"), F.lit("phone")).alias("plain"), redact.hash_mask(F.col("value"), category).alias("hashed"))


def pii_spans(spark, d):
    return redact.scan_documents(_docs(spark, d)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.category", "s.value", "s.start", "s.end")


def span_resolve(spark, d):
    """Windows of words and of longer words as spans over the whole text, and 400 at least in
    texts of as many characters; overlaps resolved."""
    n = F.length("text").cast("long")
    spans = F.transform(F.sequence(F.lit(0).cast("long"), F.when(n <= 2800, F.least(n, F.lit(400))).otherwise(F.floor(n / 7))), lambda i: F.struct((i * 7).cast("int").alias("start"), (i * 7 + 1 + (i * i + F.col("doc_id")) % 23).cast("int").alias("end")))
    return _docs(spark, d).select("doc_id", F.explode(redact.resolve_spans(spans)).alias("s")).select("doc_id", "s.start", "s.end")


def mask_placeholder(spark, d):
    return redact.placeholders(_docs(spark, d)).select("doc_id", F.sha1("masked").alias("masked_sha1"), F.size("entries").alias("n_entries"))


def restore_roundtrip(spark, d):
    masked = redact.placeholders(_docs(spark, d))
    left = F.rlike("masked", F.lit("[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z0-9]"))
    return masked.select("doc_id", F.sha1(redact.restore(F.col("masked"), F.col("entries"))).alias("text_sha1"), left.alias("address_left"))


def reversible_map(spark, d):
    kinds = (("digits", "[0-9]{9,}"), ("email", EMAIL))
    return redact.reversible_map(_docs(spark, d), kinds=kinds)


def redact_static_layers(spark, d):
    urls = redact.static_layers(F.col("url"), layers=((r"https?://[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_./%-]*)?", "{{URL}}"),))
    return table(spark, d, "pages").select("page_id", urls.alias("url"))


def redact_layers(spark, d):
    return redact.layered_documents(_docs(spark, d)).select("doc_id", F.sha1("masked").alias("masked_sha1"), "n_entities")


# -- rules -------------------------------------------------------------------------------------

RULE_ROWS = [
    ("r1", "licence", ["Licensed under", "CC BY"], "low", "licence line", "check the licence"),
    ("r2", "list", [" | "], "medium", "list", "rewrite as prose"),
    ("r3", "marks", ["###", "$$$", "%%%"], "high", "marks", "remove the marks"),
    ("r4", "shouting", ["!! "], "medium", "shouting", "lower the case"),
    ("r5", "none", ["zzzzzz"], "high", "never", "nothing"),
]


def _rules(spark):
    rows = [(i, dim, (p,), level, desc, tip, [], "builtin", "enabled") for i, dim, p, level, desc, tip in RULE_ROWS]
    return spark.createDataFrame(rows, "rule_id string, dimension string, trigger struct<patterns:array<string>>, risk_level string, risk_desc string, suggestion_template string, basis array<struct<law:string,article:string>>, source string, status string")


def _risks(spark, d):
    hits = rules.scan(_docs(spark, d), _rules(spark), "doc_id")
    return rules.with_rules(hits, _rules(spark))


def rule_scan(spark, d):
    return rules.scan(_docs(spark, d), _rules(spark), "doc_id").select("doc_id", "rule_id", "pattern", F.col("pos").cast("long").alias("pos"), "snippet")


def rule_counts(spark, d):
    risks = _risks(spark, d).select("doc_id", "risk_level").join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    return rules.counts(risks, ["source"])


def risk_report(spark, d):
    risks = _risks(spark, d).join(_docs(spark, d).select("doc_id", F.col("source").alias("folder")), "doc_id").drop("source")
    return rules.report(risks, ["folder"], "doc_id").select("folder", F.sha1("report").alias("report_sha1"), F.length("report").cast("long").alias("n_chars"))


def line_annotate(spark, d):
    return rules.annotated(_docs(spark, d), _risks(spark, d), "doc_id").select("doc_id", F.col("n_placed").cast("long").alias("n_placed"), F.col("n_unplaced").cast("long").alias("n_unplaced"))


# -- questions ---------------------------------------------------------------------------------

CUES = qu.Cues(small_talk=["^(hi|hello|thanks)+$"], topics=["tion", "ment", "ung"], negations=["not "], comparisons=["differ", "versus"], procedures=["how to", "step"], shortest=30, longest=120)


def prefilter_flags(spark, d):
    reason = qu.blocked_reason(F.col("text"), CUES)
    return table(spark, d, "conversations").select("conv_id", "turn", reason.isNull().alias("passed"), reason.alias("reason"))


def difficulty_levels(spark, d):
    level = qu.difficulty(F.col("text"), F.lit(False), CUES)
    return table(spark, d, "conversations").select("conv_id", "turn", level.alias("x")).select("conv_id", "turn", "x.level", "x.rule_hit", "x.top_k")


def negation_flags(spark, d):
    """Numbers in the texts: does a word that may negate stand in the five characters before?"""
    text = F.coalesce("text", F.lit(""))
    raw, before = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.split(text, "[0-9]+")
    flags = F.transform(raw, lambda x, i: F.struct(x.alias("number"), F.rlike(F.right(F.get(before, i), F.lit(5)), F.lit("no|ne|ni")).alias("negated")))
    return _docs(spark, d).select("doc_id", F.posexplode(flags).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), "x.number", "x.negated")


def highlight_merge(spark, d):
    """Places of anchors' neighbourhoods over the whole text, and 300 at least in texts of as many
    characters, as ranges, overlapping ones merged."""
    n = F.length("text")
    hits = _docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.least(n, F.lit(300)), F.floor(n / 9).cast("int")))).alias("i"))
    ranges = hits.select("doc_id", (F.col("i") * 9).cast("long").alias("start"), (F.col("i") * 9 + (F.col("i") * F.col("doc_id")) % 17).cast("long").alias("end"))
    return history.merged_ranges(ranges, ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        parent_child_windows, chunk_links, parent_child_search, greedy_packing, hard_split, structural_chunks, line_blocks, adjacent_dedupe, chunk_merge_reorder, keyset_page, split_suggestion,
        doc_identity, embedding_cache_misses, first_occurrence, manifest_changeset, citations_checked, article_locate,
        pii_scan_email, pii_scan_digits, pii_category_counts, mask_values, pii_spans, span_resolve, mask_placeholder, restore_roundtrip, reversible_map, redact_static_layers, redact_layers,
        rule_scan, rule_counts, risk_report, line_annotate, prefilter_flags, difficulty_levels, negation_flags, highlight_merge,
    )
}

_VALUES = ", ".join(f"('{i}', '{level}', {p!r}, '{desc}', '{tip}', '{dim}')" for i, dim, p, level, desc, tip in RULE_ROWS)
_RULES = f"""rules AS (SELECT * FROM (VALUES {_VALUES}) t(rule_id, risk_level, patterns, risk_desc, tip, dimension)),
each AS (SELECT doc_id, source, text, rule_id, risk_level, risk_desc, tip, dimension, unnest(patterns) pattern, unnest(range(len(patterns))) o FROM documents, rules),
hits AS (SELECT * FROM (SELECT *, instr(text, pattern) pos FROM each) WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY o) = 1),
risks AS (SELECT *, replace(substring(text, greatest(1, pos - 40), pos + 120 - greatest(1, pos - 40)), chr(10), ' ') snippet FROM hits)"""
_WINDOWS = """p AS (SELECT doc_id, length(text) n, unnest(range(CAST(ceil(length(text) / 800) AS BIGINT))) parent_no, text FROM documents),
pp AS (SELECT doc_id, parent_no, substring(text, parent_no * 800 + 1, 1000) piece FROM p),
c AS (SELECT doc_id, parent_no, unnest(range(CAST(ceil(length(piece) / 200) AS BIGINT))) j, piece FROM pp),
w AS (SELECT doc_id, parent_no, row_number() OVER (PARTITION BY doc_id ORDER BY parent_no, j) - 1 child_no, substring(piece, j * 200 + 1, 250) t FROM c)"""
_W = r"[\p{L}\p{N}_]+"
_CITED = """cited AS (SELECT DISTINCT item_id, a FROM (SELECT item_id, unnest(string_split(text, chr(10))) a FROM benchmark) WHERE length(a) > 20),
have AS (SELECT DISTINCT doc_id, a FROM (SELECT doc_id, unnest(string_split(text, chr(10))) a FROM documents))"""
_DIGITS = "list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 16 AND 19)"

SQL = {
    "parent_child_windows": f"""WITH {_WINDOWS} SELECT doc_id, parent_no, child_no, substring(sha256(doc_id || ':parent:' || parent_no), 1, 16) parent, substring(sha256(doc_id || ':child:' || child_no), 1, 16) AS child, sha1(t) text_sha1 FROM w""",
    "chunk_links": """WITH w AS (SELECT doc_id, unnest(range(CAST(ceil(length(text) / 800) AS BIGINT))) pos FROM documents), i AS (SELECT *, 'chunk:' || substring(sha256(doc_id || ':' || pos), 1, 16) chunk_id FROM w)
      SELECT *, lag(chunk_id) OVER x prev_chunk_id, lead(chunk_id) OVER x next_chunk_id FROM i WINDOW x AS (PARTITION BY doc_id ORDER BY pos)""",
    "parent_child_search": f"""WITH {_WINDOWS}, toks AS (SELECT doc_id || ':' || child_no id, doc_id || ':' || parent_no parent_id, regexp_extract_all(lower(t), '{_W}') t FROM w),
      lens AS (SELECT id, len(t) dl FROM toks), post AS (SELECT id, term, count(*) tf FROM (SELECT id, unnest(t) term FROM toks) GROUP BY ALL), st AS (SELECT count(*) n, avg(dl) avgdl FROM lens),
      terms AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) idf FROM post, st GROUP BY term),
      asked AS (SELECT query_id, term, count(*) qtf FROM (SELECT item_id query_id, unnest(regexp_extract_all(lower(text), '{_W}')) term FROM benchmark) GROUP BY ALL),
      s AS (SELECT query_id, p.id, round(sum(idf * 2.5 * qtf / (1.5 + qtf) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score FROM asked JOIN terms USING (term) JOIN post p USING (term) JOIN lens l ON l.id = p.id, st GROUP BY ALL),
      best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50),
      g AS (SELECT query_id, parent_id, max(score) score FROM best JOIN toks USING (id) GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM g QUALIFY rank <= 5""",
    "line_blocks": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) c, unnest(range(len(string_split(text, chr(10))))) line FROM documents),
      k AS (SELECT *, CASE WHEN trim(c) = '' THEN 'blank' WHEN regexp_matches(c, '^#{1,6}\\s+') THEN 'heading' ELSE 'text' END kind FROM l),
      s AS (SELECT *, CASE WHEN kind = 'heading' OR kind = 'text' AND coalesce(lag(kind) OVER x, '') <> 'text' THEN 1 ELSE 0 END b FROM k WINDOW x AS (PARTITION BY doc_id ORDER BY line)),
      i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line) island FROM s),
      g AS (SELECT doc_id, island, min(line) line, CASE WHEN min(kind) = 'heading' THEN 'heading' ELSE 'paragraph' END AS type, string_agg(c, chr(10) ORDER BY line) content FROM i WHERE kind <> 'blank' GROUP BY ALL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS "order", type, sha1(content) content_sha1 FROM g""",
    "adjacent_dedupe": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) c, unnest(range(len(string_split(text, chr(10))))) line FROM documents),
      k AS (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY line) p FROM l)
      SELECT doc_id, count(*) n_lines, count(*) FILTER (line = 0 OR c <> p) n_kept, sha1(string_agg(c, chr(10) ORDER BY line) FILTER (line = 0 OR c <> p)) text_sha1 FROM k GROUP BY doc_id""",
    "chunk_merge_reorder": """WITH c AS (SELECT doc_id, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) o, text FROM documents), p AS (SELECT doc_id, o, substring(text, o * 1000 + 1, 1000) t FROM c),
      g AS (SELECT doc_id, CASE WHEN o % 3 = 1 THEN o - 1 ELSE o END i, string_agg(t, chr(10) || chr(10) ORDER BY o) t FROM p GROUP BY ALL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS "order", sha1(t) text_sha1 FROM g""",
    "keyset_page": "SELECT source, doc_id, n_chars FROM documents WHERE (source, doc_id) > ('src15', 100) ORDER BY source, doc_id LIMIT 200",
    "doc_identity": """SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) content_id, 'chunk:' || substring(sha256(doc_id || ':0'), 1, 16) chunk_id, 'chunk:' || substring(sha1(coalesce(text, '')), 1, 16) text_id,
      sha256('m:' || coalesce(text, '')) cache_key, greatest(1, length(coalesce(text, '')) // 2) tokens FROM documents""",
    "embedding_cache_misses": "WITH k AS (SELECT doc_id, sha256('m:' || coalesce(text, '')) cache_key FROM documents) SELECT DISTINCT cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE doc_id % 3 = 0)",
    "first_occurrence": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "manifest_changeset": """WITH n AS (SELECT doc_id, 'd/' || doc_id relpath, sha256(coalesce(text, '')) h FROM documents), k AS (SELECT relpath, CASE WHEN doc_id % 5 = 0 THEN sha1(h) ELSE h END h FROM n WHERE doc_id % 7 <> 0), c AS (SELECT relpath, h FROM n WHERE doc_id % 11 <> 0)
      SELECT coalesce(k.relpath, c.relpath) relpath, CASE WHEN k.relpath IS NULL THEN 'added' WHEN c.relpath IS NULL THEN 'deleted' ELSE 'modified' END change FROM k FULL JOIN c ON k.relpath = c.relpath WHERE k.relpath IS NULL OR c.relpath IS NULL OR k.h <> c.h""",
    "citations_checked": f"WITH {_CITED} SELECT item_id, sha1(a) article_sha1, CASE WHEN a IN (SELECT a FROM have) THEN 'verified' ELSE 'unverifiable' END status FROM cited",
    "article_locate": f"WITH {_CITED} SELECT item_id, sha1(a) article_sha1, min(doc_id) doc_id FROM cited JOIN have USING (a) GROUP BY item_id, a",
    "pii_scan_email": f"SELECT doc_id, unnest(range(len(m))) pos, unnest(m) AS value FROM (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') m FROM documents)",
    "pii_scan_digits": f"SELECT doc_id, unnest(range(len(m))) pos, unnest(m) AS value FROM (SELECT doc_id, {_DIGITS} m FROM documents)",
    "pii_category_counts": f"SELECT source, sum(len(regexp_extract_all(text, '{EMAIL}')))::BIGINT emails, sum(len({_DIGITS}))::BIGINT digit_runs FROM documents GROUP BY source",
    "mask_values": f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents), x AS (SELECT value, split_part(value, '@', 1) l, substring(value, instr(value, '@') + 1) h FROM v)
      SELECT value, CASE WHEN length(l) <= 2 THEN left(l, 1) || repeat('*', greatest(1, length(l) - 1)) ELSE left(l, 1) || repeat('*', least(6, length(l) - 2)) || right(l, 1) END || '@' || h middle,
      CASE WHEN length(value) < 2 THEN repeat('*', length(value)) WHEN length(value) = 2 THEN left(value, 1) || '*' ELSE left(value, 1) || repeat('*', least(length(value) - 2, 6)) || right(value, 1) END plain,
      '[EMAIL:' || upper(substring(sha1(value), 1, 10)) || ']' hashed FROM x""",
    "restore_roundtrip": "SELECT doc_id, sha1(text) text_sha1, false address_left FROM documents",
    "reversible_map": f"""WITH d AS (SELECT doc_id, 0 i, unnest(m) v, unnest(range(len(m))) p FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{{9,}}') m FROM documents)
      UNION ALL SELECT doc_id, 1, unnest(m), unnest(range(len(m))) FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[0-9]{{9,}}', chr(0), 'g'), '{EMAIL}') m FROM documents)),
      f AS (SELECT i, v, min({{'d': doc_id, 'p': p}}) a FROM d GROUP BY ALL)
      SELECT CASE i WHEN 0 THEN 'digits' ELSE 'email' END kind, v original, '[' || CASE i WHEN 0 THEN 'digits' ELSE 'email' END || row_number() OVER (PARTITION BY i ORDER BY a) || ']' placeholder FROM f""",
    "redact_static_layers": r"SELECT page_id, regexp_replace(url, 'https?://[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_./%-]*)?', '{{URL}}', 'g') url FROM pages",
    "rule_scan": f"WITH {_RULES} SELECT doc_id, rule_id, pattern, pos, snippet FROM risks",
    "rule_counts": f"WITH {_RULES} SELECT source, count(*) FILTER (risk_level = 'high') high, count(*) FILTER (risk_level = 'medium') medium, count(*) FILTER (risk_level = 'low') low, count(*) total FROM risks GROUP BY source",
    "risk_report": f"""WITH {_RULES}, g AS (SELECT source folder, string_agg('### [' || risk_level || '] ' || dimension || ' — ' || rule_id || chr(10) || '- 说明：' || risk_desc || chr(10) || '- 建议：' || tip || chr(10) || '- 原文片段：' || snippet || chr(10), chr(10) ORDER BY doc_id::VARCHAR, rule_id) body,
      string_agg(DISTINCT doc_id::VARCHAR, ', ' ORDER BY doc_id::VARCHAR) files, count(*) t, count(*) FILTER (risk_level = 'high') h, count(*) FILTER (risk_level = 'medium') m, count(*) FILTER (risk_level = 'low') l FROM risks GROUP BY source),
      r AS (SELECT folder, '# 合同审查报告' || chr(10) || chr(10) || '- 合同：' || files || chr(10) || '- 风险总数：' || t || '（高 ' || h || ' / 中 ' || m || ' / 低 ' || l || '）' || chr(10) || chr(10) || '## 风险清单' || chr(10) || chr(10) || body report FROM g)
      SELECT folder, sha1(report) report_sha1, length(report) n_chars FROM r""",
    "line_annotate": f"""WITH {_RULES}, k AS (SELECT doc_id, rule_id, text, regexp_replace(trim(trim(snippet), chr(34) || chr(39)), '\\s+', '', 'g') k FROM risks),
      l AS (SELECT doc_id, rule_id, k, regexp_replace(unnest(string_split(text, chr(10))), '\\s+', '', 'g') line FROM k),
      m AS (SELECT doc_id, rule_id, count(*) FILTER (k <> '' AND (contains(line, k) OR (least(length(k), 20) >= 6 AND contains(line, left(k, 20))) OR (least(length(k), 10) >= 4 AND contains(line, left(k, 10))))) n FROM l GROUP BY ALL)
      SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT n_placed, count(*) FILTER (n = 0) n_unplaced FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id""",
    "prefilter_flags": r"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') t, lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) q FROM conversations),
      r AS (SELECT conv_id, turn, CASE WHEN length(q) <= 1 OR regexp_matches(q, '^[^\p{L}\p{N}]+$') OR regexp_matches(q, '(?i)^(hi|hello|thanks)+$') THEN 'trivial' WHEN NOT (contains(t, 'tion') OR contains(t, 'ment') OR contains(t, 'ung')) AND length(t) < 30 THEN 'short_non_legal' END reason FROM q)
      SELECT conv_id, turn, reason IS NULL passed, reason FROM r""",
    "difficulty_levels": """WITH q AS (SELECT conv_id, turn, coalesce(text, '') t FROM conversations), r AS (SELECT conv_id, turn, CASE WHEN contains(t, 'differ') OR contains(t, 'versus') THEN 'compare_words' WHEN length(t) - length(replace(t, '?', '')) >= 2 OR length(t) > 120 THEN 'multi_question_or_long' WHEN contains(t, 'how to') OR contains(t, 'step') THEN 'procedure_words' ELSE 'default' END rule_hit FROM q)
      SELECT conv_id, turn, rule_hit, CASE WHEN rule_hit IN ('compare_words', 'multi_question_or_long') THEN 'hard' ELSE 'medium' END AS level, CASE WHEN rule_hit IN ('compare_words', 'multi_question_or_long') THEN 10 ELSE 8 END top_k FROM r""",
    "negation_flags": """WITH q AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') m, regexp_split_to_array(text, '[0-9]+') b FROM documents), e AS (SELECT doc_id, unnest(range(len(m))) pos, unnest(m) number, unnest(b[1:len(m)]) b FROM q)
      SELECT doc_id, pos, number, regexp_matches(right(b, 5), 'no|ne|ni') negated FROM e""",
    "highlight_merge": """WITH r AS (SELECT doc_id, i * 9 s, i * 9 + (i * doc_id) % 17 e FROM (SELECT doc_id, unnest(range(greatest(least(length(text), 300), length(text) // 9) + 1)) i FROM documents)),
      k AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END b FROM r), i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM k)
      SELECT doc_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY doc_id, g""",
}
