"""Queries that run an operator as it is, with its own patterns and words, on tables with planted cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations
from ..functions import query as qu
from ..functions import text as tx
from ..operators import filters, ingest, redact, rules
from ..session import table, work_folder
from ..sources import files
from . import documents
from .documents import _docs, _risks


def _planted() -> Column:
    """A whole text, then a phone, an identity card and one of four companies."""
    n = F.col("doc_id")
    company = F.concat(F.get(F.array(*[F.lit(c) for c in "东西南北"]), (n % 4).cast("int")), F.lit("河有限公司"))
    return F.concat(F.coalesce("text", F.lit("")), F.lit(" "), (n * 7919 + 13_000_000_000).cast("string"), F.lit(" "), F.lpad(n.cast("string"), 17, "1"), F.lit("X "), company)


def scan_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of three built-in categories in the order of each."""
    docs = _docs(spark, d).select("doc_id", _planted().alias("text"))
    spans = redact.scan_documents(docs, categories=["id_card", "phone", "email"])
    of = lambda c: F.filter("spans", lambda s: s["category"] == c)
    each = F.concat(*[F.transform(of(c), lambda s, i: F.struct(s["category"].alias("category"), i.cast("long").alias("pos"), s["value"].alias("value"))) for c in ("id_card", "phone", "email")])
    return spans.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")


def reversible_kinds(spark, d):
    """The reversible masker with its own four kinds."""
    return redact.reversible_map(_docs(spark, d).select("doc_id", _planted().alias("text")))


def parsed_questions(spark, d):
    """Turns that name a law, an article in figures, and one in words that is excluded; every third is left as it is."""
    n = F.length("text") % 50 + 1
    asked = F.concat("text", F.lit(" 公司法第"), (F.col("turn") + 1).cast("string"), F.lit("条，但不包括第"), tx.arabic_to_chinese(n), F.lit("条，按行政法规"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(asked).alias("query"))
    out = qu.parse(rows)
    level = qu.difficulty(F.col("query"), F.col("exact_match"))
    return out.select("conv_id", "turn", "law_name", "effect_level", F.array_join("articles", ",").alias("articles"), F.array_join("excluded", ",").alias("excluded"), "exact_match", level["level"].alias("level"))


def article_snippets(spark, d):
    """The article between two whole texts, headed in figures or in words; every third isn't followed
    by another one."""
    n = (F.col("doc_id") % 9 + 1).cast("int")
    text = F.coalesce("text", F.lit(""))
    number = F.when(F.col("doc_id") % 2 == 0, tx.arabic_to_chinese(n)).otherwise(n.cast("string"))
    whole = F.concat(text, F.lit("第"), number, F.lit("条 "), text, F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("第九十条 end")))
    found = citations.locate(F.col("whole"), F.col("n").cast("string"))
    return _docs(spark, d).select("doc_id", whole.alias("whole"), n.alias("n")).select("doc_id", F.sha1(found).alias("snippet_sha1"), F.length(found).cast("long").alias("n_chars"))


def parsed_filter(spark, d):
    """Documents that a parsed question's law and article let pass."""
    rows = _docs(spark, d).select("doc_id", F.col("source").alias("law_name"), F.array("lang").alias("articles"))
    return rows.where(filters.parsed(["src1", "src3"], ["en", "de"])).select("doc_id")


def valid_ids(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, F.md5("text")).when(F.col("doc_id") % 3 == 1, F.upper(F.md5("text"))).otherwise(F.sha1("text"))
    return _docs(spark, d).select("doc_id", ingest.valid_id(name).alias("valid"))


def annotated_texts(spark, d):
    """The whole annotated text."""
    return rules.annotated(_docs(spark, d), _risks(spark, d), "doc_id").select("doc_id", F.sha1("annotated").alias("annotated_sha1"))


def lexicon_words(spark, d):
    """A lexicon file of all documents: words with and without figures, comments, blank lines."""
    n = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# w"), n)).when(F.col("doc_id") % 5 == 1, F.lit("  ")).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("w"), n))
    line = line.when(F.col("doc_id") % 5 == 3, F.concat(F.lit("w"), n, F.lit("  "), F.col("n_chars").cast("string"))).otherwise(F.concat(F.lit("w"), n, F.lit(" many "), "lang"))
    path = f"{work_folder(spark)}/lexicon"
    _docs(spark, d).select(line.alias("value")).write.mode("overwrite").text(path)
    return files.lexicon(spark, path)


def rule_lines(spark, d):
    """Rules of all documents as JSON Lines, some of them broken, some disabled."""
    status = F.when(F.col("doc_id") % 4 == 0, F.lit("disabled")).when(F.col("doc_id") % 4 == 1, F.lit("enabled"))
    good = F.to_json(F.struct(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("rule_id"), F.col("source").alias("dimension"), F.col("text").alias("risk_desc"), status.alias("status")))
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{broken "), F.col("doc_id").cast("string"))).otherwise(good)
    path = f"{work_folder(spark)}/rules"
    _docs(spark, d).select(line.alias("value")).write.mode("overwrite").text(path)
    return files.rules(spark, [path]).select("rule_id", "dimension", F.sha1("risk_desc").alias("desc_sha1"), "corrupt")


def redact_layers_planted(spark, d):
    """Whole texts with planted personal data: what is shown for the planted part alone, and the whole
    text given back from the masked one and its ledger."""
    docs = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    number = F.lpad((F.col("doc_id") % 100_000_000).cast("string"), 8, "0")
    planted = F.concat(F.lit("原告：张伟，被告：张三，电话 138"), number, F.lit("，支付"), (F.col("doc_id") % 1000 + 1).cast("string"), F.lit("万元，每期 5元/月，利率 3.5%，邮箱 a"), number, F.lit("@mail.example，依照第十条第二款"))
    both = docs.select("doc_id", planted.alias("text")).withColumn("part", F.lit("planted")).union(docs.select("doc_id", F.concat("t", F.lit("\n"), planted)).withColumn("part", F.lit("whole")))
    rows = both.withColumn("id", F.concat_ws(":", "part", F.xxhash64("doc_id", "text").cast("string"), "doc_id"))
    masked = redact.layered_documents(rows, "id").withColumn("doc_id", F.element_at(F.split("id", ":"), 3).cast("long")).withColumn("part", F.element_at(F.split("id", ":"), 1))
    masked = masked.withColumn("restored_sha1", F.sha1(redact.restored_text(F.col("masked"), F.col("ledger"))))
    return masked.select("doc_id", "part", F.when(F.col("part") == "planted", F.col("masked")).alias("masked"), "restored_sha1")


_SENTENCE = "原告：张伟，身份证 110101199003071234，电话 13800138000，邮箱 a.b@mail.example，北京星河有限公司 代码 91110000MA01ABCD2X，由李四承担"


def pii_planted(spark, d):
    """What the six categories find in a planted sentence behind a whole text, with its places in it,
    and how a mask of placeholders shows it."""
    docs = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    docs = docs.withColumn("text", F.concat("t", F.lit("\n" + _SENTENCE))).withColumn("id", F.struct("doc_id", F.length("t").alias("n")))
    found = redact.scan_documents(docs, "id").select("id", F.explode("spans").alias("s")).where("s.start > id.n")
    return found.select("id.doc_id", "s.category", "s.value", (F.col("s.start") - F.col("id.n")).cast("long").alias("place"))


def mask_planted(spark, d):
    """The sentence alone, masked by placeholders and given back, beside a number of the document's."""
    text = F.concat(F.lit(_SENTENCE + "，编号"), F.col("doc_id").cast("string"))
    docs = _docs(spark, d).where("doc_id is not null").select("doc_id", text.alias("text")).distinct()
    masked = redact.placeholders(docs)
    return masked.select("doc_id", "masked", F.sha1(redact.restore(F.col("masked"), F.col("entries"))).alias("restored_sha1"))


def risk_report_pieces(spark, d):
    risks = _risks(spark, d).join(_docs(spark, d).select("doc_id", F.col("source").alias("folder")), "doc_id").drop("source")
    return rules.report_pieces(risks, ["folder"], "doc_id").select("folder", "part", "file", "rule_id", F.sha1("piece").alias("piece_sha1"))


QUERIES = {f.__name__: f for f in (scan_values, reversible_kinds, parsed_questions, article_snippets, parsed_filter, valid_ids, annotated_texts, lexicon_words, rule_lines, redact_layers_planted, pii_planted, mask_planted, risk_report_pieces)}

_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
_PLANTED = "t AS (SELECT doc_id, coalesce(text, '') || ' ' || (doc_id * 7919 + 13000000000) || ' ' || lpad(doc_id::VARCHAR, 17, '1') || 'X ' || substring('东西南北', (doc_id % 4 + 1)::INT, 1) || '河有限公司' t FROM documents)"
_CARD = "[0-9]{18}[Xx]?|[0-9]{17}[Xx]"

SQL = {
    "scan_values": f"""WITH {_PLANTED}, r AS (SELECT doc_id, regexp_extract_all(t, '{_EMAIL}') e, regexp_extract_all(regexp_replace(t, '{_EMAIL}', '|', 'g'), '[0-9]+[Xx]?') n FROM t),
      k AS (SELECT doc_id, 'email' category, e v FROM r UNION ALL SELECT doc_id, 'id_card', list_transform(list_filter(n, lambda x: regexp_full_match(x, '{_CARD}')), lambda x: left(x, 18)) FROM r
        UNION ALL SELECT doc_id, 'phone', list_transform(list_filter(n, lambda x: regexp_full_match(x, '1[3-9][0-9]{{9}}[Xx]?')), lambda x: left(x, 11)) FROM r)
      SELECT doc_id, category, unnest(range(len(v))) pos, unnest(v) AS value FROM k""",
    "reversible_kinds": f"""WITH {_PLANTED}, n AS (SELECT doc_id, unnest(range(len(x))) p, unnest(x) x FROM (SELECT doc_id, regexp_extract_all(t, '[0-9]+[Xx]?') x FROM t)),
      k AS (SELECT doc_id, p, CASE WHEN regexp_full_match(x, '{_CARD}') THEN 'idcard' WHEN regexp_full_match(x, '1[3-9][0-9]{{9}}[Xx]?') THEN 'phone' WHEN regexp_full_match(x, '[0-9]{{16,19}}[Xx]?') THEN 'bankcard' END kind, x FROM n
        UNION ALL SELECT doc_id, unnest(range(len(c))), 'company', unnest(c) FROM (SELECT doc_id, regexp_extract_all(t, '[一-鿿]{{2,20}}(?:有限责任公司|股份有限公司|有限公司|集团)') c FROM t)),
      f AS (SELECT kind, CASE kind WHEN 'idcard' THEN left(x, 18) WHEN 'company' THEN x ELSE rtrim(x, 'Xx') END original, min({{'d': doc_id, 'p': p}}) a FROM k WHERE kind IS NOT NULL GROUP BY ALL)
      SELECT kind, original, '[' || kind || row_number() OVER (PARTITION BY kind ORDER BY a) || ']' placeholder FROM f""",
    "parsed_questions": """WITH q AS (SELECT conv_id, turn, turn % 3 = 0 OR text IS NULL plain, text, (turn + 1)::VARCHAR a, (length(text) % 50 + 1)::VARCHAR x FROM conversations)
      SELECT conv_id, turn, CASE WHEN NOT plain THEN '中华人民共和国公司法' END law_name, CASE WHEN NOT plain THEN '行政法规' END effect_level, CASE WHEN plain THEN '' ELSE a END articles, CASE WHEN plain THEN '' ELSE x END excluded,
      NOT plain exact_match, CASE WHEN NOT plain THEN 'simple' WHEN length(coalesce(text, '')) > 40 OR length(text) - length(replace(text, '?', '')) >= 2 THEN 'hard' ELSE 'medium' END AS level FROM q""",
    "article_snippets": """WITH h AS (SELECT doc_id, coalesce(text, '') t, '第' || CASE WHEN doc_id % 2 = 0 THEN substring('一二三四五六七八九', (doc_id % 9 + 1)::INT, 1) ELSE (doc_id % 9 + 1)::VARCHAR END || '条' h FROM documents),
      s AS (SELECT doc_id, right(t, 30) || h || CASE WHEN doc_id % 3 = 0 THEN left(' ' || t, 600 - length(h)) ELSE ' ' || t END s FROM h) SELECT doc_id, sha1(s) snippet_sha1, length(s) n_chars FROM s""",
    "redact_layers_planted": """WITH p AS (SELECT doc_id, coalesce(text, '') t, '原告：张伟，被告：张三，电话 138' || lpad((doc_id % 100000000)::VARCHAR, 8, '0') || '，支付' || (doc_id % 1000 + 1) || '万元，每期 5元/月，利率 3.5%，邮箱 a' || lpad((doc_id % 100000000)::VARCHAR, 8, '0') || '@mail.example，依照第十条第二款' p FROM documents)
      SELECT doc_id, 'planted' part, '原告：{{PARTY_甲方}}，被告：{{PARTY_甲方_2}}，电话 {{PHONE_1}}，支付{{AMOUNT_1}}，每期 {{AMOUNT_PERIOD_1}}，利率 {{PERCENT_1}}，邮箱 {{EMAIL}}，依照第十条第二款' masked, sha1(p) restored_sha1 FROM p
      UNION ALL SELECT doc_id, 'whole', NULL, sha1(t || chr(10) || p) FROM p""",
    "pii_planted": f"""WITH v AS (FROM (VALUES ('person_name', '张伟', 0), ('id_card', '110101199003071234', 0), ('phone', '13800138000', 0), ('email', 'a.b@mail.example', 0), ('company_name', '北京星河有限公司', 0), ('credit_code', '91110000MA01ABCD2X', 0), ('person_name', '李四', 0)) t(category, value, x))
      SELECT doc_id, category, value, instr('{_SENTENCE}', value) place FROM documents, v""",
    "mask_planted": f"""SELECT DISTINCT doc_id, '原告：{{{{PERSON_2}}}}，身份证 {{{{ID_CARD_1}}}}，电话 {{{{PHONE_1}}}}，邮箱 {{{{EMAIL_1}}}}，{{{{COMPANY_1}}}} 代码 {{{{CREDIT_CODE_1}}}}，由{{{{PERSON_1}}}}承担，编号' || doc_id masked, sha1('{_SENTENCE}，编号' || doc_id) restored_sha1 FROM documents WHERE doc_id IS NOT NULL""",
    "risk_report_pieces": f"""WITH {documents._RULES}, e AS (SELECT source folder, doc_id::VARCHAR file, rule_id, risk_level, '### [' || risk_level || '] ' || dimension || ' — ' || rule_id || chr(10) || '- 说明：' || risk_desc || chr(10) || '- 建议：' || tip || chr(10) || '- 原文片段：' || snippet || chr(10) piece FROM risks WHERE source IS NOT NULL),
      g AS (SELECT folder, count(*) t, count(*) FILTER (risk_level = 'high') h, count(*) FILTER (risk_level = 'medium') m, count(*) FILTER (risk_level = 'low') l FROM e GROUP BY folder),
      p AS (SELECT folder, 0 part, NULL file, NULL rule_id, '# 合同审查报告' || chr(10) || chr(10) || '- 合同：' piece FROM g
        UNION ALL SELECT folder, 1, file, NULL, CASE WHEN row_number() OVER (PARTITION BY folder ORDER BY file) > 1 THEN ', ' ELSE '' END || file FROM (SELECT DISTINCT folder, file FROM e)
        UNION ALL SELECT folder, 2, NULL, NULL, chr(10) || '- 风险总数：' || t || '（高 ' || h || ' / 中 ' || m || ' / 低 ' || l || '）' || chr(10) || chr(10) || '## 风险清单' || chr(10) || chr(10) FROM g
        UNION ALL SELECT folder, 3, file, rule_id, CASE WHEN row_number() OVER (PARTITION BY folder ORDER BY file, rule_id) > 1 THEN chr(10) ELSE '' END || piece FROM e)
      SELECT folder, part, file, rule_id, sha1(piece) piece_sha1 FROM p""",
    "parsed_filter": "SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') AND lang IN ('en', 'de')",
    "valid_ids": "SELECT doc_id, doc_id % 3 = 0 AND text IS NOT NULL valid FROM documents",
    "lexicon_words": """SELECT 'w' || doc_id word, CASE WHEN doc_id % 5 = 3 THEN n_chars::INT ELSE 10000 END freq, CASE WHEN doc_id % 5 = 4 THEN lang ELSE 'n' END tag FROM documents WHERE doc_id % 5 >= 2""",
    "rule_lines": """SELECT CASE WHEN doc_id % 7 <> 0 THEN 'r' || doc_id END rule_id, CASE WHEN doc_id % 7 <> 0 THEN source END dimension, CASE WHEN doc_id % 7 <> 0 THEN sha1(text) END desc_sha1,
      CASE WHEN doc_id % 7 = 0 THEN '{broken ' || doc_id END corrupt FROM documents WHERE doc_id % 7 = 0 OR doc_id % 4 <> 0""",
    "annotated_texts": f"""WITH {documents._RULES}, k AS (SELECT doc_id, rule_id, text, trim(trim(snippet), chr(34) || chr(39)) k, '> **风险提示** [' || risk_level || '] ' || risk_desc || ' → ' || tip say FROM risks),
      l AS (SELECT doc_id, unnest(range(len(x))) i, unnest(x) line FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') x FROM documents)),
      c AS (SELECT doc_id, rule_id, k, say, i, regexp_replace(k, '\\s+', '', 'g') n, regexp_replace(line, '\\s+', '', 'g') line FROM k JOIN l USING (doc_id)),
      m AS (SELECT *, n <> '' AND (contains(line, n) OR (least(length(n), 20) >= 6 AND contains(line, left(n, 20))) OR (least(length(n), 10) >= 4 AND contains(line, left(n, 10)))) hit FROM c),
      under AS (SELECT doc_id, i, string_agg(say, chr(10) ORDER BY rule_id) says FROM m WHERE hit GROUP BY doc_id, i),
      body AS (SELECT doc_id, string_agg(line || coalesce(chr(10) || says, ''), chr(10) ORDER BY i) body FROM l LEFT JOIN under USING (doc_id, i) GROUP BY doc_id),
      lost AS (SELECT doc_id, rule_id, any_value(say) || CASE WHEN any_value(k) <> '' THEN chr(10) || '> 相关片段：' || left(any_value(k), 120) ELSE '' END say FROM m GROUP BY doc_id, rule_id HAVING NOT bool_or(hit)),
      tail AS (SELECT doc_id, chr(10) || chr(10) || '> # 未定位到原文段落的批注汇总' || chr(10) || string_agg(say, chr(10) ORDER BY rule_id) tail FROM lost GROUP BY doc_id)
      SELECT doc_id, sha1(body || coalesce(tail, '')) annotated_sha1 FROM body LEFT JOIN tail USING (doc_id)""",
}

#: Folds of the catalogue's other queries, told in SQL by reducing lists.
SQL |= {
    "greedy_packing": """WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: [x]) l FROM documents WHERE text IS NOT NULL),
      r AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) <= 400 THEN list_append(list_slice(a, 1, -2), a[-1] || chr(10) || x[1]) ELSE list_concat(a, x) END) l FROM p)
      SELECT doc_id, unnest(range(len(l)))::INT pos, unnest(l) piece FROM r""",
    "span_resolve": """WITH n AS (SELECT doc_id, length(text) n FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, list_transform(range(CASE WHEN n <= 2800 THEN least(n, 400) ELSE n // 7 END + 1), lambda i: [{'a': i * 7, 'b': i * 7 + 1 + (i * i + doc_id) % 23}]) l FROM n),
      r AS (SELECT doc_id, unnest(list_reduce(l, lambda k, x: CASE WHEN x[1].a >= k[-1].b THEN list_concat(k, x) ELSE k END)) s FROM s)
      SELECT doc_id, s.a::INT "start", s.b::INT "end" FROM r""",
    "split_suggestion": """WITH t AS (SELECT doc_id, replace(text, '. ', '。') t FROM documents), h AS (SELECT *, length(t) // 2 h FROM t),
      f AS (SELECT doc_id, h, list_filter(list_transform(range(121), lambda d: CASE WHEN contains('。；;！？' || chr(10), substring(t, h + d, 1)) THEN h + d WHEN contains('。；;！？' || chr(10), substring(t, h - d, 1)) THEN h - d END), lambda x: x IS NOT NULL AND x > 0 AND x < length(t)) l FROM h)
      SELECT doc_id, coalesce(l[1], h) + 1 cut FROM f""",
}
