"""Citations of articles: extraction, verification against the corpus, location."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import LAWS
from .text import arabic_to_chinese, article_number

_NUMBER = "第([一二三四五六七八九十百千零〇两0-9]+)条"
#: Names that end in a kind of rule.
_GENERIC = rf"《?([一-鿿]{{2,20}}(?:法典|法|条例|规定|解释|办法|规则))》?{_NUMBER}"
#: What introduces a citation is not part of its name.
_LEAD_IN = "^.*(?:根据|依据|按照|依照)"


def _known(laws: dict[str, list[str]]) -> str:
    names = {n for key, full in laws.items() for n in (key, *full)}
    return "|".join(rf"\Q{n}\E" for n in sorted(names, key=lambda n: (-len(n), n)))


def canonical(name: Column, laws: dict[str, list[str]] = LAWS) -> Column:
    """Full name of a law known by an alias, other names as they are."""
    pairs = [F.lit(x) for key, full in laws.items() for alias in dict.fromkeys((key, *full)) for x in (alias, full[0])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name


def extract(docs: DataFrame, key: str, text: str, laws: dict[str, list[str]] = LAWS) -> DataFrame:
    """key, law_name, article_no, raw: known laws first, then names of that form; each once."""
    body = F.coalesce(F.col(text), F.lit(""))
    known = rf"《?({_known(laws)})》?{_NUMBER}"

    def found(rank: int, pattern: str, of: Column) -> Column:
        raw, name, number = (F.regexp_extract_all(of, F.lit(pattern), F.lit(i)) for i in (0, 1, 2))
        return F.transform(raw, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x.alias("raw"), F.regexp_replace(F.get(name, i), _LEAD_IN, "").alias("name"), F.get(number, i).alias("number")))

    # other names are looked for in what the known laws leave
    both = [found(0, known, body), found(1, _GENERIC, F.regexp_replace(body, known, "|"))]
    rows = docs.select(key, F.explode(F.concat(*both)).alias("c"))
    rows = rows.select(key, canonical(F.col("c.name"), laws).alias("law_name"), article_number(F.col("c.number")).alias("article_no"), "c.raw", F.struct("c.rank", "c.i").alias("_at"))
    return rows.groupBy(key, "law_name", "article_no").agg(F.min_by("raw", "_at").alias("raw"))


def verify(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations with status 'verified' where a chunk of that law has the article, else 'unverifiable'.

    `chunks` has law_name and articles (array). Both sides are made distinct before they meet.
    """
    known = chunks.select("law_name", F.explode("articles").alias("article_no")).distinct().withColumn("_known", F.lit(True))
    out = citations.join(known, ["law_name", "article_no"], "left")
    return out.withColumn("status", F.when(F.col("_known"), F.lit("verified")).otherwise(F.lit("unverifiable"))).drop("_known")


#: Any article's heading, in either numerals.
_HEADING = "第[一二三四五六七八九十百千零〇两0-9]+条"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def locate(text: Column, article_no: Column, before: int = 30, most: int = 600) -> Column:
    """Snippet of an article: from its heading (either numerals) to the next article's, however far
    that is, or `most` characters if none follows, with `before` characters of context; null if it
    isn't there."""
    by_digits = F.instr(text, F.concat(F.lit("第"), article_no, F.lit("条")))
    by_words = F.instr(text, F.concat(F.lit("第"), arabic_to_chinese(article_no.cast("int")), F.lit("条")))

    def article(at: Column, tail: Column) -> Column:
        head = F.instr(tail, "条")
        start = F.greatest(F.lit(1), at - before)
        after = F.substr(tail, head + 1)
        ends = lambda next_: F.when(next_ > 0, head + next_ - 1).otherwise(F.lit(most))
        end = _with(F.regexp_instr(after, F.lit(_HEADING)), ends)
        return F.concat(F.substring(text, start, at - start), F.substring(tail, F.lit(1), end))

    return _with(F.when(by_digits > 0, by_digits).otherwise(by_words), lambda at: F.when(at > 0, _with(F.substr(text, at), lambda tail: article(at, tail))))
