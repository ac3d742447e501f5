"""Understanding of questions: pre-filter, law and article mentions, negation, difficulty."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import COMPARISONS, EFFECT_LEVELS, LAWS, NEGATIONS, PROCEDURES, SMALL_TALK, TOPIC_HINTS
from .text import article_number

ARTICLE = "第([一二三四五六七八九十百千零〇两0-9]+)条"


@dataclass(frozen=True)
class Cues:
    """The word lists of a deployment; the defaults are those of `fixed`."""

    small_talk: list[str] = field(default_factory=lambda: SMALL_TALK)
    topics: list[str] = field(default_factory=lambda: TOPIC_HINTS)
    negations: list[str] = field(default_factory=lambda: NEGATIONS)
    comparisons: list[str] = field(default_factory=lambda: COMPARISONS)
    procedures: list[str] = field(default_factory=lambda: PROCEDURES)
    shortest: int = 8
    longest: int = 40


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def blocked_reason(query: Column, cues: Cues = Cues()) -> Column:
    """'trivial', 'short_non_legal' or null where the question may pass."""
    query = F.coalesce(query, F.lit(""))
    q = F.lower(F.regexp_replace(query, r"(?U)^\s+|\s+$", ""))
    trivial = (F.length(q) <= 1) | q.rlike(r"^(?U)[\s\W_]+$")
    for pattern in cues.small_talk:
        trivial = trivial | q.rlike(f"(?i){pattern}")
    short = ~contains_any(query, cues.topics) & (F.length(query) < cues.shortest)
    return F.when(trivial, F.lit("trivial")).when(short, F.lit("short_non_legal"))


def law_name(query: Column, laws: dict[str, list[str]] = LAWS) -> Column:
    """Full name of the law named in a question: longest name first, then the earliest."""
    found = []
    for key, names in laws.items():
        for alias in dict.fromkeys([*names, key]):
            at = F.instr(query, alias)
            found.append(F.when(at > 0, F.struct(F.lit(-len(alias)).alias("n"), at.alias("at"), F.lit(names[0]).alias("name"))))
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))["name"]


def effect_level(query: Column, levels: dict[str, list[str]] = EFFECT_LEVELS) -> Column:
    told = [F.when(contains_any(query, words), F.lit(level)) for level, words in levels.items()]
    return F.coalesce(*told, F.lit(None).cast("string"))


def articles(query: Column, cues: Cues = Cues()) -> Column:
    """array<struct<article_no, negated>> of the articles mentioned, in their order; negated if a
    cue stands in the five characters before."""
    # every piece but the last ends where a mention begins; its tail is the mention's context
    before = F.split(query, ARTICLE)
    raw = F.regexp_extract_all(query, F.lit(ARTICLE), F.lit(1))
    whole = F.regexp_extract_all(query, F.lit(ARTICLE), F.lit(0))

    def one(number: Column, i: Column) -> Column:
        # a context may reach into the mention before
        left = F.concat(F.coalesce(F.get(whole, i - 1), F.lit("")), F.get(before, i))
        return F.struct(article_number(number).alias("article_no"), contains_any(F.right(left, F.lit(5)), cues.negations).alias("negated"))

    return F.transform(raw, one)


def parse(queries: DataFrame, text: str = "query", cues: Cues = Cues(), laws: dict[str, list[str]] = LAWS) -> DataFrame:
    """queries with law_name, effect_level, articles, excluded, exact_match."""
    q = F.coalesce(F.col(text), F.lit(""))
    out = queries.withColumn("_mentions", articles(q, cues)).withColumn("law_name", law_name(q, laws)).withColumn("effect_level", effect_level(q))
    pick = lambda negated: F.transform(F.filter("_mentions", lambda m: m["negated"] == negated), lambda m: m["article_no"])
    out = out.withColumn("articles", pick(False)).withColumn("excluded", pick(True))
    return out.withColumn("exact_match", F.size("articles") > 0).drop("_mentions")


def difficulty(query: Column, exact: Column, cues: Cues = Cues()) -> Column:
    """struct<level, rule_hit, top_k>: the first rule that holds."""
    query = F.coalesce(query, F.lit(""))
    marks = F.length(query) - F.length(F.regexp_replace(query, "[?？]", ""))

    def told(level: str, rule: str, k: int) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule_hit"), F.lit(k).alias("top_k"))

    return (
        F.when(exact, told("simple", "exact_match", 5))
        .when(contains_any(query, cues.comparisons), told("hard", "compare_words", 10))
        .when((marks >= 2) | (F.length(query) > cues.longest), told("hard", "multi_question_or_long", 10))
        .when(contains_any(query, cues.procedures), told("medium", "procedure_words", 8))
        .otherwise(told("medium", "default", 8))
    )
