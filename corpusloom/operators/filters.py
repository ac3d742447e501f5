"""Filter dictionaries compiled to Column predicates, so that the scan gets what it can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

PUBLIC = "__public__"


def _and(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _or(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def compile_filter(condition: Mapping[str, Any] | None, arrays: Sequence[str] = ("articles",)) -> Column:
    """`must` (all), `should` (one at least), nested conditions; {key, match: {value | any}} and
    {is_empty: {key}}. On a column named in `arrays`, a match is an overlap. None is no limit."""
    if not condition:
        return F.lit(True)
    parts = []
    if "key" in condition:
        key, match = condition["key"].removeprefix("metadata."), condition["match"]
        values = match["any"] if "any" in match else [match["value"]]
        if key in arrays:
            parts.append(F.coalesce(F.arrays_overlap(F.col(key), F.array(*[F.lit(v) for v in values])), F.lit(False)))
        else:
            parts.append(F.col(key) == values[0] if "value" in match else F.col(key).isin(*values))
    if "is_empty" in condition:
        key = condition["is_empty"]["key"].removeprefix("metadata.")
        empty = F.col(key).isNull()
        parts.append(empty | (F.size(key) == 0) if key in arrays else empty)
    if condition.get("must"):
        parts.append(_and([compile_filter(c, arrays) for c in condition["must"]]))
    if condition.get("should"):
        parts.append(_or([compile_filter(c, arrays) for c in condition["should"]]))
    return _and(parts)


def public() -> Column:
    return (F.col("corpus") == "public") | F.col("corpus").isNull()


def own(folders: Sequence[str] | None = None, user: str = "local") -> Column:
    mine = (F.col("corpus") == "user") & (F.col("user_id") == user)
    return mine & F.col("folder").isin(*folders) if folders else mine


def scope(folders: Sequence[str] | None = None, user_folders: Sequence[str] | None = None, corpus_scope: str = "all", user: str = "local") -> Column:
    """Which chunks a search may see: folders before user_folders before corpus_scope."""
    if folders is not None:
        mine = [f for f in folders if f != PUBLIC]
        parts = ([public()] if PUBLIC in folders else []) + ([own(mine, user)] if mine else [])
        return _or(parts) if parts else F.lit(True)
    if user_folders:
        return own(user_folders, user)
    return {"public": public(), "user": own(None, user)}.get(corpus_scope, F.lit(True))


def parsed(law_name: Sequence[str] | str | None = None, articles: Sequence[str] | str | None = None) -> Column:
    """Predicates of a parsed question; its effect level is told, not filtered on."""
    must = []
    if law_name:
        must.append({"key": "law_name", "match": {"value": law_name} if isinstance(law_name, str) else {"any": list(law_name)}})
    if articles:
        must.append({"key": "articles", "match": {"any": [articles] if isinstance(articles, str) else list(articles)}})
    return compile_filter({"must": must})
