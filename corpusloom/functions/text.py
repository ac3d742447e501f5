"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CN_DIGITS, CN_UNITS

#: One class for Spark and for engines without Unicode \w.
WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def lexicon_tokens(text: Column, lexicon: list[str]) -> Column:
    """Tokens where runs of Han are cut into lexicon words (longest first), else single characters."""
    terms = sorted({w.lower() for w in lexicon if w}, key=lambda w: (-len(w), w))
    quoted = "|".join(rf"\Q{w}\E" for w in terms)
    pattern = (f"{quoted}|" if terms else "") + r"\p{IsHan}|[\p{L}\p{N}_&&[^\p{IsHan}]]+"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def token_estimate(text: Column) -> Column:
    """At least one, else half the characters."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 2)).cast("int")


def normalise_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def chinese_to_arabic(text: Column) -> Column:
    """Digits set a number, a unit multiplies it (or one) and adds it; other characters are nothing."""
    digit = F.create_map(*[F.lit(x) for kv in CN_DIGITS.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in CN_UNITS.items() for x in kv])
    zero = F.struct(F.lit(0).alias("done"), F.lit(0).alias("held"))

    def step(acc: Column, c: Column) -> Column:
        d, u = F.try_element_at(digit, c), F.try_element_at(unit, c)
        return F.struct(
            F.when(u.isNotNull(), acc["done"] + F.greatest(acc["held"], F.lit(1)) * u).otherwise(acc["done"]).alias("done"),
            F.when(d.isNotNull(), d).when(u.isNotNull(), F.lit(0)).otherwise(acc["held"]).alias("held"),
        )

    return F.aggregate(F.split(text, ""), zero, step, lambda acc: acc["done"] + acc["held"])


def article_number(raw: Column) -> Column:
    """A number as Arabic digits, whichever way it is written."""
    return F.when(raw.rlike("^[0-9]+$"), raw).otherwise(chinese_to_arabic(raw).cast("string"))


def arabic_to_chinese(n: Column) -> Column:
    """Numbers from 0 to 9999 in Chinese numerals."""
    digits = F.array(*[F.lit(c) for c in "零一二三四五六七八九"])

    def at(power: int) -> Column:
        return (F.floor(n / power) % 10).cast("int")

    out = F.lit("")
    for power, unit in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = at(power)
        gap = (n >= power * 10) & (d == 0) & (F.floor(n % power) > 0) & (at(power * 10) != 0) if power > 1 else F.lit(False)
        out = F.concat(out, F.when(d > 0, F.concat(F.get(digits, d), F.lit(unit))).when(gap, F.lit("零")).otherwise(F.lit("")))
    out = F.when((n >= 10) & (n < 20), F.substring(out, 2, 9)).otherwise(out)
    return F.when(n == 0, F.lit("零")).otherwise(F.regexp_replace(out, "([千])([一二三四五六七八九])$", "$1零$2"))


def snippet(text: Column, at: Column, before: int = 40, after: int = 120) -> Column:
    """Characters [at - before, at + after) around the 1-based position `at`, on one line."""
    start = F.greatest(F.lit(1), at - before)
    return F.replace(F.substring(text, start, at + after - start), F.lit("\n"), F.lit(" "))


def document_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def chunk_id(doc_id: Column, order: Column) -> Column:
    return F.concat(F.lit("chunk:"), F.substring(F.sha2(F.concat(doc_id, F.lit(":"), order.cast("string")), 256), 1, 16))


def content_chunk_id(text: Column) -> Column:
    return F.concat(F.lit("chunk:"), F.substring(F.sha1(text), 1, 16))


def embedding_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), text), 256)


def strip_disclaimer(text: Column, lines: list[str]) -> Column:
    """Text without the lines that contain one of `lines`."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.greatest(*[F.contains(x, F.lit(s)) for s in lines], F.lit(False)))
    return F.array_join(kept, "\n")
