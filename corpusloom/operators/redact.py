"""Redaction: scanning, overlap resolution, masking with a mapping, restoring."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import (
    ADDRESS_WORDS, AFTER_NAME, BEFORE_NAME, CLEANUP, LABELS, NOT_ADDRESSES, NOT_COMPANIES, ORGANISATIONS, PARTIES, PATTERNS, POSTAL_WORDS, REVERSIBLE, ROLES,
    SHORT_ORGANISATIONS, TAGS, UNITS,
)
from ..session import checkpointed

_HAN = "一-龥"


def _any(words: Sequence[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


#: (category, pattern, group that is the value), in category order.
FINDERS: list[tuple[str, re.Pattern, int]] = [
    ("person_name", re.compile(rf"(?:{_any(ROLES)})[\s：:是为]*([{_HAN}]{{1,4}})\b"), 1),
    ("person_name", re.compile(rf"(?:{_any(LABELS)})[\s：:]*([{_HAN}]{{2,4}})"), 1),
    ("person_name", re.compile(rf"[{_HAN}]某某?(?!某)"), 0),
    ("person_name", re.compile(rf"[{''.join(BEFORE_NAME)}]([{_HAN}]{{2,4}})(?:{_any(AFTER_NAME)})"), 1),
    # the longest organisation word at the end of the shortest name; one of a letter only where the name ends
    ("company_name", re.compile(rf"[{_HAN}]{{2,20}}?(?:{_any(ORGANISATIONS)}|[{''.join(SHORT_ORGANISATIONS)}](?![{_HAN}]))"), 0),
    ("id_card", re.compile(PATTERNS["id_card"]), 0),
    ("credit_code", re.compile(PATTERNS["credit_code"]), 0),
    ("phone", re.compile(PATTERNS["phone"]), 0),
    # begins where its run of characters does, or at a plus right behind another address: one try a run
    ("email", re.compile(r"(?:(?<![\w.+-])|(?<=[\w.-])(?=\+))[\w.+-]++@[\w-]+\.[\w.-]+"), 0),
]
Span = tuple[str, str, int, int]

#: Layers of the document masker with numbered tags. Amounts a period come before plain amounts, which
#: would leave their period behind, and percentages need no word before them.
NUMBERED_LAYERS: list[tuple[str, str]] = [
    ("ID", PATTERNS["id_card"]),
    ("PHONE", PATTERNS["phone"]),
    ("CREDIT_CODE", PATTERNS["credit_code"]),
    ("AMOUNT_PERIOD", r"[\d,]+\.?\d*\s*元/(?:月|日|年)"),
    ("AMOUNT", rf"[\d,]+\.?\d*\s*(?:{'|'.join(UNITS)})"),
    ("PERCENT", r"(?<![0-9.])\d+\.?\d*%"),
    ("CASE_NUMBER", PATTERNS["case_number"]),
]
#: Layers with plain tags before addresses. Names that end at an institution's word begin where their
#: run of Han does, so that a long run is tried once; account names and branches come before the
#: institutions that they may name; references of any form count.
DOCUMENT_LAYERS: list[tuple[str, str]] = [
    (r"(入库编号|档案编号|案件编号)[\s：:]*[\w-]+", "$1：{{REFERENCE_NUMBER}}"),
    (rf"(?<![{_HAN}])[{_HAN}]+?(?:高级|中级|基层|专门)?(?:人民)?法院\b", "{{COURT}}"),
    (PATTERNS["account_name"], "账户名称：{{ACCOUNT_NAME}}"),
    (PATTERNS["bank_branch"], "开户行：{{BANK_BRANCH}}"),
    (rf"(?<![{_HAN}])[{_HAN}]+?(?:银行|保险|证券|信托|基金|期货)(?:公司|集团)?\b", "{{FINANCIAL_INST}}"),
    (rf"(?<![{_HAN}])[{_HAN}]+?(?:大学|学院|学校|中学|小学|幼儿园|培训)(?:机构)?\b", "{{SCHOOL}}"),
    (rf"(?<![{_HAN}])[{_HAN}]+?(?:政府|委员会|局|厅|处|科|办|部)(?:机关)?\b", "{{GOVERNMENT}}"),
    (rf"[{_HAN}]{{2,20}}?(?:公司|企业|集团|厂|院|所|校|中心|站|社|店|馆|部|处|科|室)", "{{ORGANIZATION}}"),
    (PATTERNS["account_number"], "账号：{{ACCOUNT_NUMBER}}"),
    (PATTERNS["contract_number"], "合同编号：{{CONTRACT_NUMBER}}"),
    (PATTERNS["judge"], "$1：{{JUDGE}}"),
    (r"(?<![\w{])\d{16,19}(?!\d)", "{{BANK}}"),
    (r"\d{4}年\d{1,2}月(?:\d{1,2}日)?|\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}", "{{DATE}}"),
]
#: Layers with plain tags after addresses and postal codes; an address of mail is found in one try a run.
LAST_LAYERS: list[tuple[str, str]] = [
    (PATTERNS["license_plate"], "{{LICENSE_PLATE}}"),
    (r"(?:(?<![\w.-])|(?<=\w)(?=[.-]))[\w.-]++@[\w.-]+\.\w+", "{{EMAIL}}"),
    (PATTERNS["url"], "{{URL}}"),
    (PATTERNS["social_account"], "{{SOCIAL_ACCOUNT}}"),
]


def resolve(spans: list[Span]) -> list[Span]:
    """At each place the longest span that begins there, if the spans so far have left it free."""
    longest: dict[int, Span] = {}
    for span in spans:
        if span[1].strip() and span[3] > longest.get(span[2], span[:3] + (-1,))[3]:
            longest[span[2]] = span
    free, out = 0, []
    for start in sorted(longest):
        if start >= free:
            out.append(longest[start])
            free = longest[start][3]
    return out


def scan(text: str | None, categories: Sequence[str] | None = None) -> list[Span]:
    """(category, value, start, end): overlaps resolved within persons, companies, then among all."""
    found: dict[str, list[Span]] = {}
    for category, pattern, group in FINDERS:
        if categories is None or category in categories:
            spans = [(category, m[group], *m.span(group)) for m in pattern.finditer(text or "") if m[group] not in NOT_COMPANIES]
            found.setdefault(category, []).extend(spans)
    return resolve([s for category, spans in found.items() for s in (resolve(spans) if category in ("person_name", "company_name") else spans)])


#: A span with what is to stand in its place; null for a placeholder.
Item = tuple[str, str, int, int, str | None]


def mask(text: str, items: Sequence[Span | Item], method: str = "placeholder") -> tuple[str, list[dict]]:
    """(masked text, mapping) by one fold over the items from the last to the first: `left` up to
    `upto` is the text before them, `right` what stands behind, piece by piece. An item whose place
    doesn't hold its value takes the first place of the whole that does, if there is one."""
    left, upto, right = text, len(text), []
    numbers: Counter[str] = Counter()
    entries: list[dict] = []
    for category, value, start, end, *new in sorted(items, key=lambda item: item[2], reverse=True):
        if not 0 <= start <= end <= upto or left[start:end] != (value or left[start:end]):
            left, right = left[:upto] + "".join(reversed(right)), []
            upto = len(left)
            start = left.find(value) if value else -1
            end = start + len(value)
        if start < 0:
            continue
        tag = TAGS.get(category, TAGS["manual"])
        numbers[tag] += 1
        placeholder = f"{{{{{tag}_{numbers[tag]}}}}}"
        shown = next((n for n in new if n is not None), placeholder)
        right += [left[end:upto], shown]
        upto = start
        entries.append({"id": f"map_{len(entries) + 1}", "placeholder": placeholder, "category": category, "original": value, "masked_value": shown, "method": method, "start": start, "end": end})
    return left[:upto] + "".join(reversed(right)), entries


# -- DataFrame forms -------------------------------------------------------------------------

_SPANS = "array<struct<category:string,value:string,start:int,end:int>>"
_ENTRIES = "array<struct<id:string,placeholder:string,category:string,original:string,masked_value:string,method:string,start:int,end:int>>"


def _per_text(rows: DataFrame, key: str, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(values of columns) -> tuple, a row each, on Arrow batches within their partitions."""
    kind = rows.schema[key].dataType.simpleString()
    out_schema = f"{key} {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out_schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(*(c[i].as_py() for c in batch.columns[1:])) for i in range(len(batch))]
            columns_ = [pa.array([m[j] for m in made], arrow.field(j + 1).type) for j in range(len(arrow) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns_], schema=arrow)

    return rows.select(key, *columns).mapInArrow(run, out_schema)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", categories: Sequence[str] | None = None) -> DataFrame:
    """key, spans (array of category, value, start, end)."""

    def one(t: str | None) -> tuple:
        return ([dict(zip(("category", "value", "start", "end"), s, strict=True)) for s in scan(t, categories)],)

    return _per_text(docs, key, [text], one, f"spans {_SPANS}")


def mask_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: str = "spans", method: str = "placeholder") -> DataFrame:
    """key, masked, entries (the mapping) for docs with their spans. Method mask hides the middle of a
    value, hash shows a digest instead, anything else a numbered placeholder."""
    shown = {"mask": middle_mask, "hash": hash_mask}.get(method, lambda value, category: F.lit(None).cast("string"))
    new = F.transform(F.coalesce(F.col(spans), F.array().cast(_SPANS)), lambda s: shown(s["value"], s["category"]))

    def one(t: str | None, items: list | None, news: list) -> tuple:
        return mask(t or "", [(s["category"], s["value"], s["start"], s["end"], n) for s, n in zip(items or (), news, strict=True)], method)

    return _per_text(docs.withColumn("_new", new), key, [text, spans, "_new"], one, f"masked string, entries {_ENTRIES}")


def placeholders(docs: DataFrame, key: str = "doc_id", text: str = "text", categories: Sequence[str] | None = None) -> DataFrame:
    """key, masked, entries: texts scanned and masked by placeholders in one pass, a row each."""

    def one(t: str | None) -> tuple:
        return mask(t or "", scan(t, categories))

    return _per_text(docs, key, [text], one, f"masked string, entries {_ENTRIES}")


def resolve_spans(spans: Column) -> Column:
    """As resolve, for an array of structs with start and end; of equal starts the longest."""
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("_r"), i.alias("_i"))))

    def step(acc: Column, s: Column) -> Column:
        keep = s["start"] >= F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        return F.when(keep, F.concat(acc, F.array(F.struct(s["start"].alias("start"), (-s["_r"]).alias("end"))))).otherwise(acc)

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int>>"), step)


def middle_mask(value: Column, category: Column) -> Column:
    """The first and last character with up to six stars between; of an address, of its local part."""
    local, domain = F.substring_index(value, "@", 1), F.substring(value, F.instr(value, "@") + 1, F.length(value))
    n, m = F.length(local), F.length(value)
    email = F.when(n <= 2, F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.lit(1), n - 1)))).otherwise(F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.least(F.lit(6), n - 2)), F.right(local, F.lit(1))))
    other = F.when(m < 2, F.repeat(F.lit("*"), m)).when(m == 2, F.concat(F.left(value, F.lit(1)), F.lit("*"))).otherwise(F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), F.least(m - 2, F.lit(6))), F.right(value, F.lit(1))))
    return F.when((category == "email") & F.contains(value, F.lit("@")), F.concat(email, F.lit("@"), domain)).otherwise(other)


def hash_mask(value: Column, category: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return F.concat(F.lit("["), F.coalesce(F.try_element_at(tags, category), F.lit("PII")), F.lit(":"), F.upper(F.substring(F.sha1(value), 1, 10)), F.lit("]"))


def restore(text: Column, entries: Column) -> Column:
    """The text with entries (masked_value, original, method) undone, longest first; hashes stay."""
    usable = F.filter(entries, lambda e: (e["method"] != "hash") & (e["masked_value"] != ""))
    ordered = F.array_sort(F.transform(usable, lambda e, i: F.struct((-F.length(e["masked_value"])).alias("n"), i.alias("i"), e["masked_value"].alias("m"), e["original"].alias("o"))))
    return F.aggregate(ordered, text, lambda acc, e: F.replace(acc, e["m"], e["o"]))


def numbered(rows: DataFrame, order: str, kind: str, number: str = "number") -> DataFrame:
    """rows with their place (from 1) among those of their kind, by `order`, at any size.

    Rows are range-partitioned by order and written; each partition counts its kinds, and only
    these counts, one row a kind and partition, are summed up front.
    """
    dealt = checkpointed(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", kind).orderBy(order)
    before = Window.partitionBy(kind).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(kind, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return dealt.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(counts), [kind, "_part"]).withColumn(number, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def reversible_map(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None, kinds: Sequence[tuple[str, str]] = tuple(REVERSIBLE)) -> DataFrame:
    """kind, original, placeholder for everything the kinds find: originals of `known` (same
    columns) keep theirs; new ones are numbered by first occurrence, after the largest known."""
    rest, found = F.coalesce(F.col(text), F.lit("")), []

    def named(kind: str, i: int) -> Callable[[Column, Column], Column]:
        return lambda v, p: F.struct(F.lit(kind).alias("kind"), v.alias("original"), F.lit(i).alias("_i"), p.alias("_p"))

    for i, (kind, pattern) in enumerate(kinds):
        found.append(F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), named(kind, i)))
        rest = F.regexp_replace(rest, pattern, "\u0000")
    each = docs.select(key, F.explode(F.concat(*found)).alias("x")).select("x.kind", "x.original", F.struct(key, "x._i", "x._p").alias("_at"))
    first = each.groupBy("kind", "original").agg(F.min("_at").alias("_at"))
    if known is None:
        known = docs.sparkSession.createDataFrame([], "kind string, original string, placeholder string")
    new = numbered(first.join(known, ["kind", "original"], "left_anti"), "_at", "kind")
    largest = known.groupBy("kind").agg(F.max(F.regexp_extract("placeholder", "([0-9]+)\\]$", 1).cast("int")).alias("_max"))
    new = new.join(F.broadcast(largest), "kind", "left")
    number = (F.coalesce("_max", F.lit(0)) + F.col("number")).cast("string")
    new = new.select("kind", "original", F.concat(F.lit("["), "kind", number, F.lit("]")).alias("placeholder"))
    return known.select("kind", "original", "placeholder").unionByName(new)


def encrypted(mapping: DataFrame, key: str) -> DataFrame:
    """The mapping with its originals encrypted (AES-GCM, 16, 24 or 32 bytes of key)."""
    return mapping.withColumn("original", F.base64(F.aes_encrypt(F.col("original"), F.lit(key), F.lit("GCM"))))


def decrypted(mapping: DataFrame, key: str) -> DataFrame:
    return mapping.withColumn("original", F.aes_decrypt(F.unbase64("original"), F.lit(key), F.lit("GCM")).cast("string"))


def static_layers(text: Column, layers: Sequence[tuple[str, str]] = (*DOCUMENT_LAYERS, *LAST_LAYERS), cleanup: Sequence[tuple[str, str]] = tuple(CLEANUP)) -> Column:
    """The layers without a mapping as one expression; addresses and postal codes are left to layered_mask."""
    for pattern, tag in (*layers, *cleanup):
        text = F.regexp_replace(text, f"(?U){pattern}", tag)
    return text


_STATUTE = re.compile(r"第(?:[零一二三四五六七八九十百千万]+|\d+)(?:条|款|项)(?:之[零一二三四五六七八九十百千万\d]+)?(?:第(?:[零一二三四五六七八九十百千万]+|\d+)(?:条|款|项))*")
#: A word that no address may take in, or else an address: two characters at least before one of
#: its words, and all that follows up to the end of the word.
_PLACE = re.compile(rf"(?<!\w)(?:{_any(NOT_ADDRESSES)})[\s：:]*|([{_HAN}]{{2,30}}?(?:{_any(ADDRESS_WORDS)})[{_HAN}\d]{{0,50}}?(?:{_any(ADDRESS_WORDS)})?\b)")


#: What a reference that stands aside looks like to the layers: no letter, digit or Han.
_ASIDE = "\ue000"


@dataclass
class _Piece:
    """Characters [start, end) of the source and what stands for them: themselves (None) or a tag;
    `view` is what the layers see where that is something else."""

    start: int
    end: int
    shown: str | None = None
    kind: str = ""
    view: str | None = None


class Pieces:
    """A text as pieces of its source. A layer looks at what is shown so far and claims places of it;
    these become pieces that keep their place in the source, whatever was shown there before."""

    def __init__(self, source: str) -> None:
        self.source, self.pieces = source, [_Piece(0, len(source))] if source else []

    def _shown(self, p: _Piece) -> str:
        return self.source[p.start : p.end] if p.shown is None else p.shown

    def view(self) -> str:
        return "".join(p.view if p.view is not None else self._shown(p) for p in self.pieces)

    def claim(self, places: Iterable[tuple[int, int, str | None, str]]) -> None:
        """Places (start, end, shown, kind) of the view, in order, not overlapping, become pieces; where
        one cuts into a piece that isn't plain source, it takes in the whole. shown None stands aside."""
        out: list[_Piece] = []
        places = iter(places)
        place = next(places, None)
        at = 0
        taken: list[int] | None = None  # source places of the claim under way

        def closed() -> None:
            nonlocal place, taken
            if taken is not None and taken[0] < taken[1]:
                aside = place[2] is None
                out.append(_Piece(taken[0], taken[1], self.source[taken[0] : taken[1]] if aside else place[2], place[3], _ASIDE if aside else None))
            taken, place = None, next(places, None)

        for p in self.pieces:
            text = p.view if p.view is not None else self._shown(p)
            lo, hi, plain = at, at + len(text), p.shown is None
            at, rest = hi, lo
            if lo == hi:  # shows nothing: part of the claim under way, if there is one
                if taken is None:
                    out.append(p)
                else:
                    taken[1] = p.end
            while place is not None and place[0] < hi:
                a, b = max(place[0], lo), min(place[1], hi)
                if b <= a:  # what the place before has taken in, or an empty place
                    if place[1] <= hi:
                        closed()
                        continue
                    break
                if plain:
                    if a > rest:
                        out.append(_Piece(p.start + rest - lo, p.start + a - lo))
                    source = (p.start + a - lo, p.start + b - lo)
                    rest = b
                else:
                    if rest == hi and taken is None:  # taken in as a whole by an earlier place
                        if place[1] <= hi:
                            closed()
                            continue
                        source = None
                    else:
                        source, rest = (p.start, p.end), hi
                if source is not None:
                    taken = [source[0], source[1]] if taken is None else [taken[0], source[1]]
                if place[1] > hi:
                    break
                closed()
            if rest < hi:
                out.append(_Piece(p.start + rest - lo, p.end) if plain else p)
        if taken is not None:
            closed()
        self.pieces = out

    def layer(self, pattern: str | re.Pattern[str], shown: Callable[[re.Match[str]], str | None], kind: str) -> None:
        self.claim([(*m.span(), shown(m), kind) for m in re.finditer(pattern, self.view())])

    def result(self) -> tuple[str, list[dict]]:
        """(text, ledger): kind, shown and its place in the text, original and its place in the source."""
        parts, ledger, at = [], [], 0
        for p in self.pieces:
            text = self._shown(p)
            if p.shown is not None and p.view is None:
                ledger.append({"kind": p.kind, "shown": text, "at": at, "original": self.source[p.start : p.end], "start": p.start, "end": p.end})
            parts.append(text)
            at += len(text)
        return "".join(parts), ledger


def restored(masked: str, ledger: Sequence[dict]) -> str:
    """The source of a masked text and its ledger, exactly."""
    parts, at = [], 0
    for entry in ledger:
        parts += [masked[at : entry["at"]], entry["original"]]
        at = entry["at"] + len(entry["shown"])
    return "".join([*parts, masked[at:]])


def _postal_codes(view: str) -> Iterator[tuple[int, int, str, str]]:
    """Numbers of six digits where a word for postal codes stands further on in the line."""
    at = 0
    for line in view.split("\n"):
        last = max(line.rfind(w) for w in POSTAL_WORDS)
        if last > 0:
            yield from ((at + m.start(), at + m.end(), "{{POSTAL_CODE}}", "POSTAL_CODE") for m in re.finditer(r"\b\d{6}\b", line) if m.end() <= last)
        at += len(line) + 1


def _people(text: Pieces) -> None:
    """Persons get the code of their surname; further names of one surname a number behind it."""
    people = scan(text.view(), ["person_name"])
    surnames = sorted({s[1][0] for s in people})
    code = {s: PARTIES[i] if i < len(PARTIES) else f"方{i + 1}" for i, s in enumerate(surnames)}
    names: dict[str, list[str]] = {}
    places = []
    for _, value, start, end in sorted(people, key=lambda s: s[2]):
        same = names.setdefault(value[0], [])
        if value not in same:
            same.append(value)
        number = same.index(value) + 1
        places.append((start, end, f"{{{{PARTY_{code[value[0]]}{f'_{number}' if number > 1 else ''}}}}}", "PARTY"))
    text.claim(places)


def layered(source: str) -> tuple[str, list[dict]]:
    """The document masker: statute references stand aside, persons get codes by surname, numbers
    numbered tags, the rest plain tags. Every change, blanks included, is in the ledger with its
    place in the source, so `restored` gives the source back whatever the tags are."""
    text = Pieces(source)
    text.layer(_STATUTE, lambda m: None, "STATUTE")
    _people(text)
    for base, pattern in NUMBERED_LAYERS:
        count = itertools.count(1)
        text.layer(pattern, lambda m, base=base, count=count: f"{{{{{base}_{next(count)}}}}}", base)
    plain = lambda new: lambda m: m.expand(new.replace("$1", r"\1"))
    tag = lambda new: re.search(r"\{\{(.+?)\}\}|$", new)[1] or "BLANKS"
    for pattern, new in DOCUMENT_LAYERS:
        text.layer(pattern, plain(new), tag(new))
    text.claim([(*m.span(1), "{{ADDRESS}}", "ADDRESS") for m in _PLACE.finditer(text.view()) if m[1]])
    text.claim(_postal_codes(text.view()))
    for pattern, new in (*LAST_LAYERS, *CLEANUP):
        text.layer(pattern, plain(new), tag(new))
    text.layer(r"(\{\{(?:PARTY|AMOUNT|DATE|JUDGE)[^{}]*\}\})(?:\s*\1)+", lambda m: m[1], "REPEATED")
    return text.result()


def layered_mask(source: str) -> tuple[str, dict[str, str]]:
    """The masked text, and the original of each tag that stands for one alone."""
    masked, ledger = layered(source)
    own = {"PARTY", *(base for base, _ in NUMBERED_LAYERS)}
    return masked, {e["shown"]: e["original"] for e in ledger if e["kind"] in own}


_LEDGER = "array<struct<kind:string,shown:string,at:int,original:string,start:int,end:int>>"


def layered_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, masked, mapping (numbered tag to original), n_entities (distinct tags in the masked text),
    ledger (every change with its place in the masked text and in the source)."""

    def one(t: str | None) -> tuple:
        masked, ledger = layered(t or "")
        own = {"PARTY", *(base for base, _ in NUMBERED_LAYERS)}
        mapping = {e["shown"]: e["original"] for e in ledger if e["kind"] in own}
        return masked, list(mapping.items()), len(set(re.findall(r"\{\{[^{}]+\}\}", masked))), ledger

    return _per_text(docs, key, [text], one, f"masked string, mapping map<string,string>, n_entities int, ledger {_LEDGER}")


def restored_text(masked: Column, ledger: Column) -> Column:
    """`restored` as an expression: one pass over the ledger, in the order of places."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, e: Column) -> Column:
        kept = F.substring(masked, acc["at"] + 1, e["at"] - acc["at"])
        return F.struct((e["at"] + F.length(e["shown"])).alias("at"), F.concat(acc["parts"], F.array(kept, e["original"])).alias("parts"))

    return F.aggregate(ledger, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(masked, acc["at"] + 1)))


def apply_map(text: Column, mapping: Column) -> Column:
    """Each original of an array<struct<original, placeholder>> replaced, longest first."""
    ordered = F.array_sort(F.transform(mapping, lambda e: F.struct((-F.length(e["original"])).alias("n"), e["original"].alias("o"), e["placeholder"].alias("p"))))
    return F.aggregate(ordered, text, lambda acc, e: F.replace(acc, e["o"], e["p"]))
