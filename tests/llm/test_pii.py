import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import pii
from corpusloom.llm import queries as q

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@pytest.fixture(scope="module")
def prose(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").select("text").limit(150).collect()]


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text("ab@.-+0123456789 ()%é", max_size=60))
def test_plain_spans_are_the_patterns(text):
    assert pii.detect(text) == base(text)
    got, _ = pii.find(text)
    assert got == base(text)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail jane.doe [at] example [dot] org now", ("email", "jane.doe [at] example [dot] org")),
        ("bob at mail dot example dot com ok", ("email", "bob at mail dot example dot com")),
        ("call plus one five five five one two three four five six seven eight", ("phone", "plus one five five five one two three four five six seven eight")),
        ("с@ехample.org", ("email", "с@ехample.org")),
        ("a​b@x.org", ("email", "a​b@x.org")),
        ("at one nine two dot one six eight dot one dot two end", ("ip", "one nine two dot one six eight dot one dot two")),
        ("card ４５３９ 1488 0343 6467.", ("card", "４５３９ 1488 0343 6467")),
        ("x (at) y.com", ("email", "x (at) y.com")),
        ("write john dot doe at example dot com", ("email", "john dot doe at example dot com")),
        ("Jane.Doe AT Example DOT Org", ("email", "Jane.Doe AT Example DOT Org")),
        ("host 192 dot 168 dot 1 dot 20 is up", ("ip", "192 dot 168 dot 1 dot 20")),
        ("host 10[.]0[.]0[.]1", ("ip", "10[.]0[.]0[.]1")),
        ("me&#x40;x.org", ("email", "me&#x40;x.org")),
        ("four one one one one one one one one one one one one one one one", ("card", "four one one one one one one one one one one one one one one one")),
    ],
)
def test_disguises_map_to_the_source(text, found):
    plain, added = pii.find(text)
    assert found in [(k, text[a:b]) for k, a, b in added]
    assert plain == base(text)


@settings(max_examples=300, deadline=None)
@given(st.text("ab @.[]()dot​аое１2one ", max_size=80))
def test_alignment_holds(text):
    x = pii.normalised(text)
    if x is not None:
        for i in range(len(x.text)):
            a, b, changed = x.source(i, i + 1)
            assert 0 <= a < b <= len(text)
            assert changed or text[a:b] == x.text[i]


@pytest.mark.parametrize("rest", ["", " the dot is here", " one, two"])
@pytest.mark.parametrize(("text", "found"), [("john at example.com", ("email", "john at example.com")), ("plus 1 five 5 five 1 two 3 four 5 six 7 eight", ("phone", "plus 1 five 5 five 1 two 3 four 5 six 7 eight"))])
def test_disguises_do_not_depend_on_the_rest(text, found, rest):
    text = f"write or call {text}.{rest}"
    assert found in [(k, text[a:b]) for k, a, b in pii.find(text)[1]]


NAMES, HOSTS, ENDS = ("anna", "bob.k", "j-smith", "info7", "maria", "x" * 70), ("mail", "example", "post", "a1"), ("com", "org", "net", "de")
FORMS = {
    "brackets": "{0} [at] {1} [dot] {2}", "parentheses": "{0} (at) {1} (dot) {2}", "said": "{0} at {1} dot {2}", "under": "{0}_at_{1}.{2}", "hyphens": "{0} -at- {1}.{2}", "blanks": "{0}  at  {1}  dot  {2}",
    "break": "{0} at\n{1} dot {2}", "arroba": "{0} arroba {1} punto {2}", "spaced": "{0} @ {1} . {2}", "apart": None, "wide": None, "many dots": "anna dot maria dot rosa dot de dot {0} at {1} dot example dot {2}",
    "entities": "{0}&#64;{1}&#46;{2}", "nobreak": "{0} @{1}.{2}",
}


@pytest.mark.parametrize("form", FORMS)
def test_recall_by_form(prose, form):
    """Addresses of mail in each disguise, planted into ordinary documents."""
    rng = random.Random(len(form))
    found = 0
    for text in prose:
        parts = rng.choice(NAMES), rng.choice(HOSTS), rng.choice(ENDS)
        if form == "under":
            parts = parts[0].replace("x" * 70, "y"), *parts[1:]
        shown = FORMS[form].format(*parts) if FORMS[form] else " ".join("anna@mail.com") if form == "apart" else "".join(chr(ord(c) + 0xFEE0) for c in "anna@mail.com")
        at = rng.choice([0, *[m.end() for m in re.finditer(r"[.\n] ", text)]])
        planted = f"{text[:at]}Write to: {shown}, {text[at:]}"
        found += ("email", shown) in {(k, planted[a:b]) for k, a, b in pii.find(planted)[1]}
    assert found >= 0.9 * len(prose)


@pytest.mark.parametrize("between", [" ", "-", ", ", "\n", "  "])
def test_recall_of_spelled_numbers(prose, between):
    words = "zero one two three four five six seven eight nine".split()
    found = 0
    for i, text in enumerate(prose):
        card = f"453914880343{i:03d}"
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        shown = between.join(words[int(c)] for c in card)
        planted = f"{text}\nCard: {shown}."
        found += ("card", shown) in {(k, planted[a:b]) for k, a, b in pii.find(planted)[1]}
    assert found >= 0.9 * len(prose)
    assert ("phone", "plus 12345 six seven eight nine") in {(k, t) for k, t in [(k, "call plus 12345 six seven eight nine"[a:b]) for k, a, b in pii.find("call plus 12345 six seven eight nine")[1]]}


def test_ordinary_documents_have_nothing_added(prose):
    assert sum(bool(pii.find(text)[1]) for text in prose) <= 0.01 * len(prose)


def test_long_chains_take_linear_time():
    began = time.perf_counter()
    for text in ("a  dot  " * 60_000, "a at " * 60_000, "a @ " * 60_000, "one " * 60_000, " " * 200_000 + "@", "a " * 100_000 + "@", "a.b " * 60_000):
        pii.find(text)
    assert time.perf_counter() - began < 30


def test_prose_has_no_added_spans():
    assert pii.find("One of the two met at noon. No one, two or three at a time dot. Un deux trois, 4 at 5.")[1] == []


def test_query_digests(spark):
    rows = q.op2_deobfuscated_pii(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_masking(spark, odd, none):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and pii.find_pii(none).count() == 0
    assert all(r.spans == "" for r in rows if r.doc_id in (3, 4))
    masked = pii.mask_column(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    df = spark.createDataFrame([(1, "é me@x.org!", 11), (2, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.mask_column(df).collect()] == [(1, "é [EMAIL]!", 10), (2, None, None)]
    assert pii.masked("abcdef", [("email", 1, 3), ("ip", 2, 5)]) == "a[EMAIL]f"
