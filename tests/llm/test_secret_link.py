import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries as q
from corpusloom.llm import secret_link as sl

ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


@pytest.fixture(scope="module")
def prose(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").select("text").limit(150).collect()]


def base(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], sl.BASE.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "ſecret", "toKen", "\n", "x"]), max_size=14).map("".join))
def test_base_spans_are_the_patterns(text):
    assert sl.detect(text) == base(text)


KEY = "Zx81kLmQp0vT77aBcD9eF2gH4iJ6"


def test_weak_parts_are_told_together_only():
    together = f"[a]\naccess_key_id = ASIA1234567890ABCDEF\n{KEY}\nendpoint: api.example.com\n"
    plain, added, links = sl.find(together)
    assert not plain and {k for k, _, _ in added} == {"identifier", "weak", "endpoint"} and len(links) == 2
    assert sl.find(f"just {KEY} alone")[1] == [] and sl.find("user = somebody, host: a.example.com")[1] == []
    assert sl.find(f"user = somebody\n\n{KEY}")[1] == []  # another block
    assert sl.find(f"user = somebody {'word ' * 100} {KEY}")[1] == []  # out of reach


def test_every_partner_in_scope_is_told():
    """Each part that overlaps nothing and stands in the scope of a told secret is a span."""
    spans = lambda text: {text[a:b] for _, a, b in sl.find(text)[1]}
    for sign in ("=", " = ", '="'):
        assert KEY in spans(f"client_id=abcd\nSK{sign}{KEY}\n")
    assert KEY * 6 in spans(f"login: bob1 / {KEY * 6}")
    text = f"endpoint: a1.example.com / host: b2.example.com / login: somebody / {KEY}"
    assert spans(text) == {"endpoint: a1.example.com", "host: b2.example.com", "login: somebody", KEY}
    assert spans(f"login: bob1 / user: {KEY}") == {"login: bob1", KEY}
    hexes = ".".join(["0123456789abcdef" * 2] * 6)
    assert sl.find(f"token={hexes}.{KEY} login: bob1")[1] == []  # within a base span
    many = "\n".join(f"host: h{i}.example.com" for i in range(20)) + f"\nlogin: bob1 / {KEY}"
    assert len(spans(many)) == 2 + sum(many.index(KEY) - m.end() <= sl.REACH for m in re.finditer(r"host: \S+", many)) > 8


def test_many_parts_are_linear():
    text = " ".join(f"user = name{i} {KEY}{i}" for i in range(4000))
    began = time.time()
    _, _, links = sl.find(text)
    assert len(links) <= (2 * sl.REACH // len("user = name1000 ") + 2) * 4000 and time.time() - began < 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([KEY, KEY[::-1], "user = somebody", "client_id=aaaaaaa1", "host: h1.example.com", "https://x.example.org/" + "p" * 300, "login: " + "n" * 150, "deadbeef" * 4, "word " * 30, "\n\n", "\n"]), max_size=25).map(" ".join))
def test_links_are_all_pairs_in_scope(text):
    plain, parts = sl.detect(text), sl.parts(text)
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    block = lambda s: sum(b < s[1] for b in breaks)
    apart = lambda x, y: max(x[1], y[1]) - min(x[2], y[2])
    want = set()
    for secret in (s for s in parts if s[0] == "weak" and not any(apart(s, x) < 0 for x in plain)):
        near = [s for s in [*plain, *parts] if s[0] != "weak" and 0 <= apart(secret, s) <= sl.REACH and block(s) == block(secret)]
        kinds = {"base" if s in plain else s[0] for s in near}
        if "identifier" in kinds or {"endpoint", "base"} <= kinds:
            want |= {(secret, s) for s in near}
    assert set(sl.linked(text, plain)) == want


def test_planted_credentials_are_found(spark):
    """Recall of credentials whose parts are planted into ordinary documents."""
    rng = random.Random(2)
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    ids = ("client_id={}", "access_key_id: {}", "user = {}", "login: {}", "Account = '{}'")
    ends = ("endpoint: {}.example.com", "https://{}.example.com/v1", "host={}.example.org:8443", "postgres://{}.example.net/db")
    found = clean = told = 0
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    for text in texts:
        told += bool(sl.find(text)[1])
        name = "".join(rng.choice(letters) for _ in range(8))
        key = "".join(rng.choice(letters) for _ in range(rng.choice((24, 40, 64, 200)))) + "aZ3"
        lines = [rng.choice(ids).format(name), rng.choice(("{}", "value {}", "'{}'", "sk = {}")).format(key), rng.choice(ends).format(name)]
        rng.shuffle(lines)
        at = rng.choice([0, len(text), *[m.end() for m in re.finditer(r"[.\n] ", text)]])
        planted = text[:at] + "\n\n" + "\n".join(lines) + "\n\n" + text[at:]
        found += any(planted[a:b] == key for _, a, b in sl.find(planted)[1])
        clean += 1
    assert found >= 0.95 * clean and told <= 0.02 * clean


ALPHABETS = {
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "lower": "abcdefghijklmnopqrstuvwxyz0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "small": "abcdefghijklmnopqrstuvwxyz", "hex": "0123456789ABCDEF", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


@pytest.mark.parametrize("n", [20, 32, 40])
@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_recall_of_keys_drawn_without_help(prose, alphabet, n):
    """Keys as they come, beside an identifier and a host, in ordinary documents."""
    rng = random.Random(n)
    found = 0
    for text in prose:
        key = "".join(rng.choices(ALPHABETS[alphabet], k=n))
        lines = [f"client_id={''.join(rng.choices(ALPHABETS['lower'], k=8))}", f"value {key}", "host=db1.example.com"]
        rng.shuffle(lines)
        at = rng.choice([0, len(text), *[m.end() for m in re.finditer(r"[.\n] ", text)]])
        between = rng.choice(["\n\n", "\r\n\r\n"])
        planted = text[:at] + between + "\n".join(lines) + between + text[at:]
        found += any(planted[a:b] == key for _, a, b in sl.find(planted)[1] + sl.detect(planted))
    assert found >= 0.9 * len(prose)


def test_ordinary_documents_and_slugs_have_no_links(prose):
    assert sum(bool(sl.find(text)[1]) for text in prose) <= 0.02 * len(prose)
    assert sl.find("user: anna\nhost: www.example.com\nsee /some/long/path-of-many-words/that-goes_on and thisisaverylongword")[1] == []
    assert sl.find("login: internationalizationalist host: internationalizationalist.example.com")[1] == []


def test_blank_lines_and_short_identifiers():
    assert sl.find(f"user = somebody\r\n\r\n{KEY}")[1] == []
    assert {k for k, *_ in sl.find(f"user={' ' * 9}bo\n{KEY}")[1]} == {"identifier", "weak"}


def test_query_digests(spark):
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    for r in q.op4_linked_secrets(spark, "/root/testdata/sf0.001").collect():
        spans = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in sl.BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_odd_rows(odd, none):
    rows = sl.find_secrets(odd).collect()
    assert len(rows) == odd.count() and sl.find_secrets(none).count() == 0
    assert {r.spans for r in rows if r.doc_id in (3, 4, 5)} == {""}
    assert [r.n_hex for r in rows if r.doc_id == 9] == [1]
