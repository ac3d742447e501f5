"""Plain restatements of the contracts, for comparison on small tables."""

import hashlib
import re

import pyarrow.parquet as pq

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(path, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(path, columns=list(columns)).to_pylist()]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def op5(docs, items, window=13):
    patterns = {}
    for item, text in items:
        ws = ALNUM.findall(lower(text))
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            patterns.setdefault(tuple(ws[i : i + n]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = {}
    for doc, text in docs:
        ws = ALNUM.findall(lower(text))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (who := patterns.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= who
        out[doc] = (len(ws), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(ws))
    return out


def op7(docs, length=20):
    first = {}
    texts = {d: SPACED.findall(t or "") for d, t in docs}
    for d in sorted(texts):
        ws = texts[d]
        for i in range(len(ws) - length + 1):
            first.setdefault(tuple(ws[i : i + length]), (d, i))
    out = {}
    for d, ws in texts.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] != (d, i):
                gone[i : i + length] = [True] * length
        out[d] = (len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return out


def shingles(text, size=4):
    ws = SPACED.findall(lower(text))
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def op6(docs, size=4, least=85):
    sets = {d: shingles(t, size) for d, t in docs}
    index, parent = {}, {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        shared = {}
        for s in sets[d]:
            for e in index.get(s, ()):
                shared[e] = shared.get(e, 0) + 1
            index.setdefault(s, []).append(d)
        for e, c in shared.items():
            if 100 * c >= least * (len(sets[d]) + len(sets[e]) - c):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def op9(pages):
    first = {}
    for page, html in sorted(pages):
        data = (html or "").encode()
        if len(data) >= 100:
            first.setdefault(data, page)
    out = {}
    for page, html in pages:
        data = (html or "").encode()
        owner = first.get(data, page)
        out[page] = (len(data), hashlib.sha256(data).hexdigest(), "response" if owner == page else "revisit", None if owner == page else owner)
    return out
