"""Toxicity by a lexicon whose misspellings are found with Levenshtein automata.

The lexicon is a trie of whole words and of word stems: a fixed list of common insults and what
a bounded sample of labelled texts adds. The trie is intersected with the Levenshtein automaton
of each entry's edit budget; the product is determinised lazily, so that reading a word costs a
table lookup a letter and most words end in the dead state after three. Hits are weighed by
their context: a window of words around each tells quotation (quotation marks, verbs of saying)
from abuse (second person, exclamation). A logistic model over these figures gives the score.

Labels, language, source and doc_id are no input of a score. Defined results: null and empty
texts have no words and get the model's score for that; without usable labels the fixed list
and fixed weights are used; labels for unknown documents and null labels are ignored; several
labels of a document count as toxic if one is; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io as io

#: Labelled rows that the model may see, taken in the order of a hash of doc_id.
SAMPLE_ROWS = 4000
THRESHOLD = 0.3
#: Words on either side of a hit that tell its context.
CONTEXT = 6
_CACHE_WORDS = 200_000

# Common English insults, and words that tell quotation or address.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb fool vermin filthy jerk bastard".split()
SAYING = set("said says say wrote writes quote quoted quotes called calls term word words phrase dit appelé sagte schrieb genannt wort dijo llamó palabra mot".split())
ADDRESS = set("you your yours youre u ya tu toi vous votre du dich dein euch ihr eres tú vosotros ustedes".split())
QUOTES = "\"“”„«»‘’'>"

_WORD = re.compile(r"[^\W_]+")


@dataclass
class Entry:
    term: str
    weight: float
    stem: bool = False
    edits: int = 0


@dataclass
class Lexicon:
    """Trie of the entries times their Levenshtein automata, determinised as words are read."""

    entries: list[Entry]
    _kids: list[dict[str, int]] = field(default_factory=lambda: [{}])
    _ends: list[list[int]] = field(default_factory=lambda: [[]])
    _budget: list[int] = field(default_factory=lambda: [0])
    _states: dict[frozenset, int] = field(default_factory=dict)
    _sets: list[frozenset] = field(default_factory=list)
    _next: list[dict[str, int]] = field(default_factory=list)
    #: Of each state the (entry, edits) within their budget that end there: stems, and whole words.
    _stems: list[list[tuple[int, int]]] = field(default_factory=list)
    _words: list[list[tuple[int, int]]] = field(default_factory=list)
    #: Words that are known to match nothing; emptied when it is full.
    clean: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for i, e in enumerate(self.entries):
            node = 0
            self._budget[0] = max(self._budget[0], e.edits)
            for c in e.term:
                if c not in self._kids[node]:
                    self._kids[node][c] = len(self._kids)
                    self._kids.append({})
                    self._ends.append([])
                    self._budget.append(0)
                node = self._kids[node][c]
                self._budget[node] = max(self._budget[node], e.edits)
            self._ends[node].append(i)
        self._state(frozenset())
        self._state(self._closed({(0, 0)}))

    def _state(self, members: frozenset) -> int:
        if members not in self._states:
            self._states[members] = len(self._sets)
            self._sets.append(members)
            self._next.append({})
            ends = [(k, e) for node, e in members for k in self._ends[node]]
            self._stems.append([(k, e) for k, e in ends if self.entries[k].stem and e <= self.entries[k].edits])
            self._words.append([(k, e) for k, e in ends if not self.entries[k].stem and e <= self.entries[k].edits])
        return self._states[members]

    def _closed(self, members: set[tuple[int, int]]) -> frozenset:
        """With letters of the lexicon left out; of a node only the fewest edits."""
        best: dict[int, int] = {}
        todo = list(members)
        while todo:
            node, e = todo.pop()
            if node == -1:
                best[-1] = 0
                continue
            if e > self._budget[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(kid, e + 1) for kid in self._kids[node].values()]
        return frozenset(best.items())

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self._sets[state]:
            for letter, kid in self._kids[node].items():
                after.add((kid, e if letter == c else e + 1))
            after.add((node, e + 1))
        return self._state(self._closed(after))

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(entry, edits) of the whole words that this word is or misspells, and of the stems that
        it goes on from, also misspelt."""
        found: dict[int, int] = {}
        state, table, stems = 1, self._next, self._stems
        left = len(word)
        for c in word:
            to = table[state].get(c)
            if to is None:
                to = table[state][c] = self._step(state, c)
            state = to
            if not state:
                break
            left -= 1
            if left and stems[state]:
                for k, e in stems[state]:
                    found[k] = min(e, found.get(k, 9))
        for k, e in self._words[state]:
            found[k] = min(e, found.get(k, 9))
        if not found:
            if len(self.clean) >= _CACHE_WORDS:
                self.clean.clear()
            self.clean.add(word)
        if len(self._sets) > _CACHE_WORDS:
            for kept in (self._states, self._sets, self._next, self._stems, self._words):
                kept.clear()
            self._state(frozenset()), self._state(self._closed({(0, 0)}))
        return tuple(sorted(found.items()))


def context(text: str, begin: int, end: int) -> tuple[bool, bool]:
    """(quoted?, addressed to somebody?) for the hit at text[begin:end], by the words around it."""
    tokens = [m.span() for m in _WORD.finditer(text)]
    at = bisect_left(tokens, (begin, begin))
    return _told(text, tokens, at, bisect_left(tokens, (end, end)))


def _told(text: str, tokens: list[tuple[int, int]], first: int, after: int) -> tuple[bool, bool]:
    """As `context`, for the hit from token `first` up to token `after`."""
    near = {text[a:b].lower() for a, b in (*tokens[max(0, first - CONTEXT) : first], *tokens[after : after + CONTEXT])}
    begin, end = tokens[first][0], tokens[after - 1][1]
    opens, closes = text[max(0, begin - 2) : begin].strip(), text[end : end + 2].strip()
    marked = bool(opens) and opens[-1] in QUOTES and bool(closes) and closes[0] in QUOTES
    return marked or bool(near & SAYING), bool(near & ADDRESS) or "!" in text[end : end + 3]


N_FIGURES = 9


def figures(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the model sees of a text."""
    text = text or ""
    words = Counter(_WORD.findall(text.lower()))
    n = words.total()
    total = 0.0
    hits = near = 0
    terms: set[int] = set()
    hit_words = set()
    for word in words.keys() - lexicon.clean:
        found = lexicon.match(word)
        if not found:
            continue
        c = words[word]
        k, e = min(found, key=lambda x: (x[1], -lexicon.entries[x[0]].weight))
        terms.add(k)
        hits += c
        near += c * (e > 0)
        total += lexicon.entries[k].weight * math.log2(1 + c) * (0.8 if e else 1.0)
        hit_words.add(word)
    quoted = addressed = 0
    if hit_words:
        tokens = [m.span() for m in _WORD.finditer(text)]
        for i, (a, b) in enumerate(tokens):
            if text[a:b].lower() in hit_words:
                q, to = _told(text, tokens, i, i + 1)
                quoted += q
                addressed += to
    return [total, total / math.sqrt(n + 20), math.log1p(hits), len(terms), math.log1p(1000 * hits / (n + 20)), near / (hits + 1), quoted / (hits + 1), addressed / (hits + 1), math.log1p(n) * (hits > 0)]


@dataclass
class Model:
    entries: list[Entry]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: Iterable[list[float]]) -> np.ndarray:
        x = (np.asarray(list(rows), dtype=float).reshape(-1, N_FIGURES) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a ridge; (mean, scale, intercept and weights)."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def learn_terms(sample: list[tuple[str, int]], least_docs: int = 4, ratio: float = 6.0, gain: float = 15.0) -> list[Entry]:
    """Words and stems (first 4 to 8 letters) that occur far oftener in toxic texts."""
    bags = [(Counter(_WORD.findall((t or "").lower())), y) for t, y in sample]
    n = [sum(sum(b.values()) for b, y in bags if y == k) for k in (0, 1)]

    def forms(word: str) -> Iterator[str]:
        yield word
        for k in range(4, min(9, len(word))):
            yield word[:k] + "*"

    docs, toxic = Counter(), Counter()
    for bag, y in bags:
        if y:
            own = Counter()
            for word, c in bag.items():
                for form in forms(word):
                    own[form] += c
            docs.update(own.keys())
            toxic.update(own)
    wanted = {form for form, c in docs.items() if c >= least_docs and len(form) >= 4}
    clean, tainted = Counter(), Counter()
    for bag, y in bags:
        if not y:
            own = Counter()
            for word, c in bag.items():
                for form in forms(word):
                    if form in wanted:
                        own[form] += c
            clean.update(own)
            tainted.update(own.keys())
    n_toxic, n_clean = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    ranked = []
    for form in wanted:
        a, b = toxic[form], clean[form]
        lift = ((a + 0.5) / (n[1] + 1)) / ((b + 0.5) / (n[0] + 1))
        by_doc = ((docs[form] + 0.5) / (n_toxic + 1)) / ((tainted[form] + 0.5) / (n_clean + 1))
        expect = (a + b) * n[1] / max(1, n[0] + n[1])
        g = 2 * a * math.log(max(a, 1) / max(expect, 1e-9))
        if lift >= ratio and by_doc >= ratio / 2 and g >= gain:
            ranked.append((-g, form.endswith("*"), -len(form), form, math.log(lift)))
    chosen: list[Entry] = []
    for _, stem, _, form, weight in sorted(ranked):
        term = form.rstrip("*")
        # a stem covers longer words only, not the word that is equal to it
        if any(e.stem and term.startswith(e.term) and (stem or term != e.term) or stem and e.term.startswith(term) for e in chosen):
            continue
        chosen.append(Entry(term, weight, stem))
    return chosen


def fit(sample: list[tuple[str, int]]) -> Model:
    """Lexicon and logistic weights from labelled texts."""
    learned = {(e.term, e.stem): e for e in learn_terms(sample)} if sample else {}
    entries = list(learned.values())
    have = {e.term for e in entries if not e.stem}
    entries += [Entry(t, 3.0) for t in INSULTS if t not in have]
    for e in entries:
        e.edits = _edits(e.term)
    # an entry whose misspellings are ordinary words here is matched as it stands
    lexicon, misses = Lexicon(entries), Counter()
    clean = [t for t, y in sample if not y]
    for text in clean:
        misses.update({k for w in set(_WORD.findall((text or "").lower())) for k, e in lexicon.match(w) if e > 0})
    for k, c in misses.items():
        if c > 0.002 * len(clean):
            entries[k].edits = 0
    lexicon = Lexicon(entries)
    y = np.array([y for _, y in sample], dtype=float)
    if len(sample) < 40 or y.sum() < 5 or y.sum() > len(y) - 5:
        return Model(entries, np.zeros(N_FIGURES), np.ones(N_FIGURES), np.array([-3.0, 0.4, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.5, 0.0]))
    return Model(entries, *logistic(np.array([figures(t, lexicon) for t, _ in sample]), y))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for measuring only."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """At most `most` labelled texts that aren't held out, in the order of a hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "_label").collect()
    return [(r[1] or "", int(r[2] > 0)) for r in sorted(rows, key=lambda r: (r[0], r[1] or ""))]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, hits (terms found) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = Lexicon(own.entries)
        for batch in batches:
            rows = [figures(t.as_py(), lexicon) for t in batch.column(1)]
            s = own.scores(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array([int(r[3]) for r in rows], pa.int32())], names=["doc_id", "score", "predicted", "n_terms"])

    return io.in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, score double, predicted int, n_terms int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on labelled rows that aren't held out, then score every row."""
    scored = score(docs, fit(labelled_sample(docs, labels, "toxic", most)), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_terms")
