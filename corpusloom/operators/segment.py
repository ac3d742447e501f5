"""Segmentation of Han text by a lattice of words: of all ways to cut a run of Han into words of a
lexicon and single characters, the one whose log-frequencies have the largest sum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are broadcast at most, some 30 bytes each; a larger lexicon is an error.
MAX_WORDS = 2_000_000
_PIECES = r"\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+"


class Lattice:
    """A trie of words, as the set of their beginnings, with a weight where a word ends."""

    def __init__(self, words: dict[str, int]) -> None:
        total = sum(words.values())
        self.unknown = -math.log(max(total, 1))
        #: None: words go on here, but none ends.
        self.weight: dict[str, float | None] = {}
        for word, freq in words.items():
            for n in range(1, len(word)):
                self.weight.setdefault(word[:n], None)
            self.weight[word] = math.log(freq) - math.log(total)

    def cut(self, run: str) -> list[str]:
        """The best path from the end to the start; among equal ones the one with the longer first word."""
        best = [0.0] * (len(run) + 1)
        step = [1] * len(run)
        for i in range(len(run) - 1, -1, -1):
            own = self.weight.get(run[i])
            best[i] = (self.unknown if own is None else own) + best[i + 1]
            j = i + 1
            while j < len(run) and run[i:j] in self.weight:
                j += 1
                w = self.weight.get(run[i:j])
                if w is not None and w + best[j] >= best[i]:
                    best[i], step[i] = w + best[j], j - i
        out, i = [], 0
        while i < len(run):
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def segmented(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, toks: lower-cased tokens in order, runs of Han cut by the lexicon (word, freq; a word given
    twice counts with its larger frequency, frequencies below 1 as 1), other tokens whole. Words of
    other letters than Han decide nothing."""
    spark = docs.sparkSession
    words = lexicon.select(F.lower("word").alias("word"), F.greatest(F.coalesce("freq", F.lit(1)), F.lit(1)).cast("long").alias("freq")).where(F.col("word").rlike(r"^\p{IsHan}+$"))
    words = words.groupBy("word").agg(F.max("freq").alias("freq"))
    if words.limit(MAX_WORDS + 1).count() > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words")
    shared = spark.sparkContext.broadcast({r.word: r.freq for r in words.toLocalIterator()})
    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_PIECES), F.lit(0))
    han = F.transform(pieces, lambda p: p.rlike(r"^\p{IsHan}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            toks = [[t for p, cut in zip(ps, hs, strict=True) for t in (lattice.cut(p) if cut else (p,))] for ps, hs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(toks, pa.list_(pa.string()))], names=[key, "toks"])

    return docs.select(key, pieces.alias("_p"), han.alias("_h")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, toks array<string>")
