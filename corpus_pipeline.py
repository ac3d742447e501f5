"""The corpus pipeline: five stages, each an operator over all that the one before kept.

A doc_id names one document: rows that repeat one are its texts and stay or go together, so a
document goes if one of its texts is toxic, a copy of a text of an earlier document, or contaminated.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. run() writes what a stage returns
as Parquet into the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import _io as io
from corpusloom.llm import decontam, mixing, parity_join, pii, toxicity


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in io.DOCUMENT_COLUMNS if c in docs.columns]


def _keep(docs: DataFrame, out: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in `out` (doc_id, long); rows without doc_id stay.

    Up to a million ids, 8 bytes each, are counted and broadcast; more are shuffled.
    """
    gone = out.distinct()
    few = gone.limit(1_000_001).count() <= 1_000_000
    return docs.select(_columns(docs)).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(_columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.fit(toxicity.labelled_sample(docs, io.table(spark, sf_dir, "labels"), "toxic"))
    scored = io.written(toxicity.score(docs, model).where("predicted = 1 and doc_id is not null").select("doc_id"), "toxic")
    return _keep(docs, scored)


#: Near copies share four fifths of their shingles of five words.
NEAR_COPIES = parity_join.Rule(shingle=5, least=80, whole=100)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    found = parity_join.similarity_components(docs, NEAR_COPIES)
    return _keep(docs, io.written(found.where("component_id <> doc_id").select("doc_id"), "copies"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more are benchmark windows go."""
    found = decontam.contamination(docs, io.table(spark, sf_dir, "benchmark"))
    return _keep(docs, io.written(found.where("contaminated and doc_id is not null").select("doc_id"), "contaminated"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.mask_column(docs.select(_columns(docs)))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate of each document at which the languages have equal shares of all tokens."""
    fit = mixing.mixed(docs, docs, "lang")
    return fit.rows.select("doc_id", "tokens", "posterior", "rate")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_domains),
]

#: The learnt stages, the similarity join and the rates can't be told in SQL; tests hold each
#: against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written besides its result is removed after it, and
    its result once the next one's is there."""
    docs, before = io.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with io.dropping(spark) as own:
            out = io.written(stage(spark, docs, sf_dir), f"stage-{name}")
            own.remove(path := own[-1])
            if before:
                own.append(before)
        docs, before = out, path
    return STAGES[-1][1](spark, docs, sf_dir)
