"""Document fingerprints from spot signatures, in DataFrame expressions only.

Words are runs of letters and digits, lower-cased. Anchors are very common words of four
languages. Each run of anchors together with the CHAIN content words that follow it is a
signature. Lists and texts of other languages have few anchors; so word pairs whose hash is a
multiple of SAMPLED count too. A fingerprint is the sorted set of the 32-bit hashes of all these.
A text that has none of them has all its word pairs, a text of one word that word, a text without
words itself; the empty text has none. Likeness is the Jaccard similarity of the sets; two empty sets are alike.

Comparison is pruned by set length: sets of lengths a <= b cannot be more alike than a / b, so
near-duplicate search works within length bands and on the least signatures of each set.

Defined results: null text is empty; equal texts have equal fingerprints; rows with one doc_id
follow each other in the order of their texts; rows without doc_id are in no order, the text
after them is empty; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _io as io

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from he her his in is it its not of on or she that the their they this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui sa se son sur un une "
    "als auch auf aus bei das dem den der die ein eine einem einen einer es für im ist mit nicht sich sie sind und von werden wie zu zum zur "
    "al como con del el ella entre era está este esta las lo los más no para pero por si sin su sus también y ya"
).split()
CHAIN = 2
#: One word pair in so many, chosen by hash, is a signature besides.
SAMPLED = 8
#: Fewest common signatures come from sets of this likeness on.
THRESHOLD = 0.8


def _hash32(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))


def with_signatures(df: DataFrame, text: str, to: str, chain: int = CHAIN) -> DataFrame:
    """df with `to`: the sorted distinct signature hashes (array of long) of the column `text`.

    Built in steps that each name their result once, so that no array is made anew for each use.
    """
    if chain < 1:
        raise ValueError("a chain has one content word at least")
    df = df.withColumn("_words", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    # anchors get a "_", content words a blank: "of the sea by night" is "of_the_sea by_night "
    spots = F.array_join(F.transform("_words", lambda w: F.concat(w, F.when(w.isin(*ANCHORS), F.lit("_")).otherwise(F.lit(" ")))), "")
    # then each unit that begins with anchors also gets the content words that follow it, after a "+"
    following = "".join(" (?:[^ ]*_)?([^_ ]+)" for _ in range(chain - 1))
    copied = "".join(f"+${i + 2}" for i in range(chain - 1))
    spots = F.regexp_replace(spots, f"(?<![^ ])([^ ]*_[^_ ]+)(?={following} )", f"$1{copied}~")
    units = F.filter(F.split(spots, " "), lambda u: F.endswith(u, F.lit("~")))
    last = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_words", F.lit(1), last), F.slice("_words", F.lit(2), last), lambda a, b: _hash32(a, b))
    df = df.withColumn("_pairs", pairs)
    some = F.filter("_pairs", lambda x: x % SAMPLED == 0)
    df = df.withColumn("_found", F.concat(F.transform(units, lambda u: _hash32(u)), some))
    alone = F.when(F.size("_words") > 0, F.array(_hash32(F.get("_words", 0)))).when(F.col(text) != "", F.array(_hash32(F.col(text)))).otherwise(F.array().cast("array<bigint>"))
    chosen = F.when(F.size("_found") > 0, F.col("_found")).when(F.size("_pairs") > 0, F.col("_pairs")).otherwise(alone)
    return df.withColumn(to, F.sort_array(F.array_distinct(chosen))).drop("_words", "_pairs", "_found")


def fingerprint(sigs: Column) -> Column:
    """The set as text: eight hexadecimal digits a signature, in order."""
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity; sets whose lengths rule out `at_least` are not compared and get 0."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(most == 0, F.lit(1.0)).when((least == 0) | (least < at_least * most), F.lit(0.0)).otherwise(exact)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs, and next_text, next_sigs of the row with the next doc_id (the first
    one's after the last).

    Texts are dealt once, into ranges of doc_id cut at quantiles; each range also gets the first
    row of the next. Only the cuts, a few numbers per partition, go through the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(4096, io.buckets(spark))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    width = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    longs = "array<bigint>"
    heads = F.array(*[F.lit(c[0]) for c in chunks if c]).cast(longs)
    rows = F.array(*[F.array(*[F.lit(x) for x in c]).cast(longs) for c in chunks]).cast("array<array<bigint>>")
    chunk = F.size(F.filter(heads, lambda x: x <= F.col("doc_id"))) - 1
    docs = docs.withColumn("_chunk", F.greatest(chunk, F.lit(0)))
    within = F.size(F.filter(F.get(rows, F.col("_chunk")), lambda x: x <= F.col("doc_id")))
    loose = -1 - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    docs = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), loose).otherwise(F.col("_chunk") * width + within).alias("bucket"))
    firsts = dict(docs.where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    filled = sorted(firsts)
    last = max(filled, default=0)
    first_of = F.array(*[F.lit(firsts.get(b)).cast("bigint") for b in range(last + 1)])
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    prior = F.array(*[F.lit(before.get(b)).cast("int") for b in range(last + 1)])
    here = (F.col("bucket") >= 0) & (F.col("doc_id") == F.get(first_of, F.col("bucket")))
    borrowed = docs.where(here).select("doc_id", "text", F.get(prior, F.col("bucket")).alias("bucket"), F.lit(1).alias("late"))
    dealt = docs.withColumn("late", F.lit(0)).unionByName(borrowed).repartition("bucket")
    dealt = with_signatures(dealt, "text", "sigs")
    w = Window.partitionBy("bucket").orderBy("late", "doc_id", "text")
    after = [F.when(F.col("doc_id").isNotNull(), F.lead(c).over(w)) for c in ("text", "sigs")]
    dealt = dealt.select("doc_id", "text", "sigs", "late", after[0].alias("_text"), after[1].alias("_sigs")).where("late = 0")
    return dealt.select("doc_id", "text", "sigs", F.coalesce("_text", F.lit("")).alias("next_text"), F.coalesce("_sigs", F.array().cast(longs)).alias("next_sigs"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = in_order(docs).withColumn("edited", edited)
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id: the least doc_id reachable by pairs of likeness `threshold` or more.

    Equal fingerprints are one class from the start. The others meet in length bands on the
    least signatures of their sets (linked sets share one of the first n - ceil(threshold * n) + 1);
    each first with one partner, and then only across classes that are still apart.
    """
    from .parity_join import components

    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sets = with_signatures(sets, "text", "sigs").select("doc_id", "sigs")
    sets = io.written(sets.withColumn("size", F.size("sigs")).withColumn("print", F.sha2(fingerprint(F.col("sigs")), 256)), "spots")
    least = sets.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    member = io.written(sets.select("doc_id", "print").join(least, "print").select("doc_id", "class_id"), "spot-classes")
    # each set goes to the band of its length, and to the next if a longer partner can be there
    band = F.floor(F.log(F.col("size")) / math.log(1 / threshold)).cast("int")
    longest = F.floor(F.log(F.col("size") / threshold) / math.log(1 / threshold) + 1e-9).cast("int")
    prefix = F.slice("sigs", 1, F.col("size") - F.ceil(threshold * F.col("size") - 1e-9).cast("int") + 1)
    heads = sets.join(least.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).where("size > 0")
    keys = heads.select("doc_id", F.explode(F.array_distinct(F.array(band, longest))).alias("band"), prefix.alias("prefix")).select("doc_id", "band", F.explode("prefix").alias("sig"))
    keys = io.written(keys, "spot-keys")

    def alike(pairs: DataFrame) -> DataFrame:
        one = heads.select(F.col("doc_id").alias("a"), F.col("sigs").alias("_x"))
        other = heads.select(F.col("doc_id").alias("b"), F.col("sigs").alias("_y"))
        return pairs.join(one, "a").join(other, "b").where(likeness(F.col("_x"), F.col("_y"), threshold) >= threshold).select("a", "b")

    centers = keys.groupBy("band", "sig").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    votes = keys.join(centers, ["band", "sig"]).where("a <> doc_id").groupBy("doc_id", "a").count()
    star = votes.groupBy(F.col("doc_id").alias("b")).agg(F.min_by("a", F.struct(-F.col("count"), F.col("a"))).alias("a")).select("a", "b")
    labels = components(alike(star))
    labels = heads.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    labels = io.written(labels, "spot-labels")
    open_ = keys.join(labels, "doc_id")
    apart = open_.groupBy("band", "sig").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("band", "sig")
    left = open_.join(apart, ["band", "sig"], "left_semi")
    right = left.select("band", "sig", F.col("doc_id").alias("b"), F.col("component").alias("_component"))
    pairs = left.withColumnRenamed("doc_id", "a").join(right, ["band", "sig"]).where("component < _component").select("a", "b").distinct()
    more = io.written(alike(pairs), "spot-links")
    ends = more.join(labels.select(F.col("doc_id").alias("a"), F.col("component").alias("_a")), "a").join(labels.select(F.col("doc_id").alias("b"), F.col("component").alias("_b")), "b")
    merged = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    final = labels.join(merged.select(F.col("doc_id").alias("component"), F.col("component").alias("_to")), "component", "left").select(F.col("doc_id").alias("class_id"), F.coalesce("_to", "component").alias("_class"))
    return member.join(final, "class_id", "left").select("doc_id", F.coalesce("_class", "class_id").alias("class_id"))
