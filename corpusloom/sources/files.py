"""Plain files: texts, rules, skills, lexicons, folders, configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_id
from ..schemas import RULES

EXTENSIONS = ("md", "txt", "pdf", "docx")


def whole_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def paragraph_blocks(texts: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """A plain text as a single paragraph block."""
    return texts.select(F.col(key).alias("doc_id"), F.lit(0).alias("order"), F.lit("paragraph").alias("type"), F.col(text).alias("content"))


def scan_folder(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """relpath, doc_id, content_hash, size, modified, content of the files below a folder."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    root = path.rstrip("/")
    relative = F.regexp_replace(F.col("path"), r"^.*?\Q" + root.split(":")[-1].lstrip("/") + r"\E/", "")
    return files.select(relative.alias("relpath"), document_id(F.col("content")).alias("doc_id"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def by_extension(files: DataFrame, parsers: Mapping[str, Callable[[DataFrame], DataFrame]], path: str = "relpath") -> DataFrame:
    """Union of what the parser of each extension makes of its files; other files are left out."""
    kind = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    out = None
    for extension, parser in parsers.items():
        part = parser(files.where(kind == extension))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parser")
    return out


def rules(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rules of JSON Lines files with `corrupt`: lines that aren't JSON are told, the others stay."""
    raw = spark.read.schema(RULES + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(list(paths))
    return raw.where(F.coalesce("status", F.lit("enabled")) != "disabled")


def lexicon(spark: SparkSession, path: str, frequency: int = 10_000, tag: str = "n") -> DataFrame:
    """word, freq, tag from lines `word [freq] [tag]`; `#` begins a comment line."""
    line = F.trim("value")
    parts = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#"))).select(F.split(line, r"\s+").alias("p"))
    return parts.select(F.col("p")[0].alias("word"), F.coalesce(F.try_element_at("p", F.lit(2)).try_cast("int"), F.lit(frequency)).alias("freq"), F.coalesce(F.try_element_at("p", F.lit(3)), F.lit(tag)).alias("tag"))


def skills(spark: SparkSession, paths: str) -> DataFrame:
    """path, meta (map of the scalar lines of the front matter), body of skill files."""
    texts = whole_texts(spark, paths)
    parts = F.split("text", r"(?m)^---\s*$", 3)
    lines = F.filter(F.split(parts[1], "\n"), lambda x: x.rlike(r"^[A-Za-z_]+:\s*\S"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit("\"' ")).alias("value"))
    return texts.where(F.startswith("text", F.lit("---"))).select("path", F.map_from_entries(F.transform(lines, entry)).alias("meta"), F.regexp_replace(parts[2], r"^\s+|\s+$", "").alias("body"))


def merged_config(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Configuration layers, later ones over earlier ones, one level deep."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = {**out[key], **value} if both else value
    return out


def public_config(config: Mapping[str, Any], secrets: Sequence[str] = ("api_key", "password", "token", "secret")) -> dict[str, Any]:
    """The configuration with its secrets shown as *** and a flag whether each is set."""
    out: dict[str, Any] = {}
    for key, value in config.items():
        if isinstance(value, Mapping):
            out[key] = public_config(value, secrets)
        elif key in secrets:
            out |= {key: "***" if value else "", f"{key}_set": bool(value)}
        else:
            out[key] = value
    return json.loads(json.dumps(out, default=str))
