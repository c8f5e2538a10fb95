"""Artifacts as zlib-compressed JSON arrays of class records, and the index files of a catalogue."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = ".json.zlib"


def unit(value) -> list:
    """[instr, references, invokes, callee class, callee index] of a stored unit: a string, or a list of 2, 3 or 4 entries."""
    if isinstance(value, str):
        return [value, [], False, None, None]
    if not isinstance(value, list) or not 2 <= len(value) <= 4:
        raise ValueError(f"not a unit: {value!r}")
    callee = value[2:] if len(value) == 4 else [None, None]
    return [value[0], value[1] or [], len(value) > 2, *callee]


def stored_unit(u: list):
    """The shortest stored form of a unit. An invocation without references is not kept, as the format has no place for it."""
    instr, refs, invokes, cls, idx = u
    if not refs:
        return instr
    return [instr, refs] + ([cls, idx] if cls is not None else [None] if invokes else [])


def decode(content: bytes) -> list[dict]:
    """Class records of an artifact file, with units as five-entry lists."""
    classes = json.loads(zlib.decompress(content))
    for c in classes:
        for m in c["methods"]:
            m["blocks"] = [[unit(u) for u in b] for b in m["blocks"]]
    return classes


def encode(classes: list[dict]) -> bytes:
    out = []
    for c in classes:
        methods = [{k: v for k, v in (m | {"blocks": [[stored_unit(u) for u in b] for b in m["blocks"]]}).items() if v is not None} for c_m in [c["methods"]] for m in c_m]
        out.append({k: v for k, v in (c | {"methods": methods}).items() if v is not None})
    return zlib.compress(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode(), 9)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The artifact files under path, as (path, content, ...)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").load(path)


def read_representatives(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, cls, record) of the artifact files under path that stand for their content by their library's index.json; artifact is
    `library version, version ...` with all versions of that content. Files of no index are left out."""
    index = catalogue(spark, path).select(F.concat("library", F.lit("/"), "representative").alias("__at"), "name")
    at = F.regexp_replace(F.regexp_replace("path", "^(?:.*/)?([^/]+/[^/]+)$", "$1"), F.lit(SUFFIX.replace(".", "\\.") + "$"), F.lit(""))
    held = files(spark, path).withColumn("__at", at).join(F.broadcast(index), "__at")  # one row per version of a catalogue
    return _opened(held.select(F.concat("name", F.lit(SUFFIX)).alias("path"), "content"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, cls, record) of all artifact files under path; record is a class as JSON with full units."""
    name = F.regexp_replace("path", "^(?:.*/)?([^/]+/[^/]+)$", "$1")
    return _opened(files(spark, path).select(name.alias("path"), "content"))


def _opened(contents: DataFrame) -> DataFrame:

    def run(frames):
        for pdf in frames:
            rows = [(p.removesuffix(SUFFIX), c["name"], json.dumps(c)) for p, content in zip(pdf["path"], pdf["content"], strict=True) for c in decode(content)]
            yield pd.DataFrame(rows, columns=["artifact", "cls", "record"])

    return contents.mapInPandas(run, "artifact string, cls string, record string")


def write(records: DataFrame, path: str) -> None:
    """Records as a table partitioned by artifact, which replaces per-artifact files; see `encoded` for those."""
    records.write.mode("overwrite").partitionBy("artifact").parquet(path)


def encoded(records: DataFrame) -> DataFrame:
    """(artifact, content): artifact files' contents."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        classes = [json.loads(r) for r in pdf.sort_values("cls")["record"]]
        return pd.DataFrame({"artifact": [pdf["artifact"].iloc[0]], "content": [encode(classes)]})

    return records.groupBy("artifact").applyInPandas(one, "artifact string, content binary")


def units(records: DataFrame) -> DataFrame:
    """(artifact, cls, method, block, pos, instr, ref_types, has_inv, ref_cls, ref_idx): one row per instruction."""

    def run(frames):
        for pdf in frames:
            rows = [
                (a, c, m["idx"], b, i, u[0], u[1], u[2], u[3], u[4])
                for a, c, r in zip(pdf["artifact"], pdf["cls"], pdf["record"], strict=True)
                for m in json.loads(r)["methods"] for b, block in enumerate(m["blocks"]) for i, u in enumerate(block)
            ]
            yield pd.DataFrame(rows, columns=["artifact", "cls", "method", "block", "pos", "instr", "ref_types", "has_inv", "ref_cls", "ref_idx"]).astype({"ref_idx": "Int32"})

    return records.mapInPandas(run, "artifact string, cls string, method int, block int, pos int, instr string, ref_types array<string>, has_inv boolean, ref_cls string, ref_idx int")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(library, digest, versions, representative, name) of all index.json files under path: versions in lexicographic order, the first stands for the digest."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "index.json").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    library = F.regexp_extract("file", r"([^/]+)/index\.json$", 1)
    rows = files.select(library.alias("library"), F.explode(F.from_json("value", "map<string,array<string>>")).alias("digest", "versions"))
    rows = rows.withColumn("versions", F.array_sort("versions"))
    return rows.select("library", "digest", "versions", F.element_at("versions", 1).alias("representative"), F.concat("library", F.lit(" "), F.array_join("versions", ", ")).alias("name"))
