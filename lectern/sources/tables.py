"""Tables and files as DataFrames with explicit schemas."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ITEMS = "doc_id bigint, page int, unit int, prov int, label string, l double, t double, r double, b double, text string"
ANNOTATIONS = (
    "array<struct<id:string,color:string,note:string,created:double,updated:double,"
    "anchors:array<struct<side:string,row:int,start:int,end:int,quote:string,prefix:string,suffix:string>>>>"
)
STATUS = "stage string, input_hash string, done boolean"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation given as SQL over the tables of a folder; only those it names after `from` or `join` are read.

    Each folder's tables have views of their own, so relations over several
    folders live side by side in a session.
    """
    key = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for name in TABLES:
        place = rf"(?i)\b(from|join)(\s+){name}\b"
        if re.search(place, sql):
            view = f"{name}_{key}"
            load(spark, sf_dir, name).createOrReplaceTempView(view)
            sql = re.sub(place, rf"\1\2{view}", sql)
    return spark.sql(sql)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """One row a file below path: path and whole text."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


def json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a column of JSON; text that does not parse becomes null and goes to `_corrupt`."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return df.withColumn("_parsed", parsed).withColumn("_corrupt", F.when(F.col("_parsed").isNull(), F.col(column))).withColumn(column, F.col("_parsed")).drop("_parsed")


def library_scan(docs: DataFrame, limit: int, include_hidden: bool = False) -> DataFrame:
    """The newest `limit` documents, with pinned ones beyond it: docs need mtime, hidden, pinned_at and root."""
    from pyspark.sql import Window

    shown = docs if include_hidden else docs.where(~F.coalesce("hidden", F.lit(False)))
    newest = shown.orderBy(F.desc("mtime"), "root").limit(limit).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mtime"), "root")))
    pinned = shown.where("pinned_at is not null").join(newest.select("root"), "root", "left_anti").withColumn("rank", F.lit(None).cast("int"))
    return newest.unionByName(pinned)


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
_FIELD = re.compile(r"([A-Za-z][\w-]*)\s*=\s*")


def parse_bibtex(text: str | None) -> list[dict]:
    """Entries of a reference file: kind, key and fields; parts that do not parse are skipped."""
    out, text = [], text or ""
    for m in _ENTRY.finditer(text):
        at, fields = m.end(), {}
        while f := _FIELD.match(text, _skip(text, at)):
            value, at = _value(text, f.end())
            if value is None:
                break
            fields[f.group(1).lower()] = " ".join(value.split())
        if fields:
            out.append({"kind": m.group(1).lower(), "key": m.group(2), "fields": fields})
    return out


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in ", \t\r\n":
        at += 1
    return at


def _value(text: str, at: int) -> tuple[str | None, int]:
    """A braced, quoted or bare value and where it ends; None if it never ends."""
    if at < len(text) and text[at] == "{":
        depth = 0
        for i in range(at, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[at + 1 : i], i + 1
        return None, len(text)
    if at < len(text) and text[at] == '"':
        end = text.find('"', at + 1)
        return (None, len(text)) if end < 0 else (text[at + 1 : end], end + 1)
    m = re.compile(r"[^,}\s]+").match(text, at)
    return (m.group(0), m.end()) if m else (None, at)


def bibtex(files: DataFrame) -> DataFrame:
    """Reference files (path, text) as rows: path, pos, kind, key, fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, e["kind"], e["key"], e["fields"]) for p, t in zip(b.path, b.text, strict=True) for i, e in enumerate(parse_bibtex(t))]
            yield pd.DataFrame(rows, columns=["path", "pos", "kind", "key", "fields"])

    return files.select("path", "text").mapInPandas(run, "path string, pos int, kind string, key string, fields map<string,string>")
