"""Substring deduplication with a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, freeing, materialize, shared_dir, with_maybe
from .windows import Chunk, WordHashes

WINDOW = 20
#: Words of an anchor: more make the index larger and accidental matches rarer.
GRAM = 8
#: Words that a task hashes at once.
CHUNK = 200_000
#: Runs of the index beyond which they are compacted into one.
MOST_RUNS = 4
RUN = "ah bigint, rh bigint, doc_id bigint, lo int, n int"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in groups of about CHUNK words, each group sorted by id: (id, words, *other columns)."""
    rows, size = [], 0
    for b in batches:
        for i, text, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows.append((i, (text or b"").split(), *rest))
            size += len(rows[-1][1])
            if size >= CHUNK:
                yield sorted(rows, key=lambda r: r[0])
                rows, size = [], 0
    if rows:
        yield sorted(rows, key=lambda r: r[0])


def _hashed(rows: list[tuple], known: WordHashes) -> Chunk:
    return Chunk([np.array([known[w] for w in r[1]], dtype=np.uint64) for r in rows])


def window_runs(docs: DataFrame) -> DataFrame:
    """Runs of windows in every text: ah, rh, doc_id, lo, n and `again`.

    `again` says that the same run starts earlier among the rows that the task
    hashed with this one.  Such rows need no look at the index, which bounds
    what a passage in a third of all documents sends to one partition; those
    that follow each other become one, under its place in lieu of hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for rows in _chunks(batches):
            ah, rh, text, lo, n = _hashed(rows, known).runs(WINDOW, GRAM)
            ids = np.array([r[0] for r in rows], dtype=np.int64)[text] if len(text) else text
            order = np.lexsort((lo, ids, rh, ah))
            a, r, i, s = ah[order], rh[order], ids[order], lo[order]
            head = np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])])[: len(a)]
            first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0)) if len(a) else order
            again = (i != i[first]) | (s != s[first])
            fresh = [x[~again] for x in (a, r, i, s, n[order])]
            i, s, m = _merged(i[again], s[again], n[order][again])
            rows_ = [np.concatenate(x) for x in zip(fresh, (i, s, i, s, m), strict=True)]
            flag = np.arange(len(rows_[0])) >= len(fresh[0])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip((*rows_, flag), types, strict=True)], names)

    names = ["ah", "rh", "doc_id", "lo", "n", "again"]
    return docs.mapInArrow(run, RUN + ", again boolean")


def _merged(ids: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join runs of one text where one starts as the other ends."""
    order = np.lexsort((low, ids))
    ids, low, n = ids[order], low[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (low[1:] > (low + n)[:-1])])[: len(ids)])
    return ids[new], low[new], np.maximum.reduceat(low + n, new) - low[new] if len(new) else n


def maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id may be among ids, see with_maybe."""
    return with_maybe(docs, ids).where("_maybe").drop("_maybe")


class FingerprintIndex:
    """Sorted immutable runs of the window fingerprints seen so far.

    A run holds, for one batch of documents, each distinct run of windows
    (anchor hash and run hash, 128 bits) with its first place.  It is a table
    in the shared folder, bucketed and sorted by these hashes, so that joins
    with other runs merge without a shuffle.  Batches must come in ascending
    order of doc_id.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.runs, self.drops = spark, [], []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _sorted(self, df: DataFrame, name: str) -> tuple[DataFrame, Callable]:
        """Write df as a table with one sorted file a bucket: the table, and what deletes it."""
        name = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df = df.repartition(self.buckets, "ah", "rh").sortWithinPartitions("ah", "rh")
        with freeing(self.spark):
            df.write.bucketBy(self.buckets, "ah", "rh").sortBy("ah", "rh").option("path", path).saveAsTable(name)
        return self.spark.table(name), lambda: (self.spark.sql(f"drop table {name}"), discard(self.spark, path))

    def _all(self) -> DataFrame | None:
        out = None
        for r in self.runs:
            out = r if out is None else out.unionByName(r)
        return out

    def add(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """Add a batch and find its repeated windows: doc_id, lo, n (windows lo to lo + n - 1 start earlier elsewhere).

        docs: doc_id and text (binary) of the batch, ids not null; history:
        those of all earlier batches, for verification.
        """
        found, forget = self._sorted(window_runs(docs), "window_runs")
        fresh = found.where("not again").groupBy("ah", "rh").agg(F.min(F.struct("doc_id", "lo", "n")).alias("f"))
        fresh = fresh.select("ah", "rh", "f.*")
        run, drop = self._sorted(fresh, "fingerprint_run")

        known = run
        for k, old in enumerate(self.runs):
            known = known.join(old.select("ah", "rh", F.lit(True).alias(f"in{k}")), ["ah", "rh"], "left")
        seen = F.lit(False)
        for k in range(len(self.runs)):
            seen = seen | F.col(f"in{k}").isNotNull()
        known = known.select("ah", "rh", "doc_id", "lo", "n", seen.alias("seen"))  # merged again where it is read

        # An anchor with several run hashes, one of them new, may share some of its windows.
        every = known.where("not seen").select("ah", F.lit(1).alias("new"))
        if self.runs:
            every = every.unionByName(self._all().select("ah", F.lit(0).alias("new")))
        shared = every.groupBy("ah").agg(F.count(F.lit(1)).alias("c"), F.max("new").alias("new")).where("c > 1 and new = 1").select("ah")
        shared = materialize(shared, "shared-anchors")
        edges = known.where("not seen").join(shared, "ah", "left_semi").select("doc_id", "lo", "n")
        if self.runs:
            edges = edges.unionByName(self._all().join(shared, "ah", "left_semi").select("doc_id", "lo", "n"))
        edges = materialize(edges, "edge-runs")

        first = known.select("ah", "rh", F.col("doc_id").alias("d"), F.col("lo").alias("l"), "seen")
        later = found.where("not again").join(first, ["ah", "rh"]).where("seen or doc_id <> d or lo <> l")
        repeats = later.select("doc_id", "lo", "n").unionByName(found.where("again").select("doc_id", "lo", "n"))
        repeats = materialize(repeats.unionByName(self._edges(docs, history, edges)), "repeats")
        forget()
        self.runs.append(run)
        self.drops.append(drop)
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return repeats

    def _edges(self, docs: DataFrame, history: DataFrame | None, edges: DataFrame) -> DataFrame:
        """Compare the single windows of edge runs; those of the batch that are not the first of their words.

        Only texts that have such runs shuffle, of the batch and of history alike.
        """
        texts = maybe_in(docs, edges).withColumn("new", F.lit(True))
        if history is not None:
            texts = texts.unionByName(maybe_in(history, edges).withColumn("new", F.lit(False)))
        by = edges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("runs")).hint("shuffle_hash")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for rows in _chunks(batches):
                text = np.array([k for k, r in enumerate(rows) for x in r[2] for _ in range(x["n"])], dtype=np.int64)
                low = np.array([x["lo"] + j for r in rows for x in r[2] for j in range(x["n"])], dtype=np.int64)
                one, two = _hashed(rows, known).windows(text, low, WINDOW)
                ids, new = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, ids[text], low.astype(np.int32), new[text])], ["w1", "w2", "doc_id", "lo", "new"])

        windows = texts.join(by, "doc_id").select("doc_id", "text", "runs", "new")
        windows = materialize(windows.mapInArrow(run, "w1 bigint, w2 bigint, doc_id bigint, lo int, new boolean"), "edge-windows")
        first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "lo")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
        later = windows.where("new").join(first, ["w1", "w2"]).where("doc_id <> f.doc_id or lo <> f.lo")
        return later.select("doc_id", "lo", F.lit(1).alias("n"))

    def close(self) -> None:
        """Drop all runs; results found so far do not read them."""
        for drop in self.drops:
            drop()
        self.runs, self.drops = [], []

    def compact(self) -> None:
        """Merge all runs into one; a fingerprint keeps its first place."""
        merged = self._all().groupBy("ah", "rh").agg(F.min(F.struct("doc_id", "lo", "n")).alias("f")).select("ah", "rh", "f.*")
        merged, drop = self._sorted(merged, "fingerprint_run")
        for old in self.drops:
            old()
        self.runs, self.drops = [merged], [drop]


def keep_first(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Remove the words that repeated windows cover: doc_id, n_words, n_removed, kept (binary), kept_sha256."""
    by = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n")).alias("runs")).hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (text or b"").split()
                size = len(words)
                if runs:
                    keep = bytearray(b"\x01") * size
                    for r in runs:
                        end = min(r["lo"] + r["n"] + WINDOW - 1, size)
                        keep[r["lo"] : end] = bytes(max(end - r["lo"], 0))
                    words = list(compress(words, keep))
                kept = b" ".join(words)
                out.append((i, size, size - len(words), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names) if out else _none(names, types)

    names = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    rows = docs.where("doc_id is not null").join(by, "doc_id", "left").select("doc_id", "text", "runs")
    rows = rows.unionByName(docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<lo:int,n:int>>").alias("runs")))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept binary, kept_sha256 string")


def _none(names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)


def _cuts(ids: DataFrame, batches: int) -> list[int]:
    """Ids that divide the documents into batches of about equal size."""
    if batches < 2:
        return []
    at = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], F.lit(10_000)).alias("q")).first()["q"]
    return sorted(set(at or []))


def substring_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """Remove every word in a window of WINDOW words whose words also start earlier.

    Earlier is a smaller doc_id, or an earlier start in the same document.
    Windows are judged on the input.  Returns doc_id, n_words, n_removed, kept
    (binary) and kept_sha256 for every row.  Documents go through the index in
    `batches` batches by doc_id.  Null and empty texts have no words, texts of
    any length are read whole; rows without an id are kept whole; rows that
    repeat an id count as one document and are never removed for each other's
    sake; without rows the result is empty; further columns are not read.

    Instead of all windows the index holds one entry for each run of windows
    with the same anchor (their least gram hash), about a sixth as many.  Runs
    count as equal if 64 bits of their anchor's words and 64 bits of all their
    words are; where one anchor has differing runs, single windows decide, by
    two hashes of 64 bits each.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    valid = rows.where("doc_id is not null")
    index = FingerprintIndex(docs.sparkSession)
    cuts = _cuts(valid, batches)
    repeats = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = valid if high is None else valid.where(F.col("doc_id") <= high)
        part = part if low is None else part.where(F.col("doc_id") > low)
        more = index.add(part, None if low is None else valid.where(F.col("doc_id") <= low))
        repeats = more if repeats is None else repeats.unionByName(more)
    index.close()
    return keep_first(rows, repeats)
