"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components
from .windows import BASES, mix

#: Shingles whose bits are counted at once, which bounds memory for long texts.
CHUNK = 1 << 14
BITS = 64


def shingle_hashes(text: bytes, width: int, seed: int, once: bool = False) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a UTF-8 text with A-Z lower-cased, in chunks; `once`: each distinct one once."""
    found = text.lower().split()  # bytes.lower and bytes.split know ASCII only, as the definition of words does
    if not found:
        return
    width = min(width, len(found))
    line = b" ".join(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(found) - width + 1].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    parts = (
        np.array([digest(line[a:b], seed) for a, b in zip(start[at : at + CHUNK], end[at : at + CHUNK], strict=True)], dtype="<u8")
        for at in range(0, len(start), CHUNK)
    )
    if not once:
        yield from parts
        return
    distinct = np.unique(np.concatenate(list(parts)))
    for at in range(0, len(distinct), CHUNK):
        yield distinct[at : at + CHUNK]


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42, once: bool = False, words: int = 1) -> list[int]:
    """SimHash of a text as signed 64-bit numbers: a bit is one if over half of the shingle hashes have it; no words: zero.

    Further numbers than the first come from hashes of the hashes.
    """
    ones, n = np.zeros((words, BITS), dtype=np.int64), 0
    for h in shingle_hashes(text or b"", width, seed, once):
        for k in range(words):
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            h = mix(h + np.uint64(BASES[0])) if k + 1 < words else h  # noqa: PLW2901
        n += len(h)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist() if n else [0] * words


def with_fingerprints(docs: DataFrame, doc_id: str, text: str, kinds: dict[str, dict], seed: int = 42) -> DataFrame:
    """doc_id and the fingerprints named by `kinds`, whose values are arguments of `fingerprint`; several words make columns name0, name1, ..."""
    names = [n for k, v in kinds.items() for n in ([k] if v.get("words", 1) == 1 else [f"{k}{i}" for i in range(v["words"])])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[x for v in kinds.values() for x in fingerprint(t, seed=seed, **v)] for t in b.column(1).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))


#: What comparing one candidate costs, in keys asked for.
CANDIDATE = 0.1
#: Cells with more rows than CROWD and at most FEW groups are met group by group.
CROWD, FEW = 64, 8


def plan_segments(n: int, radius: int) -> list[tuple[int, int, int]]:
    """Segments (first bit, width, ball radius) for n fingerprints.

    Two fingerprints within `radius` bits agree, in at least one of m
    segments, within r = radius // m bits, and the first radius - m * r + 1
    segments suffice for that ball; the others need r - 1 (none if r is 0).
    m is the number of segments with the least cost, in keys that a
    fingerprint asks for and candidates that these find by chance.
    """

    def plan(m: int) -> list[tuple[int, int, int]]:
        r, extra = divmod(radius, m)
        cuts = [round(BITS * i / m) for i in range(m + 1)]
        return [(a, b - a, r if i <= extra else r - 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i <= extra or r]

    def cost(segments: list[tuple[int, int, int]]) -> float:
        return sum(sum(comb(w, k) for k in range(r + 1)) * (1 + CANDIDATE * n / 2**w) for _, w, r in segments)

    return min((plan(m) for m in range(2, max(radius + 1, 2) + 1)), key=cost)


def crowds(cells: DataFrame, key: str) -> DataFrame:
    """Every cell's a and b (least and greatest group) and whether it is a crowd; cells: key and group.

    A cell is a crowd if it has over CROWD rows of at most FEW groups: then
    rows look for other groups first, FEW at most, and for their rows after,
    so that rows of one group, which need not meet, are never paired.  Rows
    pre-aggregate.
    """
    sizes = cells.groupBy(key, "group").agg(F.count(F.lit(1)).alias("n"))
    by = sizes.groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.min("group").alias("a"), F.max("group").alias("b"))
    return by.select(key, "a", "b", ((F.col("n") > CROWD) & (F.col("groups") <= FEW)).alias("crowd"))


def meet(asked: DataFrame, cells: DataFrame, key: str, on: Column) -> DataFrame:
    """Pairs (u, v) of nodes of different groups with one key, under the condition `on` of the sides p and t.

    asked and cells: key, node, group and what `on` needs.
    """
    by = crowds(cells, key)
    live = asked.join(by, key).where("a <> group or b <> group").drop("a", "b")
    apart = (F.col(f"p.{key}") == F.col(f"t.{key}")) & (F.col("p.group") != F.col("t.group")) & on
    pair = (F.col("p.node").alias("u"), F.col("t.node").alias("v"))
    few = live.where("not crowd").alias("p").join(cells.alias("t"), apart).select(*pair)
    others = cells.select(key, F.col("group").alias("other")).join(by.where("crowd").select(key), key, "left_semi").distinct()
    to = live.where("crowd").join(others, key).where("group <> other").alias("p")
    many = to.join(cells.alias("t"), apart & (F.col("p.other") == F.col("t.group"))).select(*pair)
    return few.unionByName(many)


def links(prints: DataFrame, radius: int) -> DataFrame:
    """All pairs of nodes of different groups whose fingerprints are within `radius` bits, each once: u < v.

    prints: `node` (bigint, distinct), `fp` and `group`: nodes of one group are
    linked already and make no pairs.  Every fingerprint goes into a table
    under each segment's value; each one asks for all values in the Hamming
    ball about its own, and matches are verified on the whole fingerprint.  A
    pair is reported by the first segment that finds it.
    """
    plan = plan_segments(prints.count(), radius)
    part = lambda c, a, w: F.shiftright(c, a).bitwiseAND(F.lit((1 << w) - 1))
    key = lambda i, a, w: part(F.col("fp"), a, w).bitwiseOR(F.lit(i << 48))
    flips = [[sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(w), k)] for _, w, r in plan]
    balls = F.concat(*[_ball(key(i, a, w), flips[i]) for i, (a, w, _) in enumerate(plan)])
    cells = F.array(*[key(i, a, w) for i, (a, w, _) in enumerate(plan)])
    side = lambda keys: prints.select(F.explode(keys).alias("key"), "node", "fp", "group")
    apart = F.col("p.fp").bitwiseXOR(F.col("t.fp"))
    on = (F.col("p.node") < F.col("t.node")) & (F.bit_count(apart) <= radius)
    for i, (a, w, r) in enumerate(plan):
        on = on & ((F.shiftright(F.col("t.key"), 48) <= i) | (F.bit_count(part(apart, a, w)) > r))
    return meet(side(balls), side(cells), "key", on)


def star_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links that connect most of a dense group without its pairs: u (a node), v (a smaller one), within `radius` bits.

    Fingerprints are cut into six parts; nodes that agree in three of them meet
    in a cell, and each links to the smallest node of the cell if the two are
    verified.  So links grow with the nodes, not with the pairs of a group.
    """
    cuts = [round(BITS * i / 6) for i in range(7)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, 3)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = prints.select(F.explode(cells).alias("cell"), "node")
    first = rows.groupBy("cell").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cell", "v")
    pairs = rows.join(first, "cell").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    end = lambda n: prints.select(F.col("node").alias(n), "fp").alias(n)
    return pairs.join(end("u"), "u").join(end("v"), "v").where(F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp"))) <= radius).select("u", "v")


def grouped(prints: DataFrame, stars: DataFrame) -> DataFrame:
    """Add `group`, the smallest node that stars connect a node to."""
    return prints.join(components(stars), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")


def _ball(key: Column, flips: list[int]) -> Column:
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda m: key.bitwiseXOR(m))


def simhash_components(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, seed: int = 42
) -> DataFrame:
    """SimHash and near-duplicate class of every row of docs: doc_id, fp, component_id.

    Classes are the connected components of fingerprints at most `radius` bits
    apart; component_id is the smallest doc_id in the class.  Equal
    fingerprints collapse before the search, so copies make no pairs; stars
    then connect dense groups, and the search, which misses nothing, asks only
    for links between different groups.  Null and empty texts have fingerprint
    zero and link like any other; texts of any length are read whole, in
    chunks of shingles; rows that repeat are answered row by row, a null id
    among them is a node that never names a class if another does.  A bit set
    in exactly half of the hashes is zero.  Without rows the result is empty;
    further columns are not read.
    """
    prints = materialize(with_fingerprints(docs, doc_id, text, {"fp": {"width": width}}, seed), "fingerprints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    nodes = firsts.select("fp", F.col("fp").alias("node"))
    stars = materialize(star_links(nodes, radius), "simhash-stars")
    pairs = materialize(stars.unionByName(links(materialize(grouped(nodes, stars), "simhash-groups"), radius)), "simhash-links")
    roots = components(pairs).withColumnRenamed("node", "fp")
    named = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(of, "root").select("fp", "component_id")
    return prints.join(materialize(named, "simhash-classes"), "fp").select("doc_id", "fp", "component_id")


#: Words of the sketch that foretells similarity, and the bits in which two
#: texts may differ: a Jaccard similarity of 0.8 differs in 51 of 512 bits on
#: average, with a standard deviation of 7, one of 0.7 in 77.
SKETCH, SKETCH_RADIUS = 8, 72
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of minhashes that make texts candidates, and minhashes in each: two
#: texts of a Jaccard similarity s share none with probability (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 20, 5


def minhashes(distinct: np.ndarray) -> np.ndarray:
    """Minhashes of a set of hashes, one in each of SKETCH * BITS bins; zeros for an empty set.

    One permutation is dealt over all bins; a bin without a value takes that
    of a bin that a fixed sequence of draws finds first.
    """
    n = SKETCH * BITS
    if not len(distinct):
        return np.zeros(n, dtype=np.uint64)
    bins = np.arange(n, dtype=np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, (distinct % np.uint64(n)).astype(np.int64), distinct // np.uint64(n))
    filled = least != np.iinfo(np.uint64).max
    value, open_ = least.copy(), np.flatnonzero(~filled)
    for k in range(1, 200):
        if not len(open_):
            break
        drawn = (mix(bins[open_] * np.uint64(BASES[0]) + np.uint64(k)) % np.uint64(n)).astype(np.int64)
        hit = filled[drawn]
        value[open_[hit]] = least[drawn[hit]]
        open_ = open_[~hit]
    value[open_] = least[filled][0]
    return value


def minhash_bits(value: np.ndarray) -> list[int]:
    """One bit of each minhash, as SKETCH signed 64-bit numbers."""
    bins = np.arange(len(value), dtype=np.uint64)
    return np.packbits((mix(value ^ mix(bins + np.uint64(1))) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8").tolist()


def minhash_bands(value: np.ndarray) -> list[int]:
    """Hashes of the first BANDS runs of ROWS minhashes, as signed 64-bit numbers; the run's place is part of its hash."""
    parts = value[: BANDS * ROWS].reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], dtype=np.uint64).view(np.int64).tolist()


def near_prints(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, fp (hash of the set of shingles), the text's SimHash, and the sketch and bands of that set; docs: doc_id and text (binary)."""
    names = ["fp", "simhash", *[f"s{i}" for i in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for b in batches:
            rows, bands = [], []
            for t in b.column(1).to_pylist():
                shingles = np.concatenate([none, *shingle_hashes(t or b"", SHINGLE, seed, True)])
                value = minhashes(shingles)
                rows.append([xxhash.xxh64_intdigest(shingles.tobytes(), seed) - (1 << 63), *fingerprint(t, seed=seed), *minhash_bits(value)])
                bands.append(minhash_bands(value))
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", *names, "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", bands array<bigint>")


def alike(a: str, b: str) -> Column:
    """Whether the sketches of two sides are within SKETCH_RADIUS bits."""
    return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0)) <= SKETCH_RADIUS


def band_stars(prints: DataFrame) -> DataFrame:
    """Candidates that connect most of a dense group without its pairs: u (a node), v (the smallest one of a band they share).

    prints: node, group, sketch and bands; nodes of one group are linked
    already.  Candidates grow with the nodes, not with the pairs of a group.
    """
    rows = prints.select(F.explode("bands").alias("cell"), "node")
    first = rows.groupBy("cell").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cell", "v")
    pairs = rows.join(first, "cell").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    end = lambda n: prints.withColumnRenamed("node", n).drop("bands").alias(n)
    return pairs.join(end("u"), "u").join(end("v"), "v").where(alike("u", "v") & (F.col("u.group") != F.col("v.group"))).select("u", "v")


def band_links(prints: DataFrame) -> DataFrame:
    """All candidates of different groups that share a band, each once: u < v.

    prints: node, group, sketch and bands.  Bands whose nodes are all of one
    group are left out before anything else meets; a pair is reported by the
    first band that it shares.
    """
    cells = prints.select(F.posexplode("bands").alias("at", "cell"), "node", "group")
    mixed = cells.groupBy("cell").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("cell")
    live = cells.join(mixed, "cell", "left_semi").select("at", "cell", "node")
    live = materialize(live.join(prints, "node"), "near-cells")
    shared = F.zip_with(F.col("p.bands"), F.col("t.bands"), lambda x, y: x == y)
    on = (F.col("p.node") < F.col("t.node")) & alike("p", "t") & (F.array_position(shared, True) == F.col("p.at") + 1)
    return meet(live, live, "cell", on)


def similar(docs: DataFrame, pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Those pairs (u, v) of ids whose texts have a Jaccard similarity of SIMILARITY or more, by their distinct shingles.

    docs: doc_id and text (binary).  Only texts of ids in pairs are hashed.
    """
    pairs = materialize(pairs, "maybe-similar")
    ends = pairs.select(F.col("u").alias("doc_id")).distinct().unionByName(pairs.select(F.col("v").alias("doc_id")).distinct())
    ids = ends.distinct().hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [b"".join(h.tobytes() for h in shingle_hashes(t or b"", SHINGLE, seed, True)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["doc_id", "set"])

    one = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = one.mapInArrow(run, "doc_id bigint, set binary")
    sets = materialize(sets, "shingle-sets")

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")  # noqa: PLW2901
            n = len(np.intersect1d(x, y, assume_unique=True))
            out.append(n / (len(x) + len(y) - n) if len(x) + len(y) else 1.0)
        return pd.Series(out)

    side = lambda n: sets.select(F.col("doc_id").alias(n), F.col("set").alias(f"{n}_set"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(jaccard("u_set", "v_set") >= SIMILARITY).select("u", "v")


def simhash_near(rows: DataFrame, nodes: DataFrame, radius: int, seed: int) -> DataFrame:
    """Pairs (u, v) of nodes whose SimHashes are within `radius` bits, found by multi-index hashing, and whose texts are similar.

    rows: doc_id and text (binary); nodes: node and simhash.  Within the radius
    only pairs that stars have linked already are not asked for.
    """
    prints = materialize(nodes.select("node", F.col("simhash").alias("fp")), "near-simhashes")
    stars = materialize(similar(rows, star_links(prints, radius), seed), "near-simhash-stars")
    return stars.unionByName(similar(rows, links(materialize(grouped(prints, stars), "near-simhash-groups"), radius), seed))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = 4, seed: int = 42) -> DataFrame:
    """Near-duplicate class of every row of docs: doc_id and component_id, the smallest doc_id of the class.

    Texts are linked from a Jaccard similarity of 0.8 of their five-word
    shingles.  Candidates are first all texts whose SimHashes are within
    `radius` bits, by the same multi-index search as in `simhash_components`.
    A similarity of 0.8 may be further apart than any ball that can be searched, so
    of texts that this leaves in different groups those that share one of BANDS bands of ROWS minhashes are
    candidates too; 512 one-bit minhashes discard those that are hardly similar,
    and the shingles themselves verify the rest; either step misses about one
    in a thousand pairs at 0.8, fewer above and more among texts of a few
    dozen words, whose minhashes repeat.  Texts with equal sets
    of shingles are one node; stars connect dense groups before the search
    asks for links between groups.  Null and empty texts are alike, texts of
    any length are read whole; an id that repeats is one document, compared by
    the least of its texts; null ids are never linked.  A similarity of exactly
    SIMILARITY links.  Without rows the result is empty; further columns are
    not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    prints = materialize(near_prints(rows, seed), "near-prints")
    sketch = [f"s{i}" for i in range(SKETCH)]
    nodes = prints.where("doc_id is not null").groupBy("fp", *sketch).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.min("simhash").alias("simhash"))
    nodes = materialize(nodes, "near-nodes")

    once = nodes.groupBy("node").agg(F.min(F.struct("fp", *sketch, "bands", "simhash")).alias("p")).select("node", "p.*").drop("fp")
    once = materialize(once, "near-once")
    near = materialize(simhash_near(rows, once, radius, seed), "near-simhash-links")
    rest = once.drop("simhash")
    stars = materialize(near.unionByName(similar(rows, band_stars(materialize(grouped(rest, near), "near-parts")), seed)), "near-stars")
    pairs = similar(rows, band_links(materialize(grouped(rest, stars), "near-groups")), seed)
    roots = components(stars.unionByName(pairs))
    classes = nodes.join(roots, "node", "left").select("fp", *sketch, F.coalesce("root", "node").alias("component_id"))
    return prints.drop("bands", "simhash").join(materialize(classes, "near-classes"), ["fp", *sketch], "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
