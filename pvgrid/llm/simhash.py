"""SimHash near duplicates by covering locality-sensitive hashing.

A text is lower-cased in A-Z and split at ASCII white space; its shingles are ``shingle`` consecutive words
joined by one space, repeats included (a shorter text is one shingle, a text without words has fingerprint
zero). A fingerprint bit is one if it is set in more than half of the shingles' XXH64 values (seed 42).

Two fingerprints link if they differ in at most ``radius`` bits. Candidates come from a covering family of
masks: every bit position gets a nonzero vector of ``radius + 1`` bits, and the mask of a nonzero vector v
holds the positions whose vector has an odd inner product with v. Up to ``radius`` positions never span the
whole space, so some v is orthogonal to all of them: every pair within the radius agrees on that mask and
meets in that table. Nothing is missed, and every pair found is compared in full.

Size: only distinct fingerprints are searched, so a group of exact copies is one row. Buckets of more than
``bucket`` fingerprints are never paired up; their members agree on the mask, so they are dealt again by a
covering family over the remaining positions, which halves those positions each time until buckets are
small (a bucket that agrees on all but k positions has at most 2^k members). Small buckets report a star
per connected part, not their pairs. Components are found by joins on the star edges, cut by written tables.

Defined cases: null and empty texts have fingerprint zero and are linked like others; rows with equal
document ids are reported each, and a component is named by its smallest non-null id (null if it has none);
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvgrid.llm.common import map_batches, stage

SHINGLE = 3
RADIUS = 3
BUCKET = 256
BITS = 64

_LANE = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of the text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1:], strict=False)),
                       np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255 * 4096):
        part = hashes[start:start + 255 * 4096]
        edges = np.arange(0, len(part), 255)  # byte lanes hold up to 255 without a carry
        for bit in range(8):
            lanes = np.add.reduceat((part >> np.uint64(bit)) & _LANE, edges)
            ones[bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > len(hashes)).tolist())

_ROW = "_pvgrid_row"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row; fp is the unsigned fingerprint stored as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema[0], T.StructField("fp", T.LongType())])

    def make():
        def work(batch):
            found = (majority(shingle_hashes(t.as_py(), shingle)) for t in batch[1])
            return [batch[0], np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)]
        return work

    return map_batches(rows, schema, make)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them are untouched by some mask.

    The unit vectors are dealt first, so with more than ``radius`` positions no mask is empty.
    """
    size = 1 << (radius + 1)
    vectors = sorted(range(1, size), key=lambda v: v.bit_count())
    vector = {p: vectors[k % len(vectors)] for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _parts(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Star edges (member, smallest member) of the linked parts of a small bucket."""
    x = np.sort(np.array(fps, np.int64))
    near = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None, :]) <= radius
    part = np.arange(len(x))
    while True:
        low = np.where(near, part[None, :], len(x)).min(1)
        low = low[low]
        if (low == part).all():
            break
        part = low
    y = x.tolist()
    return [(y[i], y[p]) for i, p in enumerate(part.tolist()) if p != i]


def _finer(mask: int, radius: int) -> list[int]:
    """Masks of the next level for members that agree on ``mask`` already."""
    open_positions = [p for p in range(BITS) if not mask >> p & 1]
    return [_signed(mask | m) for m in covering_masks(open_positions, radius)]


def star_edges(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) among distinct fingerprints that connect just what links within the radius connect."""
    spark = fps.sparkSession
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def make():
        def work(batch):
            edges = [e for fps in batch[0].to_pylist() for e in _parts(fps, radius)]
            return [list(c) for c in zip(*edges, strict=True)] if edges else [[], []]
        return work

    # The masks at hand are counted by the family, not by the data: 15, then at most 225, 3375 ...
    level, masks, found = None, [0], None
    while masks:
        if level is None:
            dealt = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in _finer(0, radius)])).alias("mask"))
        else:
            finer = F.broadcast(spark.createDataFrame([(_signed(m), _finer(m, radius)) for m in masks],
                                                      "mask long, finer array<long>"))
            # two coarse masks may lead to one finer mask
            dealt = level.join(finer, "mask").select("fp", F.explode("finer").alias("mask")).distinct()
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        shared = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        members = stage(dealt.join(shared, ["mask", "key"]), "buckets")
        # members of a bucket differ in open positions only; radius of them or fewer: all are linked
        whole = F.bit_count("mask") >= BITS - radius
        small = (members.where(~whole & (F.col("n") <= bucket)).groupBy("mask", "key")
                 .agg(F.collect_list("fp").alias("fps")).select("fps"))
        least = members.where(whole).groupBy("mask", "key").agg(F.min("fp").alias("b"))
        edges = map_batches(small, schema, make).unionByName(
            members.where(whole).join(least, ["mask", "key"]).where("fp <> b").selectExpr("fp AS a", "b"))
        found = edges if found is None else found.unionByName(edges)
        level = members.where(~whole & (F.col("n") > bucket)).select("fp", "mask")
        masks = [r.mask & ((1 << BITS) - 1) for r in level.select("mask").distinct().collect()]
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph by alternating star contraction; root is the smallest node.

    A round hangs every node's larger neighbours, then its smaller ones, under the least of them; it needs
    two aggregations and joins on the node, and the number of rounds grows with the logarithm of the longest
    path. Each round is written to the shared folder, so a lost executor repeats one round at most.
    """
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                "links")
    before = None
    while (seen := state(now)) != before:
        before = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        large = stage(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = stage(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: fingerprint (16 hex digits), component_id, and the copies of its fingerprint."""
    of_docs = stage(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "_id"), "fingerprints")
    # one row per distinct fingerprint from here on, whatever the number of copies
    groups = stage(of_docs.groupBy("fp").agg(F.min("_id").alias("_least"), F.count("*").alias("copies")), "groups")
    roots = components(star_edges(groups.select("fp"), radius, bucket))
    linked = groups.join(roots, groups.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    linked = stage(linked.select("fp", "root", "_least", "copies"), "linked")
    named = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = linked.join(named, "root").select("fp", "component_id", "copies")
    return (of_docs.join(named, "fp")
            .select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id", "copies"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The first row of each component, by id, then row number; all columns unchanged.

    Rows are told apart by a row number, written with them, so ids may repeat or be null (those come last). Only
    the rows to drop are joined to the texts.
    """
    numbered = stage(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(_ROW).alias("row"))
    found = near_duplicates(numbered.select(place.alias("place"), F.col(text_col).alias("_text")), "place", "_text", **params)
    drop = found.where("place.row <> component_id.row").select(F.col("place.row").alias(_ROW))
    return numbered.join(drop, _ROW, "left_anti").select(*docs.columns)
