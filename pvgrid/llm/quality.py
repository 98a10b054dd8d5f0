"""Quality by co-training of two views.

One view is the text's content: which words stand in it, and its shape (what kinds of characters, words and lines it is
made of, in steps). The other is the page's metadata: language, source, both together, stated length. Either view
is a set of tokens, and its model weighs a token by how much oftener good documents have it than bad ones, so a model is
two counts a token and fitting one is a sum over documents. A view's evidence, the mean weight of the words and that of
the shape, or the mean weight of the metadata, is calibrated on labelled rows that were not counted.

In every round both models score every unlabelled document. Those one view is sure of count, with its label, towards
the other view's model of the next round. The views' calibrated log odds are then combined on the rows kept for
calibration: of views independent given the class, the evidence adds up, weighted by how well each predicts there.

Size: tokens are taken once, in one scan over whole texts, and written to the shared folder, about two bytes a
different word. A round is one pass over them; tasks sum the counts, Spark adds them up, and a model of fixed size goes to
the driver and back. Words are hashed to 2 ** ``WORD_BITS`` tokens, metadata values to at least ``ROOM`` times
as many as there are. All labelled rows are counted; only calibration takes a documented sample, at most about ``max_docs``
rows, chosen by a hash of the id.

Defined cases: a null or empty text has no words and a shape of its own; null metadata is a value of its own; documents
without a label are scored too; without labelled rows of both classes among the documents every score is the share of good ones
(0.5 without any); repeated label rows of a document count once, as good only if all say so; rows that
repeat an id are scored each; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvgrid.llm.common import hold_out, map_arrow, map_batches, stage
from pvgrid.llm.toxicity import logistic

ROUNDS = 4
MAX_DOCS = 4000
CONFIDENT = 0.95
WORD_BITS, WORD_TYPE = 16, "<u2"
META_BITS = (10, 20)
ROOM = 8
STEPS = 16
SMOOTHING = 4.0
SEED = 29
POOL, FIT, CHECK, OUT = range(4)

#: Kinds of bytes: small letters, capitals, digits, spaces, line ends, sentence marks, bars, other marks, brackets
#: and quotes, control characters, everything beyond ASCII.
_KINDS = np.full(256, 7, np.int64)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n",
                                b".,;:", b"|")):
    _KINDS[list(_bytes)] = _kind
_KINDS[list(b"()[]{}<>\"'`")] = 8
_KINDS[[*range(10), *range(11, 32), 127]] = 9
_KINDS[128:] = 10
N_KINDS = 11


def text_features(text: str | None) -> list[float]:
    """Of the content: shares of the kinds of bytes, and of words and lines."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * (N_KINDS + 7)
    shares = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=N_KINDS) / len(raw)
    words = raw.split()
    lines = raw.split(b"\n")
    n = len(words) or 1
    return [*np.sqrt(shares).tolist(), math.log1p(n) / 8, min(len(raw) / n, 40.0) / 10, len(set(words)) / n,
            sum(map(bytes.isupper, words)) / n, sum(map(bytes.isalpha, words)) / n, len(set(lines)) / len(lines),
            math.log1p(n / len(lines)) / 4]



def words_of(text: str | None) -> np.ndarray:
    """The different words of a text, hashed; ASCII capitals as small letters."""
    words = set((text or "").encode().lower().split())
    return np.unique(np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) >> (32 - WORD_BITS)).astype(WORD_TYPE)


def shape_of(text: str | None) -> np.ndarray:
    """The steps the features of a text's shape fall on, one for each."""
    x = np.array(text_features(text))
    steps = np.clip((x * STEPS).astype(np.int64), 0, STEPS - 1)
    return (np.arange(len(x)) * STEPS + steps).astype("<u2")


N_SHAPES = N_KINDS + 7


def meta_of(lang: str | None, source: str | None, n_chars: int | None, bits: int) -> np.ndarray:
    """Language, source, both, and the stated length, hashed."""
    size = None if n_chars is None else int(2 * math.log2(max(n_chars, 0) + 1))
    values = (f"l{lang!r}", f"s{source!r}", f"b{lang!r}{source!r}", f"n{size}")
    return np.array([zlib.crc32(v.encode()) >> (32 - bits) for v in values], "<u4")


def tokens(docs: DataFrame, bits: int, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str) -> DataFrame:
    """(id, words, shape, meta) per document: tokens of 16 bits, of metadata 32."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"), F.col(lang_col).cast("string"),
                       F.col(source_col).cast("string"), F.col(size_col).cast("long"))
    schema = T.StructType([rows.schema[0], *(T.StructField(c, T.BinaryType()) for c in ("words", "shape", "meta"))])

    def make():
        def work(batch):
            texts = batch[1].to_pylist()
            meta = zip(*(batch[k].to_pylist() for k in (2, 3, 4)), strict=True)
            return [batch[0], [words_of(t).tobytes() for t in texts], [shape_of(t).tobytes() for t in texts],
                    [meta_of(*m, bits).tobytes() for m in meta]]
        return work

    return map_batches(rows, schema, make)


def _meta_bits(docs: DataFrame, lang_col: str, source_col: str) -> int:
    """Bits for metadata tokens, from the number of different values."""
    n = docs.agg(F.approx_count_distinct(F.struct(F.col(lang_col).cast("string"), F.col(source_col).cast("string")))).first()[0]
    return min(max(META_BITS[0], math.ceil(math.log2(ROOM * max(n, 1)))), META_BITS[1])


def _known(labels: DataFrame) -> DataFrame:
    return (labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("good"))
            .where("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.min("good").alias("good")))


class View:
    """A view's weights per token, in parts whose mean weights are its evidence, and its calibration."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.parts, self.calibration = parts, np.zeros(len(parts) + 1)

    def evidence(self, tokens: list[np.ndarray]) -> list[float]:
        return [float(w[t].mean()) if len(t) else 0.0 for w, t in zip(self.parts, tokens, strict=True)]

    def calibrate(self, rows: list[list[np.ndarray]], good: np.ndarray) -> None:
        self.calibration = logistic(self._design(rows), good, np.full(len(good), 1.0 / len(good)), ridge=1e-3)

    def _design(self, rows: list[list[np.ndarray]]) -> np.ndarray:
        return np.array([[1.0, *self.evidence(r)] for r in rows]).reshape(len(rows), -1)

    def odds(self, rows: list[list[np.ndarray]]) -> np.ndarray:
        return self._design(rows) @ self.calibration


def weights(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Log ratio of the shares of good and of bad documents with a token, drawn to the share of all."""
    share = (bad + good) / max(n_bad + n_good, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log((good + SMOOTHING * share) / (n_good + SMOOTHING)) - np.log((bad + SMOOTHING * share) / (n_bad + SMOOTHING))
    return np.where(bad + good > 0, ratio, 0.0)


def _views(row: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    words = np.frombuffer(row["words"], WORD_TYPE).astype(np.int64)
    return [words, np.frombuffer(row["shape"], "<u2").astype(np.int64)], [np.frombuffer(row["meta"], "<u4").astype(np.int64)]


def _counted(rows: DataFrame, sizes: list[int], models: tuple[View, View] | None, confident: float) -> np.ndarray:
    """Documents of either class with each token, and their number: labelled rows for both views, and, under
    ``models``, unlabelled ones by the other view's label if that is sure. Shape (2 classes, all tokens and 2 totals)."""
    spark, total, at = rows.sparkSession, sum(sizes), np.cumsum([0, *sizes])
    shared = spark.sparkContext.broadcast(models)
    limit = math.log(confident / (1 - confident))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, total + 2), np.int64)

        def add(view: int, good: int, row: tuple) -> None:  # tokens of one view are different, but for metadata that clash
            for part in [at[0] + row[0][0], at[1] + row[0][1]] if view == 0 else [at[2] + np.unique(row[1][0])]:
                counts[good][part] += 1
            counts[good][total + view] += 1

        for batch in batches:
            found = batch.to_pylist()
            views = [_views(r) for r in found]
            if shared.value:
                odds = [shared.value[k].odds([v[k] for v in views]) for k in (0, 1)]
            for k, (row, view) in enumerate(zip(found, views, strict=True)):
                if row["part"] == FIT:
                    add(0, row["good"], view)
                    add(1, row["good"], view)
                elif shared.value:
                    for teacher in (0, 1):
                        if abs(odds[teacher][k]) >= limit:
                            add(1 - teacher, int(odds[teacher][k] > 0), view)
        good, token = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(good.astype(np.int32)), pa.array(token.astype(np.int32)), pa.array(counts[good, token])],
                                         ["good", "token", "n"])

    schema = T.StructType([T.StructField("good", T.IntegerType()), T.StructField("token", T.IntegerType()), T.StructField("n", T.LongType())])
    wanted = rows.where(F.col("part") == FIT) if models is None else rows.where(F.col("part").isin(FIT, POOL))
    sums = map_arrow(wanted.select("words", "shape", "meta", "good", "part"), run, schema).groupBy("good", "token").agg(F.sum("n").alias("n"))
    out = np.zeros((2, total + 2), np.int64)
    arrow = sums.toArrow()  # a row per token and class
    out[arrow["good"].to_numpy(), arrow["token"].to_numpy()] = arrow["n"].to_numpy()
    return out


def co_train(rows: DataFrame, bits: int, rounds: int = ROUNDS, max_docs: int = MAX_DOCS, confident: float = CONFIDENT):
    """(content view, metadata view, combination) from (words, shape, meta, good, part); or the share of good rows."""
    seen = {r["good"]: r["count"] for r in rows.where(F.col("part").isin(FIT, CHECK)).groupBy("good").count().collect()}
    n = sum(seen.values())
    if not (seen.get(0) and seen.get(1)):
        return None, None, seen.get(1, 0) / n if n else 0.5
    chance = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(1 << 20)) / float(1 << 20)

    def sample(part: int) -> list[dict]:
        return (rows.where(F.col("part") == part).where(chance < max_docs / max(n, 1)).orderBy("id", "words")
                .select("words", "shape", "meta", "good").toArrow().to_pylist())

    check = sample(CHECK)
    if len({r["good"] for r in check}) < 2:  # too few labels to keep any for calibration
        check = check + sample(FIT)
    views = [_views(r) for r in check]
    good = np.array([r["good"] for r in check], float)
    if len(set(good.tolist())) < 2:
        return None, None, seen.get(1, 0) / n
    sizes = [1 << WORD_BITS, N_SHAPES * STEPS, 1 << bits]
    at = np.cumsum([0, *sizes])
    models = None
    for _ in range(rounds + 1):
        (bad, fine) = _counted(rows, sizes, models, confident)
        parts = [weights(bad[at[k]:at[k + 1]], fine[at[k]:at[k + 1]], bad[at[3] + (k == 2)], fine[at[3] + (k == 2)]) for k in range(3)]
        models = View(parts[:2]), View(parts[2:])
        for k in (0, 1):
            models[k].calibrate([v[k] for v in views], good)
    odds = np.column_stack([np.ones(len(good)), *(models[k].odds([v[k] for v in views]) for k in (0, 1))])
    return *models, logistic(odds, good, np.full(len(good), 1.0 / len(good)), ridge=1e-3)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", **params) -> DataFrame:
    """One row per document: held_out, score (0 to 1, higher: good likelier), and each view's own log odds."""
    bits = _meta_bits(docs, lang_col, source_col)
    found = tokens(docs, bits, id_col, text_col, lang_col, source_col, size_col)
    known = stage(_known(labels).withColumnRenamed("id", "_known"), "labels")  # so that Spark can split a frequent id, as null is
    held_out = hold_out(F.col("id"), 3, 1)
    kept = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(4)) == 0
    part = F.when(F.col("good").isNull(), POOL).when(held_out, OUT).when(kept, CHECK).otherwise(FIT)
    rows = stage(found.join(known, found["id"] == known["_known"], "left").drop("_known").withColumn("part", part), "quality")
    content, meta, combination = co_train(rows, bits, **params)
    shared = docs.sparkSession.sparkContext.broadcast((content, meta, combination))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.DoubleType()) for c in ("score", "content_odds", "meta_odds"))])

    def make():
        def work(batch):
            first, second, last = shared.value
            if first is None:
                return [batch[0], batch[1], *([x] * batch.num_rows for x in (last, 0.0, 0.0))]
            views = [_views(r) for r in batch.select(["words", "shape", "meta"]).to_pylist()]
            a, b = first.odds([v[0] for v in views]), second.odds([v[1] for v in views])
            return [batch[0], batch[1], 1 / (1 + np.exp(-np.clip(last[0] + last[1] * a + last[2] * b, -500, 500))), a, b]
        return work

    scored = map_batches(rows.select("id", held_out.alias("held_out"), "words", "shape", "meta"), schema, make)
    return scored.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "content_odds", "meta_odds")
