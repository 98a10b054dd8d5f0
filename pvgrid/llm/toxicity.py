"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, the field tags words, so the training words are labelled first: in toxic documents, a
word that stands in far more families of toxic documents than of clean ones is an offending word. A family is
the documents with the same least hash of a word pair, which near copies mostly share: a document that was
copied a thousand times doesn't make its words look offending. The field has two tags; a word's weight for the offending tag sums the weights of the word
itself, of its left and of its right neighbour, and a bias, and there is a weight for each pair of adjacent tags.
It is fitted by gradient ascent on the penalised likelihood: each task runs forward-backward over its lines
and returns one gradient, the driver adds them up.

With two tags, forward-backward is a recursion on log odds, run over all lines of a batch at once. The words'
marginal probabilities give a document's features (the highest log odds, the expected number of offending
words and their share), and a logistic model of the document labels turns them into a score, fitted on a part
of the training rows. Words with a probability of one half or more are reported as ranges of the original.

Size: the field is learned from a bounded, documented sample: at most about ``max_docs`` labelled rows of
either class, chosen by a hash of the id and weighted back to their share. Its vocabulary, all words of the sample
that tell the classes apart at all, and so its gradients are bounded by the sample; ``FIT_TASKS`` tasks return one each
step. All documents are scored in one scan without a shuffle, over their whole texts.

Defined cases: a null or empty text has no words and gets the score of a text without offending words;
without toxic or without clean training rows among the documents every score is the share of toxic ones among
the labels to learn from (0 without any);
a null id counts as empty text when rows are held out; rows without a label are not learned from;
repeated label rows of a document count once, as toxic if any says so; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvgrid.llm.common import WORD_BYTES, char_offsets, held, hold_out, map_arrow, map_batches, stage, word_bounds

MAX_DOCS = 4000
MIN_FAMILIES = 3
LIFT = 6.0
CONFIDENT = 2.0
#: Tasks that fit the field; each returns one gradient a step.
FIT_TASKS = 8
#: Texts are scored in groups of about so many characters.
GROUP_CHARS = 500_000
STEPS = 24
PENALTY = 1e-3
THRESHOLD = 0.7
SEED = 17

#: Capitals and separators as in ``WORD_BYTES``, but the end of a line is kept.
_LINE_BYTES = bytes(0x0A if b == 0x0A else WORD_BYTES[b] for b in range(256))


@dataclass
class Field:
    """Weights: three per word (itself, as left and as right neighbour), bias, and four for adjacent tags."""

    words: dict[bytes, int]
    weights: np.ndarray
    document: np.ndarray  # of the document model: bias and one per feature
    prior: float


def read_lines(text: str | None, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a text (unknown: the number of known ones), and the number of words in each line."""
    mapped = (text or "").encode().translate(_LINE_BYTES)
    lines = [line.split() for line in mapped.split(b"\n")]
    sizes = np.array([n for line in lines if (n := len(line))], np.int64)
    words = [w for line in lines for w in line]
    return np.fromiter(map(place.get, words, repeat(len(place))), np.int64, len(words)), sizes


def _neighbours(ids: np.ndarray, sizes: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right neighbour of every word in its line, and where lines start."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    left, right = np.empty_like(ids), np.empty_like(ids)
    left[1:], right[:-1] = ids[:-1], ids[1:]
    left[first], right[first + sizes - 1] = none, none
    return left, right, first


def _potential(w: np.ndarray, ids, left, right, n: int) -> np.ndarray:
    """Log odds of the offending tag from the word and its neighbours alone. Number n is an unknown word."""
    size = n + 1
    return w[ids] + w[size + left] + w[2 * size + right] + w[3 * size]


def marginals(odds: np.ndarray, sizes: np.ndarray, first: np.ndarray, tags: np.ndarray):
    """Log odds of the offending tag given the whole line, and the forward and backward parts.

    ``tags`` has the weights of adjacent tags: 00, 01, 10, 11. Lines are walked side by side, longest first.
    """
    t00, t01, t10, t11 = tags
    forward, backward = odds.copy(), np.zeros_like(odds)
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = first[order], sizes[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, longest + 1))
    for k in range(1, longest):
        at = starts[:alive[k]] + k
        r = forward[at - 1]
        forward[at] += np.logaddexp(t01, r + t11) - np.logaddexp(t00, r + t10)
    for k in range(longest - 2, -1, -1):
        at = starts[:alive[k + 1]] + k
        s = odds[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(t10, t11 + s) - np.logaddexp(t00, t01 + s)
    return forward + backward, forward, backward


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def gradient(w: np.ndarray, n: int, ids, sizes, tags, weight) -> np.ndarray:
    """Gradient of the weighted log likelihood of tagged lines."""
    size, out = n + 1, np.zeros_like(w)
    if not len(ids):
        return out
    left, right, first = _neighbours(ids, sizes, n)
    odds = _potential(w, ids, left, right, n)
    total, forward, backward = marginals(odds, sizes, first, w[-4:])
    miss = (tags - _sigmoid(total)) * weight
    for k, at in enumerate((ids, left, right)):
        out[k * size:(k + 1) * size] = np.bincount(at, miss, size)
    out[3 * size] = miss.sum()
    inner = np.ones(len(ids), bool)
    inner[first + sizes - 1] = False
    a = np.flatnonzero(inner)
    b = a + 1
    after = odds[b] + backward[b]
    logs = np.stack([np.full(len(a), w[-4]), w[-3] + after, forward[a] + w[-2], forward[a] + w[-1] + after])
    logs -= logs.max(0, initial=-np.inf)
    share = np.exp(logs)
    share /= share.sum(0)
    pair = (2 * tags[a] + tags[b]).astype(np.int64)
    for k in range(4):
        out[len(w) - 4 + k] = (((pair == k) - share[k]) * weight[a]).sum()
    return out


def features(total: np.ndarray, n_words: int) -> list[float]:
    """Of a document: highest log odds, expected offending words (log), and their share of the words (log)."""
    if not n_words:
        return [-8.0, 0.0, 0.0]
    expected = float(_sigmoid(total).sum())
    return [max(-8.0, min(8.0, float(total.max()))), math.log1p(expected), math.log1p(100.0 * expected / n_words)]


def _sample(docs: DataFrame, labels: DataFrame, held_out: Column, max_docs: int) -> DataFrame | None:
    """(text, toxic, weight, fit): at most about ``max_docs`` rows of either class; None without both among the documents."""
    chance = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20))
    known = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
             .where(~held_out))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not (counts.get(1) and counts.get(0)):
        return None
    share = {k: min(1.0, max_docs / counts[k]) for k in (0, 1)}
    keep = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    chosen = known.where(chance < keep * (1 << 20)).withColumn("weight", 1.0 / keep)
    # bounded by max_docs per class, so the texts stay where they are
    rows = docs.select(F.col("id"), F.col("_text")).join(F.broadcast(chosen), "id")
    sample = stage(rows.select("_text", "toxic", "weight", (chance % 4 != 0).alias("fit"), "id"), "toxic-sample")
    return sample if sample.select("toxic").distinct().count() == 2 else None


def _offending(sample: DataFrame):
    """(words of the vocabulary, whether offending): from families of toxic and of clean documents."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("family", T.LongType()),
                           T.StructField("toxic", T.IntegerType())])

    def make():
        def work(batch):
            out = set()
            for text, toxic in zip(batch[0], batch[1].to_pylist(), strict=True):
                words = (text.as_py() or "").encode().translate(WORD_BYTES).split()
                pairs = zip(words, words[1:], strict=False) if len(words) > 1 else [(w,) for w in words]
                family = min((xxhash.xxh64_intdigest(b" ".join(p), SEED) >> 1 for p in pairs), default=0)
                out.update((w, family, toxic) for w in set(words))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            return [[w.decode() for w in columns[0]], *map(list, columns[1:])]
        return work

    seen = map_batches(sample.where("fit").select("_text", "toxic"), schema, make).distinct()
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = stage(counts.where(f"a + b >= {MIN_FAMILIES}"), "toxic-words")
    all_a, all_b = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    # log odds ratio with half a family added on either side, and its standard error
    ratio = (F.log((F.col("a") + 0.5) / (all_a - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (all_b - F.col("b") + 0.5)))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    marked = counts.select("word", ((ratio > math.log(LIFT)) & (ratio / error > CONFIDENT)
                                    & (F.col("a") >= MIN_FAMILIES)).alias("offending"),
                           F.abs(ratio / error).alias("strength"))
    # of the words of a bounded sample, those that tell anything
    return marked.where("strength > 1").orderBy("word").select("word", "offending").toArrow()


def learn(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_docs: int = MAX_DOCS,
          steps: int = STEPS) -> Field:
    """Fit the field and the document model on (id, _text) rows and their labels."""
    held_out = hold_out(F.col("id"), 3, 1) if held_out is None else held_out
    sc = docs.sparkSession.sparkContext
    sample = _sample(docs, labels, held_out, max_docs)
    if sample is None:
        share = labels.where(F.col("toxic").isNotNull()).where(~hold_out(F.col("doc_id"), 3, 1)).agg(F.avg("toxic")).first()[0]
        return Field({}, np.zeros(8), np.zeros(4), float(share or 0.0))
    found = _offending(sample)
    words = {w.encode(): k for k, w in enumerate(found["word"].to_pylist())}
    n, offending = len(words), np.append(found["offending"].to_numpy(), False)
    shared = sc.broadcast((words, offending))
    encoded = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
                            T.StructField("toxic", T.IntegerType()), T.StructField("weight", T.DoubleType()),
                            T.StructField("fit", T.BooleanType())])

    def make():
        place = shared.value[0]

        def work(batch):
            rows = [read_lines(t.as_py(), place) for t in batch[0]]
            return [[a.tobytes() for a, _ in rows], [b.tobytes() for _, b in rows], *batch.columns[1:]]
        return work

    rows = map_batches(sample.select("_text", "toxic", "weight", "fit"), encoded, make)
    rows = stage(rows.repartition(FIT_TASKS), "toxic-lines")
    size = n + 1
    w, m, v = np.zeros(3 * size + 5), 0.0, 0.0
    w[3 * size] = -4.0
    one = T.StructType([T.StructField("gradient", T.BinaryType()), T.StructField("words", T.DoubleType())])
    for step in range(1, steps + 1):
        now = sc.broadcast(w)

        def run(batches, now=now):
            marked, total, weights = shared.value[1], np.zeros(3 * size + 5), 0.0
            for batch in batches:
                ids, sizes, tags, weight = _stacked(batch, marked)
                total += gradient(now.value, n, ids, sizes, tags, weight)
                weights += weight.sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([weights])],
                                             names=["gradient", "words"])

        parts = map_arrow(rows.where("fit"), run, one).collect()
        # in units of a thousand words; added in a fixed order, so tasks may end in any
        scale = sum(sorted(p["words"] for p in parts)) / 1000 or 1.0
        g = sum(np.frombuffer(x, np.float32).astype(float) for x in sorted(p["gradient"] for p in parts)) / scale
        g[:3 * size] -= PENALTY * w[:3 * size]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g  # Adam: words differ widely in frequency
        w = w + 0.5 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-3)
    return _document_model(rows, words, w)


def _stacked(batch: pa.RecordBatch, marked: np.ndarray):
    """Encoded rows of a batch as one run of lines: ids, line sizes, tags and word weights."""
    ids = [np.frombuffer(x.as_py(), np.int64) for x in batch[0]]
    sizes = [np.frombuffer(x.as_py(), np.int64) for x in batch[1]]
    toxic, weight = batch[2].to_numpy(), batch[3].to_numpy()
    tags = [marked[i] * t for i, t in zip(ids, toxic, strict=True)]
    weights = [np.full(len(i), x) for i, x in zip(ids, weight, strict=True)]
    return np.concatenate(ids), np.concatenate(sizes), np.concatenate(tags).astype(float), np.concatenate(weights)


def _document_model(rows: DataFrame, words: dict, w: np.ndarray) -> Field:
    """Logistic model of the document label on features of the marginals, fitted on rows the field hasn't seen."""
    n, shared = len(words), rows.sparkSession.sparkContext.broadcast(w)
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.IntegerType()),
                           T.StructField("weight", T.DoubleType())])

    def make():
        def work(batch):
            ids = [np.frombuffer(x.as_py(), np.int64) for x in batch[0]]
            sizes = [np.frombuffer(x.as_py(), np.int64) for x in batch[1]]
            return [_documents(shared.value, n, ids, sizes)[1], batch[2], batch[3]]
        return work

    unseen = rows.where("NOT fit")
    both = unseen.agg(F.min("toxic") != F.max("toxic")).first()[0]
    found = map_batches((unseen if both else rows).select("ids", "sizes", "toxic", "weight"), schema, make).toArrow()
    x = np.array(found["x"].to_pylist())
    y, weight = found["toxic"].to_numpy().astype(float), found["weight"].to_numpy()
    prior = float((y * weight).sum() / weight.sum())
    # to a balanced score: rows of either class weigh the same in total, so that 0.5 is no preference
    weight = np.where(y == 1, weight / (y * weight).sum(), weight / ((1 - y) * weight).sum())
    x = np.column_stack([np.ones(len(x)), x])
    return Field(words, w, logistic(x, y, weight), prior)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method with halved steps."""
    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (b @ b) / 2

    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(50):
        p = _sigmoid(x @ b)
        slope = x.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), slope)
        while (then := loss(b - step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - then < 1e-12:
            break
        b, now = b - step, then
    return b


def _documents(w: np.ndarray, n: int, ids: list, sizes: list):
    """Log odds of every word, and the features of every document."""
    flat, lines = np.concatenate(ids) if ids else np.empty(0, np.int64), np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    total = np.empty(0)
    if len(flat):
        left, right, first = _neighbours(flat, lines, n)
        total, _, _ = marginals(_potential(w, flat, left, right, n), lines, first, w[-4:])
    parts = np.split(total, np.cumsum([len(i) for i in ids])[:-1]) if ids else []
    return parts, [features(t, len(t)) for t in parts]


def _spans(text: str, offending: np.ndarray) -> list:
    """Code point ranges of the marked words."""
    raw = text.encode()
    starts, ends = word_bounds(raw.translate(WORD_BYTES))
    return [{"start": int(a), "end": int(b)} for a, b in
            zip(char_offsets(raw, starts[offending]), char_offsets(raw, ends[offending]), strict=True)]


def _scorer(key: str, shared):
    """texts -> (scores, spans), with the broadcast field; kept in the Python worker."""
    field = held(f"toxicity:{key}", lambda: shared.value)

    def score(texts: list):
        if not field.words:
            return [field.prior] * len(texts), [[] for _ in texts]
        scores, spans, lo, chars = [], [], 0, 0
        for k, text in enumerate(texts):
            chars += len(text or "")
            if chars >= GROUP_CHARS or k + 1 == len(texts):
                group = texts[lo:k + 1]
                rows = [read_lines(t, field.words) for t in group]
                odds, x = _documents(field.weights, len(field.words), [r[0] for r in rows], [r[1] for r in rows])
                scores += _sigmoid(np.array([[1.0, *f] for f in x]) @ field.document).tolist()
                spans += [_spans(t, np.flatnonzero(o >= 0)) if len(o) and o.max() >= 0 else []
                          for t, o in zip(group, odds, strict=True)]
                lo, chars = k + 1, 0
        return scores, spans
    return score


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, **params):
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(learn(rows, labels, **params))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD, **params) -> DataFrame:
    """One row per document: held_out, score, predicted, and the ranges of offending words."""
    key, shared = _learned(docs, labels, id_col, text_col, **params)
    rows = docs.select(F.col(id_col), hold_out(F.col(id_col), 3, 1).alias("held_out"), F.col(text_col).alias("_text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema[0], rows.schema[1], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])

    def make():
        score = _scorer(key, shared)

        def work(batch):
            scores, spans = score(batch[2].to_pylist())
            return [batch[0], batch[1], scores, [int(s >= threshold) for s in scores], spans]
        return work

    return map_batches(rows, schema, make)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = THRESHOLD, **params) -> DataFrame:
    """The documents that score below the threshold, all columns unchanged; one scan, no shuffle."""
    key, shared = _learned(docs, labels, id_col, text_col, **params)
    at = docs.columns.index(text_col)

    def run(batches):
        score = _scorer(key, shared)
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in score(batch[at].to_pylist())[0]], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
