"""Language-model scores from a subword lattice.

The pieces come from an existing vocabulary (a sentencepiece file); which of them a word is cut into is left
open. A word's probability is the sum over all its segmentations of the product of the pieces' unigram
probabilities, by a forward recursion in log space over the lattice of its bytes. A character that is no
piece is spelled by the vocabulary's byte pieces. A text is its words (lower case A-Z, split at ASCII white
space), independent of each other, and one end.

The pieces' probabilities are learned from the training documents by expectation maximisation: forward-backward
over the lattice of every distinct training word, weighted by its count, starting from the file's own order
of the pieces. Sums are taken in whole 2^-20ths, so the result does not depend on the order of tasks.

Size: a word is scored once however often it occurs. Counts are gathered per task before they are shuffled. The
most frequent words, at most ``max_head`` of at most 64 bytes, are broadcast, and a document's other words meet
their scores in a join; none of those is frequent, as frequency decides who is broadcast. Piece counts are
as many as the vocabulary has pieces.

The base score is the sum over tokens of log10((c + 1) / (N + V + 1)) with training counts c, N tokens and
V distinct ones.

Defined cases: a null or empty text is the end alone; without training documents counts and N are 0 and the
pieces keep their start; null ids count as empty text when rows are held out; rows that repeat an id are
scored each; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pvgrid.llm.common import hold_out, map_arrow, map_batches, stage

ROUNDS = 2
MAX_HEAD = 150_000
HEAD_BYTES = 64
FLUSH = 200_000
SMOOTH = 0.1
UNIT = 1 << 20

_START = "▁".encode()  # what the vocabulary puts before a word
_cache: dict[str, object] = {}


def _cached(key: str, build: Callable):
    """One value per kind in a Python worker, rebuilt for another broadcast."""
    kind = key.split(":")[0]
    if _cache.get(kind, (None,))[0] != key:
        _cache[kind] = (key, build())
    return _cache[kind][1]


def vocabulary(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces, byte pieces): UTF-8 pieces in file order, and the index of the piece for each byte value."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, of_byte = [], np.full(256, -1, np.int64)
    for k in range(model.get_piece_size()):
        if model.is_byte(k):
            of_byte[int(model.id_to_piece(k)[1:-1], 16)] = len(pieces)
            pieces.append(b"")
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            pieces.append(model.id_to_piece(k).encode())
    for b in np.flatnonzero(of_byte < 0).tolist():  # a vocabulary without byte pieces gets them
        of_byte[b] = len(pieces)
        pieces.append(b"")
    return pieces, of_byte


class Lattice:
    """Edges of the lattices of many words at once."""

    def __init__(self, pieces: list[bytes], of_byte: np.ndarray):
        self.of_byte = of_byte
        self.length = np.array([len(p) or 1 for p in pieces], np.int64)
        self.found = ahocorasick.Automaton()
        for k, piece in enumerate(pieces):
            if piece and b"\n" not in piece:
                self.found.add_word(piece.decode("latin-1"), k)
        self.found.make_automaton()

    def edges(self, words: list[bytes]):
        """(start, end, piece, first, last): node numbers of edges sorted by depth, and of each word's ends.

        A word of n bytes (with its start mark) has n + 1 nodes in a row.
        """
        marked = [_START + w for w in words]
        text = b"\n".join(marked)  # no piece crosses a line end
        size = np.array([len(m) for m in marked], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        hits = np.fromiter((x for hit in self.found.iter(text.decode("latin-1")) for x in hit), np.int64).reshape(-1, 2)
        end, piece = hits[:, 0] + 1, hits[:, 1]
        start = end - self.length[piece]
        # characters that are no piece of their own are spelled in bytes
        octets = np.frombuffer(text, np.uint8)
        lead = np.flatnonzero((octets & 0xC0) != 0x80)
        char_size = np.diff(np.append(lead, len(octets)))
        char_of = np.repeat(np.arange(len(lead)), char_size)
        known = np.zeros(len(lead), bool)
        known[char_of[start[(lead[char_of[start]] == start) & (char_size[char_of[start]] == end - start)]]] = True
        spelled = np.flatnonzero(~known[char_of] & (octets != 0x0A))
        start, end = np.concatenate([start, spelled]), np.concatenate([end, spelled + 1])
        piece = np.concatenate([piece, self.of_byte[octets[spelled]]])
        inside = np.flatnonzero(octets[start] != 0x0A)
        start, end, piece = start[inside], end[inside], piece[inside]
        word = np.searchsorted(first, start, "right") - 1
        order = np.argsort((end - first[word]) * (len(text) + 1) + end)
        return start[order], end[order], piece[order], word[order], first, first + size

    def forward(self, edges, log_p: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways from a word's first node to every node."""
        start, end, piece, word, first, last = edges
        alpha = np.full(last[-1] + 1, -np.inf)
        alpha[first] = 0.0
        weight = log_p[piece]
        for lo, hi in _depths(end - first[word]):
            _log_sum(alpha, end[lo:hi], alpha[start[lo:hi]] + weight[lo:hi])
        return alpha

    def backward(self, edges, log_p: np.ndarray) -> np.ndarray:
        start, end, piece, word, first, last = edges
        deepest = int((start - first[word]).max(initial=0))
        order = np.argsort((deepest - (start - first[word])) * (last[-1] + 1) + start)
        start, end, weight, word = start[order], end[order], log_p[piece][order], word[order]
        beta = np.full(last[-1] + 1, -np.inf)
        beta[last] = 0.0
        for lo, hi in _depths(first[word] - start):
            _log_sum(beta, start[lo:hi], beta[end[lo:hi]] + weight[lo:hi])
        return beta

    def expected(self, words: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece."""
        edges = self.edges(words)
        start, end, piece, word, first, last = edges
        alpha, beta = self.forward(edges, log_p), self.backward(edges, log_p)
        share = np.exp(alpha[start] + log_p[piece] + beta[end] - alpha[last][word])
        return np.bincount(piece, share * counts[word], len(log_p))

    def score(self, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        edges = self.edges(words)
        return self.forward(edges, log_p)[edges[-1]]


def _depths(depth: np.ndarray):
    """Ranges of equal values in a sorted array."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _log_sum(into: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """into[at] = log of the summed exponentials of x with equal ``at``, which is sorted."""
    heads = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    top = np.maximum.reduceat(x, heads)
    runs = np.diff(np.append(heads, len(x)))
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.add.reduceat(np.exp(x - np.repeat(top, runs)), heads)
        into[at[heads]] = np.where(np.isneginf(top), top, top + np.log(total))


def _groups(words: list[bytes], octets: int = 400_000):
    """Slices of the list with about so many bytes each."""
    lo = size = 0
    for k, w in enumerate(words):
        size += len(w) + 4
        if size >= octets:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(words):
        yield lo, len(words)


def word_counts(docs: DataFrame, text_col: str, held_out: str) -> DataFrame:
    """(word, c, n): training count and count in all documents of every distinct word."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("c", T.LongType()),
                           T.StructField("n", T.LongType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        train, held = Counter(), Counter()

        def flush():
            words = list(train.keys() | held.keys())
            c = np.fromiter(map(train.get, words, repeat(0)), np.int64, len(words))
            n = c + np.fromiter(map(held.get, words, repeat(0)), np.int64, len(words))
            train.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c), pa.array(n)],
                                              schema=arrow)

        for batch in batches:
            for text, out in zip(batch[0], batch[1], strict=True):
                (held if out.as_py() else train).update((text.as_py() or "").encode().lower().split())
                if len(train) + len(held) > FLUSH:
                    yield flush()
        if train or held:
            yield flush()

    return map_arrow(docs.select(text_col, held_out), run, schema).groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"))


def _lattice(key: str, shared) -> Lattice:
    return _cached(f"lattice:{key}", lambda: Lattice(*shared.value))


def learn(words: DataFrame, n_ends: int, model_file: str, rounds: int = ROUNDS):
    """(broadcast vocabulary, its key, log probabilities of the pieces, of the end) from (word, c)."""
    sc = words.sparkSession.sparkContext
    pieces, of_byte = vocabulary(model_file)
    key, shared = uuid.uuid4().hex, sc.broadcast((pieces, of_byte))
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("units", T.LongType())])
    log_p = np.log(1.0 / (np.arange(len(pieces)) + 10.0))
    log_p -= np.log(np.exp(log_p).sum())
    total = 0.0
    for _ in range(rounds):
        now = sc.broadcast(log_p)

        def run(batches, now=now):
            arrow = to_arrow_schema(schema)
            lattice, total = _lattice(key, shared), 0.0
            for batch in batches:
                text, counts = [w.encode() for w in batch[0].to_pylist()], batch[1].to_numpy()
                for lo, hi in _groups(text):
                    total = total + np.rint(lattice.expected(text[lo:hi], counts[lo:hi], now.value) * UNIT)
            if np.ndim(total):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].astype(np.int64))],
                                                 schema=arrow)

        ordered = words.where("c > 0").select("word", "c")
        found = map_arrow(ordered, run, schema).groupBy("piece").agg(F.sum("units").alias("units")).toArrow()
        uses = np.zeros(len(pieces))
        uses[found["piece"].to_numpy()] = found["units"].to_numpy() / UNIT
        total = uses.sum()
        log_p = np.log((uses + SMOOTH) / (total + SMOOTH * len(pieces)))
    # the end competes with the pieces
    p_end = (n_ends + SMOOTH) / (total + n_ends + SMOOTH * (len(pieces) + 1))
    return shared, key, log_p + math.log1p(-p_end), math.log(p_end)


def word_scores(words: DataFrame, shared, key: str, log_p: np.ndarray) -> DataFrame:
    """(word, c, n, log10_p) for every word."""
    now = words.sparkSession.sparkContext.broadcast(log_p)
    schema = T.StructType([*words.schema, T.StructField("log10_p", T.DoubleType())])

    def make():
        lattice = _lattice(key, shared)

        def work(batch):
            text = [w.encode() for w in batch[0].to_pylist()]
            found = [lattice.score(text[lo:hi], now.value) for lo, hi in _groups(text)]
            return [*batch.columns, np.concatenate(found) / math.log(10)]
        return work

    return map_batches(words, schema, make)


def _head(words: DataFrame, max_head: int):
    """The most frequent words (at most ``max_head``) as Arrow, and the frequency from which they are taken."""
    size = F.floor(F.log2("n")).cast("int")
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    steps = sorted(((r["step"], r["count"]) for r in short.groupBy(size.alias("step")).count().collect()), reverse=True)
    taken, least = 0, 1 << 62
    for step, count in steps:
        taken += count
        if taken > max_head:
            break
        least = 1 << step
    return short.where(F.col("n") >= least).select("word", "c", "log10_p").toArrow()


def score_documents(docs: DataFrame, model_file: str, held_out: Column | None = None, id_col: str = "doc_id",
                    text_col: str = "text", rounds: int = ROUNDS, max_head: int = MAX_HEAD) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` marks the rows nothing is learned from (default: crc32 of the id modulo 7 is 2).
    """
    held_out = hold_out(F.col(id_col), 7, 2) if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), held_out.alias("held_out"))
    words = stage(word_counts(rows, "_text", "held_out"), "words")
    ends = rows.where("NOT held_out").count()
    totals = words.agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("types")).first()
    train_tokens, types = (totals["tokens"] or 0) + ends, totals["types"] + (ends > 0)
    shared, key, log_p, log_end = learn(words, ends, model_file, rounds)
    words = stage(word_scores(words, shared, key, log_p), "word-scores")
    below = train_tokens + types + 1
    base = F.log10((F.col("c") + 1) / F.lit(below))
    head = _head(words, max_head)
    head_key = uuid.uuid4().hex
    head = docs.sparkSession.sparkContext.broadcast((
        head["word"].cast(pa.binary()).to_pylist(), head["c"].to_numpy(), head["log10_p"].to_numpy()))
    schema = T.StructType([
        *rows.select("id", "held_out").schema, T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()),
        T.StructField("lattice", T.DoubleType()), T.StructField("tail", T.ArrayType(T.StringType()))])

    def make():
        def build():
            text, c, p = head.value
            # the last entry is for words that are looked up later
            return ({w: k for k, w in enumerate(text)}, np.append(c > 0, False),
                    np.append(np.log10((c + 1) / below), 0.0), np.append(p, 0.0))
        place, known, base_of, p_of = _cached(f"head:{head_key}", build)
        get, none = place.get, len(place)

        def work(batch):
            out = []
            for text in batch[1]:
                tokens = (text.as_py() or "").encode().lower().split()
                at = np.fromiter(map(get, tokens, repeat(none)), np.int64, len(tokens))
                rest = [tokens[k].decode() for k in np.flatnonzero(at == none).tolist()]
                out.append((len(tokens) + 1, int(known[at].sum()), float(base_of[at].sum()), float(p_of[at].sum()), rest))
            return [batch[0], batch[2], *map(list, zip(*out, strict=True))]
        return work

    scored = stage(map_batches(rows, schema, make).withColumn("row", F.monotonically_increasing_id()), "head-scores")
    tail = (scored.select("row", F.explode("tail").alias("word")).join(words, "word").groupBy("row")
            .agg(F.count_if(F.col("c") > 0).alias("tail_known"), F.sum(base).alias("tail_base"),
                 F.sum("log10_p").alias("tail_lattice")))
    zero = F.lit(0)
    return (scored.join(tail, "row", "left")
            .select(F.col("id").alias(id_col), "held_out", "n_tokens",
                    (F.col("n_known") + F.coalesce("tail_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
                    F.lit(train_tokens).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("tail_base", zero) + math.log10((ends + 1) / below)).alias("base_score"),
                    (F.col("lattice") + F.coalesce("tail_lattice", zero) + log_end / math.log(10)).alias("score")))
