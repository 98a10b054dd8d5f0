"""Benchmark decontamination: one Aho-Corasick automaton over windows of normalised test items.

Texts are lower-cased in A-Z and split into words of letters, digits and everything beyond ASCII. A
window is ``width`` consecutive words of an item; an item with fewer words, but not none, is one window.
The windows go into one automaton, and every document is scanned once. A document word inside any
occurrence of a window is hit. Runs of hit words are mapped back to code point offsets of the original.

Size: the windows are collected for the automaton only up to ``max_chars`` characters. A larger
benchmark is dealt into blocks by a hash of the window; each block is one automaton and one scan, and the
hits of the blocks are united per document, so the result is the same.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; equal
items and equal windows are reported under each item id; a null item id is named by the empty string;
repeated rows and null document ids are kept as they are; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvgrid.llm.common import WORD_BYTES, char_offsets, held, map_arrow, map_batches, stage, word_bounds

WIDTH = 10
MAX_CHARS = 8_000_000

_RUN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
                                 T.StructField("items", T.ArrayType(T.StringType()))]))
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))



def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def item_windows(items: DataFrame, item_col: str = "item_id", text_cols: Iterable[str] = ("text",),
                 width: int = WIDTH) -> DataFrame:
    """Distinct windows of all item texts (question, answer ...) with the ids of their items."""
    source = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                          F.explode(F.array(*[F.col(c) for c in text_cols])).alias("text"))
    schema = T.StructType([T.StructField("window", T.StringType()), T.StructField("length", T.IntegerType()),
                           T.StructField("item", T.StringType())])

    def make():
        def work(batch):
            rows = set()
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[i:i + width]
                    rows.add((b" ".join(part).decode(), len(part), item))
            return list(zip(*rows, strict=True)) if rows else [[], [], []]
        return work

    return (map_batches(source, schema, make).groupBy("window", "length")
            .agg(F.sort_array(F.collect_set("item")).alias("items")))


def _automaton(key: str, windows: list) -> ahocorasick.Automaton:
    """The automaton of one broadcast block, built once in a Python worker. Characters are bytes."""
    def build() -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for k, (window, _, _) in enumerate(windows):
            found.add_word(f" {window} ".encode().decode("latin-1"), k)
        if windows:
            found.make_automaton()
        return found

    return held(f"automaton:{key}", build)


def _runs(text: str | None, automaton: ahocorasick.Automaton, windows: list) -> tuple[int, list]:
    """Number of words, and (first word, last word, items) of every window found."""
    words = words_of(text)
    if not words or not windows:
        return len(words), []
    joined = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(joined.decode("latin-1")))
    if not found:
        return len(words), []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    last = np.searchsorted(gaps, [end for end, _ in found]) - 1
    return len(words), [(int(w) - windows[k][1] + 1, int(w), windows[k][2])
                        for w, (_, k) in zip(last, found, strict=True)]


def _spans(text: str, n_words: int, runs: list) -> tuple[int, list]:
    """Hit words, and the code point ranges of the runs of hit words in the original text."""
    step = np.zeros(n_words + 1, np.int64)
    for first, last, _ in runs:
        step[first] += 1
        step[last + 1] -= 1
    edge = np.diff(np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    raw = text.encode()
    starts, ends = word_bounds(raw.translate(WORD_BYTES))
    at = char_offsets(raw, starts[first]), char_offsets(raw, ends[last])
    return int((last - first + 1).sum()), [{"start": int(a), "end": int(b)} for a, b in zip(*at, strict=True)]


def _report(text: str | None, n_words: int, runs: list) -> tuple:
    items = sorted({item for _, _, names in runs for item in names})
    n_hit, spans = _spans(text, n_words, runs) if runs else (0, [])
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0, items, spans


def _blocks(windows: DataFrame, max_chars: int) -> list[DataFrame]:
    chars = windows.agg(F.sum(F.length("window") + F.length(F.concat_ws(",", "items")))).first()[0] or 0
    n = -(-chars // max_chars) or 1
    return [windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k) if n > 1 else windows for k in range(n)]


def _broadcast(block: DataFrame) -> tuple:
    rows = [tuple(r) for r in block.select("window", "length", "items").collect()]
    return uuid.uuid4().hex, block.sparkSession.sparkContext.broadcast(rows)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", text_cols: Iterable[str] = ("text",), width: int = WIDTH,
                  max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per document: words, hit words, items found, and the hit ranges of the original text."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    blocks = _blocks(item_windows(items, item_col, text_cols, width), max_chars)
    schema = T.StructType([
        rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", _SPAN)])
    if len(blocks) == 1:
        key, windows = _broadcast(blocks[0])

        def make():
            automaton = _automaton(key, windows.value)

            def work(batch):
                texts = batch[1].to_pylist()
                found = [_report(t, *_runs(t, automaton, windows.value)) for t in texts]
                return [batch[0], *map(list, zip(*found, strict=True))]
            return work

        return map_batches(rows, schema, make)

    rows = rows.withColumn("_hash", F.sha2("_text", 256))
    found = None
    for block in blocks:
        hits = _block_hits(rows, *_broadcast(block))
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("_id", "_of").agg(F.flatten(F.collect_set("_runs")).alias("_runs"))
    joined = rows.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left")

    def make_union():
        def work(batch):
            runs = [[(r["first"], r["last"], r["items"]) for r in x or ()] for x in batch[2].to_pylist()]
            rows = [_report(t, len(words_of(t)), r) for t, r in zip(batch[1].to_pylist(), runs, strict=True)]
            return [batch[0], *map(list, zip(*rows, strict=True))]
        return work

    return map_batches(joined.select(id_col, "_text", "_runs"), schema, make_union)


def _block_hits(rows: DataFrame, key: str, windows) -> DataFrame:
    """The documents that hold a window of one block, with their runs."""
    schema = T.StructType([T.StructField("_id", rows.schema[0].dataType), T.StructField("_of", T.StringType()),
                           T.StructField("_runs", _RUN)])

    def make():
        automaton = _automaton(key, windows.value)

        def work(batch):
            out = [(i, h, [{"first": a, "last": b, "items": n} for a, b, n in r])
                   for i, t, h in zip(*(batch[k].to_pylist() for k in range(3)), strict=True)
                   if (r := _runs(t, automaton, windows.value)[1])]
            return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return work

    return map_batches(rows, schema, make)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      text_cols: Iterable[str] = ("text",), width: int = WIDTH,
                      max_chars: int = MAX_CHARS, short_items: bool = True) -> DataFrame:
    """The documents without any window, all columns unchanged; one scan per block, no shuffle.

    Without ``short_items`` only windows of full width drop a document, those of each text and of an item's texts
    one after the other (a question and its answer), so that an answer like 'yes' drops nothing by itself.
    """
    at = docs.columns.index(text_col)
    windows = item_windows(items, item_col, text_cols, width)
    if not short_items:
        whole = items.select(item_col, F.concat_ws("\n", *text_cols).alias("_whole"))
        windows = (windows.unionByName(item_windows(whole, item_col, ("_whole",), width)).where(F.col("length") >= width)
                   .groupBy("window", "length").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    blocks = _blocks(windows, max_chars)
    for k, block in enumerate(blocks):
        key, windows = _broadcast(block)
        docs = stage(docs, "clean") if k else docs  # one automaton at a time in a worker

        def run(batches, key=key, windows=windows):
            automaton = _automaton(key, windows.value)
            for batch in batches:
                clean = [not _runs(t, automaton, windows.value)[1] for t in batch[at].to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
