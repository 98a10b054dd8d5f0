"""Token ids as compressed bit or byte planes.

Documents are encoded by a tokenizer of the ``tokenizers`` library, an end id is appended to each, and the
ids are laid out in ascending order of document id. A range sort deals the documents to shards; a shard is
a sequence of chunks of about ``chunk_ids`` ids. A chunk is one row of the output table:

* ``shard``, ``chunk``, ``first`` (ids of the shard before it), ``n_ids``,
* ``doc_ids``, ``doc_skips``, ``doc_sizes``: the documents in it, how many of their ids lie in earlier
  chunks, and how many in this one,
* ``payload``: header, index of the planes' lengths, and the planes. The ids of the chunk are cut into
  blocks of ``block_ids``; each block of 32-bit ids is transposed into 4 byte planes or 32 bit planes, and
  each plane is a zstandard frame.

The table is Parquet, so any file system Spark can write will do. Every chunk can be read alone; a document
that crosses chunks is put together from the check sums of its parts. Reading back therefore moves no ids.

Encoding: byte-level BPE never joins characters across the start of a white space run, so the parts
``white space + non white space`` of a text are encoded on their own, and the first short ones are
remembered in a Python worker, in ``MEMO`` bytes, until most parts are new. Texts with the string of a special token, and tokenizers of any
other build, go through the library as whole texts.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are written in the order of
their texts; null ids come first; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pvgrid.llm.common import held, map_arrow, map_batches
from pvgrid.session import staged_path

END = 0
CHUNK_IDS = 1 << 20
BLOCK_IDS = 1 << 16
#: Bytes of memory for remembered parts in a Python worker, and what one takes besides its characters and ids.
MEMO = 160 << 20
MEMO_ENTRY = 200
#: The memory is begun anew after one unknown part for so many of its bytes.
RENEW = 32
LEVEL = 1

_HEAD = struct.Struct("<4sBIIQ")
_MAGIC = b"PVP1"
_SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PART = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ODD = re.compile(f"[{_SPACE}]{{2}}|(?! )[{_SPACE}]|[{_SPACE}]*$")
#: A word of Latin letters after one space at most, and ASCII marks behind it: the first step of the encoding
#: cuts between them and nowhere else, so the word can go to the merges at once.
_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+([!-/:-@\\[-`{-~]{0,8})$")


class Encoder:
    """Ids of whole texts from a tokenizer file's content."""

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        spec = json.loads(content)
        before = spec.get("pre_tokenizer") or {}
        self.by_part = (spec.get("normalizer") is None and before.get("type") == "ByteLevel"
                        and before.get("use_regex") and not before.get("add_prefix_space"))
        # the byte level writes printable bytes as themselves, the others as characters from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)}
        self.marks: dict[str, bytes] = {}
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.room = MEMO
        self.strange = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without line ends, many to a call: set on lines of one text, cut at the line ends' id."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.line_end)
        if len(cuts) + 1 != len(parts):
            return self._library(parts)
        raw, starts = ids.tobytes(), [0, *(4 * cuts + 4).tolist()]
        return [raw[a:b] for a, b in zip(starts, [*(4 * cuts).tolist(), len(raw)], strict=True)]

    def _word(self, word: str) -> bytes:
        """Ids of a word by the library's merges, in the alphabet of its byte level."""
        units = word.replace(" ", self.alphabet[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        ids = [token.id for token in self.tokenizer.model.tokenize(units)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _remember(self, part: str, ids: bytes) -> bool:
        """Keep the ids of a part if there is room."""
        if self.room <= 0:
            return False
        self.known[part] = ids
        self.room -= len(part) + len(ids) + MEMO_ENTRY
        return True

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of unknown parts. Short ones are remembered while there is room, the others are returned."""
        known, spare, fresh, odd, other = self.known, {}, [], [], {}
        for part in missing:
            if len(part) <= 64 and (match := _WORD.match(part)):
                mark = match[1]
                word = part[:-len(mark)] if mark else part
                if (ids := known.get(word) or spare.get(word)) is None:
                    ids = self._word(word)
                    if not self._remember(word, ids):
                        spare[word] = ids
                if mark:
                    if mark not in self.marks:
                        self.marks[mark] = self._library([mark])[0]
                    if not self._remember(part, ids + self.marks[mark]):
                        spare[part] = ids + self.marks[mark]
            else:
                # a part that starts with one space at most stands alone on its line
                (odd if _ODD.match(part) else fresh).append(part)
        for k in range(0, len(fresh), 1000):
            other.update(zip(fresh[k:k + 1000], self._parts(fresh[k:k + 1000]), strict=True))
        if odd:
            other.update(zip(odd, self._library(odd), strict=True))
        for part, ids in other.items():
            if len(part) > 64 or not self._remember(part, ids):
                spare[part] = ids
        if self.room <= 0:
            self.strange += len(missing)
        return spare

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [_PART.findall(t) if self.by_part and not any(s in t for s in self.special) else None for t in texts]
        known = self.known
        found = [list(map(known.get, x)) if x is not None else None for x in parts]
        holes = [[k for k, i in enumerate(ids) if i is None] if ids and None in ids else () for ids in found]
        missing = {x[k] for x, at in zip(parts, holes, strict=True) for k in at}
        spare = self._learn(missing) if missing else {}
        out = []
        for text, x, ids, at in zip(texts, parts, found, holes, strict=True):
            for k in at:
                ids[k] = known[x[k]] if x[k] in known else spare[x[k]]
            out.append(b"".join(ids) if ids is not None else self._library([text])[0])
        if self.strange > MEMO // RENEW:  # the texts have changed, what is remembered is of little use
            known.clear()
            self.marks.clear()
            self.room, self.strange = MEMO, 0
        return out


def encoder(content: str) -> Encoder:
    return held(f"encoder:{zlib.crc32(content.encode())}", lambda: Encoder(content))


def pack(ids: np.ndarray, planes: str = "byte", block_ids: int = BLOCK_IDS) -> bytes:
    """A chunk's payload."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    frames = []
    for start in range(0, len(ids), block_ids):
        octets = ids[start:start + block_ids].astype("<u4").view(np.uint8).reshape(-1, 4)
        if planes == "byte":
            frames += [press.compress(np.ascontiguousarray(octets[:, k]).tobytes()) for k in range(4)]
        else:
            bits = np.unpackbits(octets, axis=1, bitorder="little")
            frames += [press.compress(np.packbits(bits[:, k]).tobytes()) for k in range(32)]
    head = _HEAD.pack(_MAGIC, 4 if planes == "byte" else 32, block_ids, len(frames), len(ids))
    return head + np.array([len(f) for f in frames], "<u4").tobytes() + b"".join(frames)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a chunk."""
    magic, width, block_ids, n_frames, n_ids = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token planes")
    sizes = np.frombuffer(payload, "<u4", n_frames, _HEAD.size)
    ends = _HEAD.size + 4 * n_frames + np.cumsum(sizes, dtype=np.int64)
    press, ids = zstandard.ZstdDecompressor(), np.empty(n_ids, "<u4")
    for block, start in enumerate(range(0, n_ids, block_ids)):
        n = min(block_ids, n_ids - start)
        raw = [np.frombuffer(press.decompress(payload[ends[k] - sizes[k]:ends[k]]), np.uint8)
               for k in range(block * width, (block + 1) * width)]
        octets = ids[start:start + n].view(np.uint8).reshape(-1, 4)
        if width == 4:
            for k in range(4):
                octets[:, k] = raw[k]
        else:
            octets[:] = np.packbits(np.stack([np.unpackbits(r, count=n) for r in raw], axis=1), axis=1, bitorder="little")
    return ids


def _chunk_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_skips", T.ArrayType(T.LongType())),
        T.StructField("doc_sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END, planes: str = "byte", chunk_ids: int = CHUNK_IDS,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode the documents and write the chunk table below ``path``."""
    with open(tokenizer_file, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = _chunk_schema(rows.schema["_id"].dataType)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        arrow = to_arrow_schema(schema)
        encode = encoder(content.value).encode
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        held, docs_in, size = [], [], 0  # ids not yet written, (id, skip, size) of their documents

        def flush():
            nonlocal chunk, first, held, docs_in, size
            ids = np.frombuffer(b"".join(held), "<u4")
            columns = [[shard], [chunk], [first], [len(ids)], *([list(c)] for c in zip(*docs_in, strict=True)),
                       [pack(ids, planes, block_ids)]]
            chunk, first, held, docs_in, size = chunk + 1, first + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                                              schema=arrow)

        for doc_id, ids in _encoded(batches, encode):
            raw, skip = memoryview(ids + end), 0
            while len(raw):
                part = raw[:4 * (chunk_ids - size)]
                held.append(part)
                docs_in.append((doc_id, skip, len(part) // 4))
                raw, skip, size = raw[len(part):], skip + len(part) // 4, size + len(part) // 4
                if size == chunk_ids:
                    yield flush()
        if size:
            yield flush()

    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    map_arrow(ordered, run, schema).write.parquet(path)


def _encoded(batches, encode, chars: int = 1_000_000):
    """(id, ids) per document, encoded in groups of about so many characters."""
    for batch in batches:
        ids, texts, group, n = batch[0].to_pylist(), batch[1], [], 0
        for k in range(len(ids)):
            group.append(texts[k].as_py() or "")
            n += len(group[-1])
            if n >= chars or k + 1 == len(ids):
                yield from zip(ids[k + 1 - len(group):k + 1], encode(group), strict=True)
                group, n = [], 0


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for k in range(vector.bit_length()):
        if vector >> k & 1:
            out ^= matrix[k]
    return out


def crc_join(left: int, right: int, right_bytes: int) -> int:
    """CRC-32 of two byte strings put together, from their own: advance the left one over zero bytes."""
    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit, on the reflected register
    for _ in range(3):
        step = [_times(step, c) for c in step]  # now one byte
    while right_bytes:
        if right_bytes & 1:
            left = _times(step, left)
        step = [_times(step, c) for c in step]
        right_bytes >>= 1
    return left ^ right


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    chunks = spark.read.parquet(path)
    id_type = chunks.schema["doc_ids"].dataType.elementType
    part = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("id", id_type),
        T.StructField("skip", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])

    def make():
        def work(batch):
            out = []
            for shard, first, n_ids, ids, skips, sizes, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, at = unpack(payload).tobytes(), 0
                for i, skip, n in zip(ids, skips, sizes, strict=True):
                    out.append((shard, first + at - skip, i, skip, n, zlib.crc32(raw[4 * at:4 * (at + n)])))
                    at += n
            return [list(c) for c in zip(*out, strict=True)]
        return work

    parts = map_batches(chunks.select("shard", "first", "n_ids", "doc_ids", "doc_skips", "doc_sizes", "payload"),
                        part, make)
    # a document's parts, mostly one, meet by its place; its size and check sum follow from theirs
    docs = parts.groupBy("shard", "at").agg(
        F.first("id").alias("id"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("skip", "n", "crc"))).alias("parts"))
    joined = T.StructType([part["shard"], part["at"], part["id"], part["n"], part["crc"]])

    def make_joined():
        def work(batch):
            crcs = []
            for pieces in batch[4].to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            return [*batch.columns[:4], crcs]
        return work

    rows = map_batches(docs, joined, make_joined)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
              .select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return rows.join(shards, "shard").select(F.col("id").alias(id_col), (F.col("_before") + F.col("at")).alias("start"),
                                             F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_digest(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                 **params) -> DataFrame:
    """Write the documents' ids in the shared folder, and what ``read_tokens`` finds there."""
    spark = docs.sparkSession
    path = staged_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_file, id_col, text_col, **params)
    return read_tokens(spark, path, id_col)
