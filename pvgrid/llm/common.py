"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pvgrid.session import stage

__all__ = ["Batch", "WORD_BYTES", "char_offsets", "give_back", "held", "hold_out", "map_arrow", "map_batches", "stage", "table",
           "word_bounds"]

Batch = Callable[[pa.RecordBatch], list]

# ASCII capitals to small letters, every ASCII character that is no letter or digit to a space;
# bytes from 0x80 on belong to words, so the table works on UTF-8 and keeps every offset.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo ``parts``, is ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


#: Texts may be long, so few go into one Arrow batch, by number and by size.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}

_shipped: set[str] = set()
_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """``make()``, kept in the Python worker until another key is asked for, by whatever operator.

    Workers are used again by later stages, so what each of them would keep adds up.
    """
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Return memory that is free in this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installation."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="pvgrid-code-")) / f"{top.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with this package on the workers and small batches."""
    _ship(df.sparkSession)
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, schema: T.StructType, make: Callable[[], Batch]) -> DataFrame:
    """``mapInArrow`` where ``make()`` is called once per task and its result maps a batch to columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else
                     c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                     for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return map_arrow(df, run, schema)


def word_bounds(mapped: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words of a text that went through ``WORD_BYTES``."""
    inside = np.zeros(len(mapped) + 2, np.int8)
    inside[1:-1] = np.frombuffer(mapped, np.uint8) != 0x20
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def char_offsets(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets into UTF-8 text as code point offsets."""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return lead[offsets]
