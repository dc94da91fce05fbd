"""Pieces shared by the corpus operators: table access, byte-level tokenising, batches of bounded size.

Texts reach Python as Arrow batches. Words are found on the UTF-8 bytes of a whole batch at once:
every separator the operators use is ASCII, so no byte of a longer character can be mistaken for one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once inside a task; one longer text is still taken whole.
SLICE_BYTES = 1 << 21
#: Bytes hashed at once.
PIECE_BYTES = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to clash with no column of ``docs``."""
    used, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shielded(stage):
    """A function of ``(docs, ...)`` that returns the columns of ``docs`` and works with columns named ``__...`` itself.

    Columns of ``docs`` so named go by other names while it works.
    """
    @wraps(stage)
    def work(docs: DataFrame, *args, **more) -> DataFrame:
        own = [c for c in docs.columns if c.startswith("__")]
        if not own:
            return stage(docs, *args, **more)
        away = dict(zip(own, fresh(docs, *(f"kept{c}" for c in own))))
        back = {v: k for k, v in away.items()}
        found = stage(docs.withColumnsRenamed(away), *args, **more)
        return found.withColumnsRenamed(back)

    return work


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Rows kept away from learning: crc32 of the id as text falls on ``remainder``. Null ids are held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % modulus == remainder, F.lit(True))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` holding about ``limit`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null reads as empty."""
    column = pc.fill_null(column, "")
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    if data is None or not len(wide) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered_classes(is_word) -> tuple[np.ndarray, np.ndarray]:
    """Byte tables: lower-cased byte, and whether the (lower-cased) byte belongs to a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower, np.array([bool(is_word(int(b))) for b in lower])


#: Words are what lies between blanks and the five control characters after them.
BLANK_SEPARATED = lowered_classes(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are digits, ASCII letters and anything beyond ASCII.
ALPHANUMERIC = lowered_classes(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, one for each byte of a piece and one more."""
    up, down = np.full(PIECE_BYTES + 1, _ODD), np.full(PIECE_BYTES + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per byte range, equal for equal ranges wherever they lie.

    Ranges ascend and do not overlap. Bytes are worked on in pieces, so what is held beside ``data``
    does not grow with it; a range over several pieces adds up what each of them holds of it.
    """
    value = np.zeros(len(starts), np.uint64)
    up, down = powers()
    for base in range(0, len(data) if len(starts) else 0, PIECE_BYTES):
        piece = data[base : base + PIECE_BYTES]
        low = int(np.searchsorted(ends, base, side="right"))
        high = int(np.searchsorted(starts, base + len(piece), side="left"))
        if low >= high:
            continue
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        first = np.maximum(starts[low:high] - base, 0)
        held = (total[np.minimum(ends[low:high] - base, len(piece))] - total[first]) * down[first]
        if starts[low] < base:  # the one range that began in an earlier piece
            held[:1] *= np.uint64(pow(int(_ODD), int(base - starts[low]), 1 << 64))
        value[low:high] += held
    return mix(value + (ends - starts).astype(np.uint64) * _ODD)


def released(work):
    """``work`` of a ``mapInArrow``, giving freed memory back to the system when its task ends.

    Python workers outlive their tasks and hold on to what they freed, beside the executor's own memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


@dataclass
class Words:
    """Words of several texts: byte ranges, the text each belongs to, and each text's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one entry per text and one more: word numbers

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> Words:
    """Maximal runs of word bytes within each text, ASCII letters lower-cased."""
    lower, member = classes
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(offsets), np.int64))
    inside = member[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(lower[data], starts, ends, np.searchsorted(starts, offsets))
