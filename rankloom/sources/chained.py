"""SHA-256 of files too large for one task: the chain over a file's bytes goes from task to task.

Spark's line reader splits a file of any content into ranges, and its lines with their ends are the
file's bytes. Lines are written down once as pieces, by the round in which their range begins; in each
round a task per file goes on from the state that the round before left, 112 bytes, and no task reads
more of a file than one round holds.
"""

from __future__ import annotations

import _hashlib
import ctypes
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom import session
from rankloom.operators.quality import CheckFailed

#: Ranges of a file that begin within as many bytes of it are hashed in one round.
ROUND_BYTES = 1 << 27
#: Bytes of a row; ten thousand of them travel to Python at once.
PIECE_BYTES = 1 << 13
#: The line reader takes these three bytes away where a file begins with them.
MARK = b"\xef\xbb\xbf"
#: The line reader decompresses files with such names.
COMPRESSED = r"(?i)\.(gz|bz2|deflate|lz4|lzo|snappy|zst|passthrough)$"


@lru_cache(maxsize=1)
def _library() -> ctypes.CDLL:
    """The library behind ``hashlib``, which keeps a digest's state to itself."""
    found = ctypes.CDLL(_hashlib.__file__)
    found.SHA256_Init.argtypes = [ctypes.c_void_p]
    found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return found


class Chain:
    """A SHA-256 under way; ``state`` is all that another process needs to go on with it."""

    def __init__(self, state: bytes | None = None):
        self.held = ctypes.create_string_buffer(state or bytes(112), 112)
        if state is None:
            _library().SHA256_Init(self.held)

    @property
    def state(self) -> bytes:
        return self.held.raw

    def update(self, data: bytes) -> None:
        _library().SHA256_Update(self.held, data, len(data))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        _library().SHA256_Final(out, ctypes.create_string_buffer(self.state, 112))
        return out.raw.hex()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, block, nth, content``: lines with their ends put together, in the order of the reader."""
    nth = 0
    for batch in batches:
        where = np.stack([batch.column(c).to_numpy() for c in ("file", "block")])
        edges = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            data = b"\n".join([*batch.column("value")[low:high].to_pylist(), b""])
            content = [data[n : n + PIECE_BYTES] for n in range(0, len(data), PIECE_BYTES)]
            count = len(content)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(count, where[0, low]), pa.int32()), pa.array(np.full(count, where[1, low]), pa.int64()),
                 pa.array(np.arange(nth, nth + count), pa.int64()), pa.array(content, pa.binary())],
                ["file", "block", "nth", "content"])
            nth += count


def literal(path: str) -> str:
    """``path`` as Spark's readers take it, without a pattern in it."""
    return re.sub(r"([][{}*?\\])", r"\\\1", path)


def _lines(spark: SparkSession, nth: int, path: str) -> DataFrame:
    rows = spark.read.text(literal(path), lineSep="\n")
    return rows.select(F.lit(nth).alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").cast("binary").alias("value"))


def digests(spark: SparkSession, files: list[tuple[str, int]]) -> list[str]:
    """SHA-256 of each of ``files(path, size)``, none of which has a name like ``COMPRESSED``.

    The driver holds a state per file. A file is held in memory only as far as it has no line end.
    """
    lines = reduce(DataFrame.union, [_lines(spark, n, path) for n, (path, _) in enumerate(files)])
    found = lines.mapInArrow(_pieces, "file int, block long, nth long, content binary")
    folder = f"{session.stage_root(spark)}/rankloom/{uuid.uuid4().hex}"
    (found.withColumn("round", F.floor(F.col("block") / ROUND_BYTES)).withColumn("n", F.length("content"))
     .write.partitionBy("round").parquet(folder))
    staged = spark.read.parquet(folder)
    amounts = staged.groupBy("file", "round").agg(F.sum("n").alias("n")).collect()  # one row per file and round
    chains: dict[int, tuple[bytes, int]] = {}  # state, and bytes to come
    for nth, (path, size) in enumerate(files):
        over = sum(r.n for r in amounts if r.file == nth) - size  # 1 where the last line has no end
        if over not in (0, 1, -len(MARK), 1 - len(MARK)):
            raise CheckFailed(f"{path}: its lines do not add up to {size} bytes but to {over} more")
        mark, chain = MARK if over < 0 else b"", Chain()
        chain.update(mark)
        chains[nth] = chain.state, size - len(mark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going: dict[int, tuple[Chain, int]] = {}
        for batch in batches:
            for nth, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                if nth not in going:
                    going[nth] = Chain(before[nth][0]), before[nth][1]
                chain, left = going[nth]
                chain.update(data[:left])
                going[nth] = chain, left - min(left, len(data))
        for nth, (chain, left) in going.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([nth], pa.int32()), pa.array([chain.state], pa.binary()), pa.array([left], pa.int64())],
                ["file", "state", "left"])

    for step in sorted({r.round for r in amounts}):
        before = dict(chains)
        rows = staged.where(F.col("round") == step).select("file", "block", "nth", "content")
        rows = rows.repartitionById(len(files), F.col("file")).sortWithinPartitions("file", "block", "nth")
        for r in rows.mapInArrow(work, "file int, state binary, left long").collect():  # one row per file
            chains[r.file] = bytes(r.state), r.left
    return [Chain(chains[nth][0]).hexdigest() for nth in range(len(files))]
