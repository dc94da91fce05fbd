"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries with normalised chunking: a hard mask up to the
normal size, an easy one beyond it, so chunk sizes gather around the normal size and an edit moves
only the boundaries near it. A fingerprint is the sorted set of chunk digests, each with its length;
one document's containment in another is the length of its chunks found there over the length of
all its chunks.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

LEAST, NORMAL, MOST = 16, 32, 128
#: Masks of the gear hash's high bits: one position in 64 before the normal size, one in 16 after it.
HARD, EASY = np.uint32(0xFC000000), np.uint32(0xF0000000)
WINDOW = 32
#: Text in one task of the pass over neighbours, and the most tasks a table is cut into.
TASK_BYTES = 24 << 20
MOST_TASKS = 10_000

GEAR = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Sum of the table's entries of the last 32 bytes, each shifted by its age, for every position."""
    value = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        value[width:] = value[width:] + (value[:-width] << np.uint32(width))
    return value


def cut(hard: list[int], easy: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes from ``start`` to ``end``, given where the masks hold."""
    ends = []
    while end - start > LEAST:
        at = bisect_left(hard, start + LEAST)
        found = hard[at] if at < len(hard) else end
        if found >= start + NORMAL:
            at = bisect_left(easy, start + NORMAL)
            found = easy[at] if at < len(easy) else end
        start = min(found + 1, start + MOST, end)
        ends.append(start)
    if start < end:
        ends.append(end)
    return ends


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct chunks of each text: 52 bits of digest over 12 bits of length."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = bytes(WINDOW)  # a fixed window before each text: its chunks don't depend on its neighbours
    data = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), np.uint8)
    if not len(data):
        return []
    value = gear(data)
    hard, easy = np.flatnonzero((value & HARD) == 0), np.flatnonzero((value & EASY) == 0)
    starts, ends, first = [], [], [0]
    base = 0
    for r in raw:
        base += WINDOW
        stop = base + len(r)
        h = hard[np.searchsorted(hard, base) : np.searchsorted(hard, stop)].tolist()
        e = easy[np.searchsorted(easy, base) : np.searchsorted(easy, stop)].tolist()
        own = cut(h, e, base, stop)
        starts += [base, *own[:-1]] if own else []
        ends += own
        first.append(len(ends))
        base = stop
    begin, stop = np.array(starts, np.int64), np.array(ends, np.int64)
    digest = common.range_hashes(data, begin, stop)
    packed = (digest & ~np.uint64(0xFFF)) | (stop - begin).astype(np.uint64)
    return [np.unique(packed[a:b]) for a, b in zip(first, first[1:])]


def weight(chunks: np.ndarray) -> int:
    return int((chunks & np.uint64(0xFFF)).sum())


def containment(one: np.ndarray, other: np.ndarray) -> float:
    """Share of ``one`` found in ``other`` by length; an empty text is contained in an empty text only."""
    if not len(one):
        return float(not len(other))
    return weight(np.intersect1d(one, other, assume_unique=True)) / weight(one)


def written(chunks: np.ndarray) -> str:
    """A fingerprint as text: base64 of its big-endian chunks."""
    return base64.b64encode(chunks.astype(">u8").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, key: str) -> DataFrame:
    """``bucket, ahead, key, text``: documents in runs of ascending keys, each run followed by its successor.

    Runs are cut at values of the key that occur, so the document after a run is known beforehand: the
    one the next run begins with, which is sent to both. Texts are shuffled once. Null keys come first.
    """
    base = docs.select(F.col(key).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    bytes_, rows, nulls, low = base.agg(
        F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count_if(F.col("key").isNull()), F.min("key")).first()
    tasks = int(min(MOST_TASKS, max(1, (bytes_ or 0) // TASK_BYTES, (rows or 0) // 100_000)))
    points: list[float] = []
    if tasks > 1 and low is not None:
        found = base.agg(F.percentile_approx("key", [n / tasks for n in range(1, tasks)], 20 * tasks)).first()[0]
        points = sorted({float(p) for p in found if p > low})
    splits = [float("-inf"), *points, float("inf")]
    # Null keys share the first run and sort before everything in it.
    place = F.coalesce(F.col("key").cast("double"), F.lit(float(low or 0)))
    runs = base.withColumn("place", place)
    if points:
        runs = Bucketizer(splits=splits, inputCol="place", outputCol="run", handleInvalid="error").transform(runs)
    else:
        runs = runs.withColumn("run", F.lit(0))
    runs = runs.withColumn("run", F.col("run").cast("int"))
    leads = F.col("place").isin(points) if points else F.lit(False)
    begins = F.col("key").isNull() if nulls else F.col("key") == F.lit(low)
    homes = F.filter(F.array(
        F.struct(F.col("run").alias("bucket"), F.lit(0).alias("ahead")),
        F.when(leads & F.col("key").isNotNull(), F.struct((F.col("run") - 1).alias("bucket"), F.lit(1).alias("ahead"))),
        F.when(begins, F.struct(F.lit(len(points)).alias("bucket"), F.lit(2).alias("ahead")))), lambda h: h.isNotNull())
    dealt = runs.select("key", "text", F.explode(homes).alias("home")).select("home.bucket", "home.ahead", "key", "text")
    return dealt.repartition(len(points) + 1, "bucket").sortWithinPartitions("bucket", "ahead", F.col("key").asc_nulls_first(), "text")


RESULT = ("key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def compared(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit with the next text, and how like the first is to both.

    ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Documents
    follow each other by ``key`` (an integer), nulls first, ties by text; after the last comes the
    first. A null text reads as empty; an empty text has the empty fingerprint, contained in the empty
    one only. Repeated rows are reported once each. Other columns are not read.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last document seen: bucket, ahead, key, text, chunks
        for batch in batches:
            for piece in common.slices(batch, "text", 1 << 20):
                rows = list(zip(*(piece.column(c).to_pylist() for c in ("bucket", "ahead", "key", "text"))))
                chunks = fingerprints([r[3] for r in rows])
                rows = held + [(*r, c) for r, c in zip(rows, chunks)]
                held = rows[-1:]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
                changed = [edited(a[3], b[3]) for a, b in pairs]
                marks = fingerprints(changed)
                if pairs:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                        pa.array([written(a[4]) for a, _ in pairs], pa.string()),
                        pa.array([written(m) for m in marks], pa.string()),
                        pa.array([containment(a[4], m) for (a, _), m in zip(pairs, marks)], pa.float64()),
                        pa.array([containment(a[4], b[4]) for a, b in pairs], pa.float64())],
                        [c.split()[0] for c in RESULT.split(", ")])

    return neighbours(docs, key).mapInArrow(work, RESULT).withColumnRenamed("key", key)
