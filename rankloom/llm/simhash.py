"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile by tile.

1. Each word shingle of a text is hashed by XXH64; a bit of the fingerprint is set where over half of
   the hashes have it. Texts with equal fingerprints are one class from here on.
2. The numbers of ones in the four quarters of a fingerprint are its cell: 17**4 = 83,521 cells at
   most, however large the table is. Their counts cut the space of cells into boxes of about
   ``TILE_ROWS`` classes; a single cell with more is dealt over several tiles by a hash.
3. Bits that differ change population counts by as much at most, so tile pairs whose boxes are further
   apart than the radius never meet. A tile travels as one row, to each tile it has to meet; a task holds
   two tiles.
4. A pair of tiles is compared in blocks by exclusive-or and bit counts, again skipping blocks that are
   too far apart by the counts of their bytes. What links two classes that are not yet tied is kept, so a
   tile pair yields fewer links than it has classes.
5. Links become components by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import session
from rankloom.llm import common, ngram_join
from rankloom.operators import ordering

WIDTH = 4
RADIUS = 4
SEED = 42
#: Classes of a tile.
TILE_ROWS = 8192
#: Rows and columns compared at once inside a tile pair.
BLOCK_ROWS = 128
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15
QUARTERS = 4
LEVELS = 17


def fingerprints(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text; zero where it has no words."""
    words = common.find_words(*common.text_bytes(column), common.BLANK_SEPARATED)
    counts = np.diff(words.first)
    grams = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
    votes = np.zeros((len(counts), 64), np.int64)
    # Words with the blank behind each, if any, as one: a shingle is one range of this.
    inside = common.BLANK_SEPARATED[1][words.data]
    behind = np.zeros(len(inside), bool)
    behind[1:] = inside[:-1] & ~inside[1:]
    text = np.where(inside, words.data, np.uint8(0x20))[inside | behind].tobytes()
    sizes, apart = words.ends - words.starts, np.append(behind, False)[words.ends]
    begin = np.cumsum(sizes + apart) - sizes - apart
    end = begin + sizes
    owner = np.repeat(np.arange(len(counts)), grams)
    first = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    last = first + np.minimum(width, counts[owner]) - 1
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(owner), COUNTED):
        some = owner[low : low + COUNTED]
        hashes = np.fromiter(
            (digest(text[a:b], SEED) for a, b in zip(
                begin[first[low : low + COUNTED]].tolist(), end[last[low : low + COUNTED]].tolist())),
            np.uint64, len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        runs = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        votes[some[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int64)
    ones = 2 * votes > grams[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprinted(docs: DataFrame, key: str, width: int) -> DataFrame:
    """``key, fp`` of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text"):
                found = fingerprints(piece.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), pa.array(found.view(np.int64))], ["key", "fp"])

    narrow = docs.select(F.col(key).alias("key"), "text")
    return narrow.mapInArrow(common.released(work), f"key {docs.schema[key].dataType.simpleString()}, fp long")


def cell() -> str:
    """A fingerprint's cell: the population counts of its quarters as digits."""
    return "+".join(f"bit_count(shiftrightunsigned(fp, {16 * q}) & 65535L) * {LEVELS ** q}" for q in range(QUARTERS))


def digits(cells: np.ndarray) -> np.ndarray:
    return np.stack([cells // LEVELS ** q % LEVELS for q in range(QUARTERS)], axis=1)


class Tiles:
    """Boxes of cells, each with its bounds, its number of tiles, and the number of its first tile."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, rows: int):
        low, high, tiles = [], [], []
        open_boxes = [np.arange(len(cells))] if len(cells) else []
        place = digits(cells)
        while open_boxes:
            own = open_boxes.pop()
            spread = place[own].max(axis=0) - place[own].min(axis=0)
            held = int(counts[own].sum())
            if held <= rows or not spread.any():
                low.append(place[own].min(axis=0))
                high.append(place[own].max(axis=0))
                tiles.append(-(-held // rows))
                continue
            axis = int(np.argmax(spread))
            by = own[np.argsort(place[own, axis], kind="stable")]
            value = place[by, axis]
            half = value[min(len(by) - 1, int(np.searchsorted(np.cumsum(counts[by]), held / 2)))]
            half = min(max(half, value[0]), value[-1] - 1)
            open_boxes += [by[value > half], by[value <= half]]
        self.low = np.array(low, np.int16).reshape(-1, QUARTERS)
        self.high = np.array(high, np.int16).reshape(-1, QUARTERS)
        self.tiles = np.array(tiles, np.int64)
        self.first = np.cumsum(self.tiles) - self.tiles

    def homes(self, cells: np.ndarray, lots: np.ndarray) -> np.ndarray:
        """The tile of each class: the box around its cell (boxes are disjoint), and a lot among the box's tiles."""
        known, which = np.unique(cells, return_inverse=True)
        boxes = np.zeros(len(known), np.int64)
        step = max(1, (1 << 20) // max(1, len(self.tiles)))
        for begin in range(0, len(known), step):
            place = digits(known[begin : begin + step])
            boxes[begin : begin + step] = np.argmin(self.gaps(place, place), axis=1)
        home = boxes[which]
        return self.first[home] + lots % self.tiles[home]

    def gaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least difference of population counts between anything within each of these bounds and in each box."""
        low, high = low.astype(np.int16)[:, None, :], high.astype(np.int16)[:, None, :]
        return np.maximum(0, np.maximum(self.low - high, low - self.high)).sum(axis=2)

    def met(self, tile: int, radius: int) -> np.ndarray:
        """The tiles that ``tile`` has to be compared with, itself included."""
        box = int(np.searchsorted(self.first, tile, side="right")) - 1
        near = np.flatnonzero(self.gaps(self.low[box : box + 1], self.high[box : box + 1])[0] <= radius)
        return np.concatenate([self.first[b] + np.arange(self.tiles[b]) for b in near])


def _blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``values``: their first rows, and bounds of the population counts of their bytes."""
    ones = np.bitwise_count(values.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    first = np.arange(0, len(values), BLOCK_ROWS)
    return first, np.minimum.reduceat(ones, first, axis=0), np.maximum.reduceat(ones, first, axis=0)


def _ordered(values: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(values.view(np.uint8).reshape(-1, 8))
    return values[np.lexsort(ones.T)]


def ties(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together all of ``left`` and ``right`` that is within ``radius``; without ``right``, of ``left`` alone."""
    left = _ordered(left)
    nodes, shift = left, 0
    if right is not None:
        right = _ordered(right)
        nodes, shift = np.concatenate([left, right]), len(left)
    else:
        right = left
    label = np.arange(len(nodes))
    if not len(left) or not len(right):
        return nodes[:0], nodes[:0]
    a_first, a_low, a_high = _blocks(left)
    b_first, b_low, b_high = _blocks(right)
    for nth, begin in enumerate(a_first.tolist()):
        gap = np.maximum(0, np.maximum(b_low - a_high[nth], a_low[nth] - b_high)).sum(axis=1)
        close = np.flatnonzero((gap <= radius) & (True if shift else b_first >= begin))
        rows = np.arange(begin, min(begin + BLOCK_ROWS, len(left)))
        for some in np.array_split(close, max(1, len(close) // 32)):
            columns = np.concatenate([np.arange(f, min(f + BLOCK_ROWS, len(right))) for f in b_first[some]] or [rows[:0]])
            near = np.bitwise_count(left[rows, None] ^ right[None, columns]) <= radius
            open_rows = np.flatnonzero((near & (label[shift + columns][None, :] != label[rows][:, None])).any(axis=1))
            for row in open_rows.tolist():
                met = np.append(label[shift + columns[near[row]]], label[rows[row]])
                lowest = met.min()
                if met.max() > lowest:
                    moved = np.arange(len(nodes))
                    moved[met] = lowest
                    label = moved[label]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def links(classes: DataFrame, radius: int, rows: int) -> DataFrame:
    """``a, b``: enough of the pairs of ``classes(fp)`` within ``radius`` to have the same components."""
    spark = classes.sparkSession
    counted = classes.groupBy(F.expr(cell()).alias("cell")).count().collect()  # at most 17**4 rows
    tiles = spark.sparkContext.broadcast(Tiles(
        np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.int64), rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp")
            lots = (common.mix(fp.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(1)).astype(np.int64)
            home = tiles.value.homes(batch.column("cell").to_numpy(zero_copy_only=False).astype(np.int64), lots)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), fp], ["tile", "fp"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.column("tile").to_pylist():
                other = tiles.value.met(tile, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(other), tile), pa.int32()), pa.array(np.minimum(tile, other), pa.int32()),
                     pa.array(np.maximum(tile, other), pa.int32())], ["own", "a", "b"])

    def compare(group: pa.Table) -> pa.Table:
        held = {own: np.array(fp, np.int64).view(np.uint64) for own, fp in zip(
            group.column("own").to_pylist(), group.column("fps").to_pylist())}
        one, other = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        found = ties(held[one], None if one == other else held[other], radius)
        return pa.table([pa.array(x.view(np.int64)) for x in found], names=["a", "b"])

    placed = classes.select("fp", F.expr(cell()).alias("cell")).mapInArrow(common.released(place), "tile int, fp long")
    # A tile holds about ``rows`` classes.
    held = session.stage(placed.groupBy("tile").agg(F.collect_list("fp").alias("fps")))
    sides = held.select("tile").mapInArrow(pair, "own int, a int, b int")
    dealt = sides.join(held, F.col("own") == F.col("tile")).select("a", "b", "own", "fps")
    return dealt.groupBy("a", "b").applyInArrow(compare, "a long, b long")


def linked(docs: DataFrame, key: str = "doc_id", width: int = WIDTH, radius: int = RADIUS,
           tile_rows: int = TILE_ROWS) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest key reachable over links.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Null keys count
    only where a component has no other. Repeated rows are reported once each. An empty table gives an
    empty one. Other columns are neither read nor returned.
    """
    rows = session.stage(fingerprinted(docs, key, width))
    classes = session.stage(rows.groupBy("fp").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")))
    roots = ngram_join.components(docs.sparkSession, links(classes.select("fp"), radius, tile_rows))
    rooted = session.stage(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("held"))
    of_class = ordering.attach(rooted, smallest, ["root"], size="held").select("fp", "component_id", "n")
    found = ordering.attach(rows, of_class, ["fp"], size="n")
    return found.select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
