"""Similarity join on word n-grams: rare-first prefix filtering, each pair verified once.

1. One pass over the texts hashes every document's set of distinct shingles. Documents with equal
   sets fall into one class; from here on a class stands for its copies.
2. The same pass counts words in a fixed number of cells. A shingle is as common as the least common
   of its words' cells; ordering shingles rare-first by that bound is a total order, so prefix
   filtering stays exact however coarse the cells become.
3. Seeds: classes sharing one of a few minimum hashes are each compared with one hub of that group.
   This ties up large groups of near copies with one comparison per class instead of one per pair.
4. Postings: the prefix of a class has ``|x| - ceil(t |x|) + REPEATS`` shingles, so a linked pair
   shares at least ``REPEATS`` prefix shingles. A few times, every shingle's classes are compared
   with one hub, another each time: families of near copies grow together at a cost in proportion
   to the postings.
5. Candidates: classes still in different components are joined on their prefix shingles under the
   length, positional and suffix filters. The suffix filter bounds the symmetric difference by the
   parities of the shingles in 512 cells.
6. Pairs left pass the suffix filter again, now over parities whose cells grow with the set, so that
   long sets that meet by chance are told apart without reading them. The rest are verified on their
   whole sets, and components follow by alternating star contraction.

Two classes that are already connected need no further comparison, which loses no component: every
linked pair is either compared or lies within one component. The largest component at a shingle is
never joined with itself, so a group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from rankloom import session
from rankloom.llm import common

#: Cells that word counts are kept in (a power of two); the table sent to the executors has one
#: number for each.
CELLS = 1 << 16
SEEDS = 4
REPEATS = 4
#: Times each prefix shingle's classes are compared with a hub before all remaining pairs are formed.
HUB_ROUNDS = 2
#: Shingles of a set up to which the suffix filter alone tells chance meetings from near copies.
SUFFIX_REACH = 900
#: 64-bit words of the suffix filter's parities, and of the filter that picks texts to verify.
PARITY_WORDS = 8
PICK_WORDS = 1 << 15


def by_owner(order: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``order`` regrouped by owner, otherwise unchanged."""
    narrow = owner[order]
    if len(narrow) and narrow.max() < 1 << 16:
        narrow = narrow.astype(np.uint16)  # sorted by radix
    return order[np.argsort(narrow, kind="stable")]


class Shingles:
    """Distinct shingles of each text of a batch: sorted hashes ``values[first[i]:first[i + 1]]``."""

    def __init__(self, column: pa.Array, width: int):
        words = common.find_words(*common.text_bytes(column), common.BLANK_SEPARATED)
        self.words, self.word = words, words.hashes()
        counts = np.diff(words.first)
        grams = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
        owner = np.repeat(np.arange(len(counts)), grams)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + words.first[owner]
        size = np.minimum(width, counts)[owner]
        value = np.zeros(len(owner), np.uint64)
        for step in range(width):
            here = np.minimum(at + step, max(0, len(self.word) - 1))
            held = size > step
            value = np.where(held, common.mix(value * np.uint64(3) + self.word[here] + np.uint64(step + 1)), value)
        order = by_owner(np.argsort(value), owner)
        value, owner, at = value[order], owner[order], at[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner, self.at = value[fresh], owner[fresh], at[fresh]
        self.size = size[order][fresh]
        self.first = np.searchsorted(self.owner, np.arange(len(counts) + 1))
        self.counts = np.diff(self.first)

    def summed(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit digests of each set."""
        salted = common.mix(self.values ^ np.uint64(0x5851F42D4C957F2D))
        size = self.counts.astype(np.uint64)
        return (common.mix(self.summed(salted) + size).view(np.int64),
                common.mix(self.summed(common.mix(salted + np.uint64(7))) ^ size).view(np.int64))

    def minima(self, count: int) -> np.ndarray:
        out = np.zeros((len(self.counts), count), np.int64)
        held = self.counts > 0
        for nth in range(count):
            value = common.mix(self.values + np.uint64(0xA0761D6478BD642F * (nth + 1) % (1 << 64)))
            if len(value):
                out[held, nth] = np.minimum.reduceat(value, self.first[:-1][held]).view(np.int64)
        return out

    def parities(self) -> np.ndarray:
        """Parity of the number of shingles in each of 64 * PARITY_WORDS cells, packed."""
        cell = (common.mix(self.values + np.uint64(99)) % np.uint64(64 * PARITY_WORDS)).astype(np.int64)
        bits = np.bincount(self.owner * 64 * PARITY_WORDS + cell, minlength=len(self.counts) * 64 * PARITY_WORDS) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(self.counts), 64 * PARITY_WORDS), axis=1)
        return np.ascontiguousarray(packed).view(np.int64)

    def wide_parities(self) -> tuple[np.ndarray, np.ndarray]:
        """The same over two to four cells a shingle, a power of two; empty where ``parities`` has as many.

        Words of a set, and each set's first word. Cells are the low bits of one hash, so the two halves
        of a set's words, one xor the other, are its parities over half as many cells.
        """
        wanted = np.maximum(2 * self.counts, 1)
        cells = np.int64(1) << np.ceil(np.log2(wanted)).astype(np.int64)
        cells = np.where(cells > 64 * PARITY_WORDS, cells, 0)
        start = np.concatenate([[0], np.cumsum(cells)])
        held = cells[self.owner] > 0
        owner = self.owner[held]
        low = common.mix(self.values[held] + np.uint64(101)) & (cells[owner] - 1).astype(np.uint64)
        bits = np.bincount(start[owner] + low.astype(np.int64), minlength=start[-1]) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.int64), start // 64


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def _rows(matrix: np.ndarray) -> pa.Array:
    return _lists(matrix.reshape(-1), np.arange(len(matrix) + 1) * matrix.shape[1])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (``cell`` null), and rows (``cell``, ``n``) counting words by cell."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["key", "text_hash", "n", "h1", "h2", "minima", "parity", "wide", "cell"]
        for batch in batches:
            for piece in common.slices(batch, "text"):
                sets = Shingles(piece.column("text"), width)
                cells += np.bincount((sets.word & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                h1, h2 = sets.digests()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("text_hash"), pa.array(sets.counts, pa.int64()),
                     pa.array(h1), pa.array(h2), _rows(sets.minima(SEEDS)), _rows(sets.parities()),
                     _lists(*sets.wide_parities()),
                     pa.nulls(piece.num_rows, pa.int32())], names)
        used = np.flatnonzero(cells)
        if len(used):
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(used), kind), none, pa.array(cells[used]), none, none,
                 *[pa.nulls(len(used), pa.list_(pa.int64()))] * 3, pa.array(used, pa.int32())], names)

    simple = docs.schema["key"].dataType.simpleString()
    kind = pa.int64() if simple == "bigint" else pa.string()
    return docs.mapInArrow(common.released(work), f"key {simple}, text_hash long, n long, h1 long, h2 long, "
                                 "minima array<long>, parity array<long>, wide array<long>, cell int")


def prefixes(docs: DataFrame, width: int, numerator: int, denominator: int, commonness) -> DataFrame:
    """Rare-first prefix of every distinct set of a task: ``h1, h2, prefix``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for piece in common.slices(batch, "text"):
                sets = Shingles(piece.column("text"), width)
                h1, h2 = sets.digests()
                fresh = np.zeros(len(h1), bool)
                for nth, key in enumerate(zip(h1.tolist(), h2.tolist())):
                    if sets.counts[nth] and key not in seen:
                        seen.add(key)
                        fresh[nth] = True
                cell = commonness.value[(sets.word & np.uint64(CELLS - 1)).astype(np.int64)] if len(sets.word) else None
                rank = np.zeros(len(sets.values), np.int64)
                for step in range(width if len(sets.values) else 0):
                    here = cell[np.minimum(sets.at + step, len(sets.word) - 1)]
                    rank = np.where(sets.size > step, here if not step else np.minimum(rank, here), rank)
                # Equal shingles have equal ranks, so all sets are ordered alike; sixteen bits of a
                # float keep ranks apart to under a hundredth.
                coarse = (rank.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)
                order = by_owner(np.argsort(coarse, kind="stable"), sets.owner)
                n = sets.counts
                need = -(-n * numerator // denominator)
                take = np.where(fresh, np.minimum(n, n - need + REPEATS), 0)
                place = np.arange(len(order)) - np.repeat(sets.first[:-1], n)
                chosen = order[place < np.repeat(take, n)]
                keep = np.flatnonzero(fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[keep]), pa.array(h2[keep]),
                     _lists(sets.values[chosen].view(np.int64), np.concatenate([[0], np.cumsum(take[keep])]))],
                    ["h1", "h2", "prefix"])

    return docs.select("text").mapInArrow(common.released(work), "h1 long, h2 long, prefix array<long>")


def picked_sets(docs: DataFrame, width: int, picks) -> DataFrame:
    """Whole sets of the texts that ``picks`` (a filter without false negatives) lets through."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            value = batch.column("text_hash").to_numpy(zero_copy_only=False).view(np.uint64)
            bit = value % np.uint64(PICK_WORDS * 64)
            held = (picks.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(held.astype(bool)))
            for piece in common.slices(batch, "text"):
                sets = Shingles(piece.column("text"), width)
                h1, h2 = sets.digests()
                keep = []
                for nth, key in enumerate(zip(h1.tolist(), h2.tolist())):
                    if key not in seen:
                        seen.add(key)
                        keep.append(nth)
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), _lists(sets.values.view(np.int64), sets.first)],
                    ["h1", "h2", "shingles"])
                yield whole.take(pa.array(keep, pa.int64()))

    return docs.select("text", "text_hash").mapInArrow(common.released(work), "h1 long, h2 long, shingles array<long>")


def alpha(a: str, b: str, numerator: int, denominator: int) -> str:
    """Least intersection of two linked sets of sizes ``a`` and ``b``."""
    return f"CAST(ceil({numerator} * ({a} + {b}) / {numerator + denominator}) AS BIGINT)"


def long_enough(a: str, b: str, numerator: int, denominator: int) -> str:
    return f"{denominator} * least({a}, {b}) >= {numerator} * greatest({a}, {b})"


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links(a, b)``, by alternating star contraction.

    Every round is written to the shared folder, and what tells whether it changed anything is observed
    while it is written: each query more costs the driver memory. Nodes meet only a minimum, never a list
    of their neighbours, so a hub may have any number of links.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        seen = Observation()
        edges = session.stage(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                              .union(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
                              .observe(seen, F.count(F.lit(1)).alias("edges"),
                                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")))
        now = seen.get
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


class Join:
    """The classes of equal sets of one table, and the links between them."""

    def __init__(self, docs: DataFrame, width: int, numerator: int, denominator: int):
        self.docs, self.width, self.numerator, self.denominator = docs, width, numerator, denominator
        self.spark = docs.sparkSession
        self.hashed = docs.withColumn("text_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
        self.signed = session.stage(signatures(self.hashed, width))
        of_docs = self.signed.where("cell IS NULL AND n > 0")
        self.classes = session.stage(
            of_docs.groupBy("h1", "h2").agg(
                F.min("text_hash").alias("text_hash"), F.first("n").alias("n"),
                F.first("minima").alias("minima"), F.first("parity").alias("parity"))
            .withColumn("id", F.monotonically_increasing_id()))
        # Many times as wide as a class, and read for the few pairs that are left: a table of its own.
        self.wide = session.stage(
            self.classes.select("id", "h1", "h2", "n").join(
                of_docs.groupBy("h1", "h2").agg(F.first("wide").alias("wide")), ["h1", "h2"]).select("id", "n", "wide"))

    def commonness(self):
        counts = np.zeros(CELLS, np.int64)
        for cell, n in self.signed.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n")).collect():
            counts[cell] = n  # at most CELLS rows
        return self.spark.sparkContext.broadcast(counts)

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The ones of ``pairs(a, b)`` that the suffix filter over wide parities lets through."""
        def halved(x: str, y: str) -> str:
            half = f"slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y}))"
            return f"CASE WHEN size({x}) > size({y}) THEN zip_with({half}, (u, v) -> u ^ v) ELSE {x} END"

        least = alpha("n_a", "n_b", self.numerator, self.denominator)
        apart = f"zip_with({halved('w_a', 'w_b')}, {halved('w_b', 'w_a')}, (u, v) -> bit_count(u ^ v))"
        known = "least(size(w_a), size(w_b)) > 0 AND greatest(size(w_a), size(w_b)) <= 2 * least(size(w_a), size(w_b))"
        p = self.wide.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("w_a"))
        q = self.wide.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("w_b"))
        return session.stage(pairs.join(p, "a").join(q, "b").where(
            f"CASE WHEN {known} THEN aggregate({apart}, 0, (s, c) -> s + c) <= n_a + n_b - 2 * {least} ELSE true END")
            .select("a", "b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs(a, b)``: whole sets travel once to their class, once to each ``b`` they meet."""
        pairs = self.plausible(pairs)
        wanted = pairs.select(F.col("a").alias("id"), "b").union(pairs.select("b", "b")).distinct()
        wanted = session.stage(wanted.join(self.classes, "id").select("id", "b", "h1", "h2", "text_hash", "n"))
        bit = F.expr(f"pmod(text_hash, {PICK_WORDS * 64})")
        # A hash is read as unsigned by the tasks; for a power of two pmod gives the same cell.
        words = np.zeros(PICK_WORDS, np.uint64)
        for word, bits in (wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
                           .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))"))).collect()):
            words[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)  # at most PICK_WORDS rows
        if not words.any():
            return pairs
        sets = picked_sets(self.hashed, self.width, self.spark.sparkContext.broadcast(words)).dropDuplicates(["h1", "h2"])
        left = sets.join(wanted.where("id <> b"), ["h1", "h2"]).select(
            F.col("id").alias("a"), "b", F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
        right = sets.join(wanted.where("id = b"), ["h1", "h2"]).select(
            "b", F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
        shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        compared = left.join(right, "b").withColumn("shared", shared)
        return session.stage(compared.where(
            f"{self.denominator} * shared >= {self.numerator} * (n_a + n_b - shared)").select("a", "b"))

    def seeds(self) -> DataFrame:
        """Each class beside the hub of every group of equal minima it is in."""
        groups = self.classes.select("id", "n", F.posexplode("minima").alias("nth", "least"))
        hubs = (groups.groupBy("nth", "least").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("held"))
                .where("held > 1").select("nth", "least", F.col("hub.id").alias("b"), F.col("hub.n").alias("n_b")))
        return session.stage(
            groups.join(hubs, ["nth", "least"]).where("id <> b")
            .where(long_enough("n", "n_b", self.numerator, self.denominator))
            .select(F.col("id").alias("a"), "b").distinct())

    def postings(self) -> DataFrame:
        """``gram, id, n, place`` of all prefix shingles that at least two classes have."""
        heads = prefixes(self.hashed, self.width, self.numerator, self.denominator, self.commonness())
        heads = self.classes.select("h1", "h2", "id", "n").join(
            heads.groupBy("h1", "h2").agg(F.first("prefix").alias("prefix")), ["h1", "h2"])
        posts = heads.select("id", "n", F.posexplode("prefix").alias("place", "gram")).repartition(F.col("gram"))
        # A class has a shingle once. All columns are read on both sides, so that one exchange serves both.
        held = (posts.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("n").alias("n"),
                                          F.min("place").alias("place"))
                .where("low < high AND n > 0 AND place >= 0").select("gram"))
        return session.stage(posts.join(held, "gram").select("gram", "id", "n", "place"))

    def rooted(self, posts: DataFrame, roots: DataFrame) -> DataFrame:
        return posts.join(roots, F.col("id") == F.col("node"), "left").select(
            "gram", "id", "n", "place", F.coalesce("root", "id").alias("root"))

    def near(self, a: str, b: str) -> str:
        """The length and positional filters on two postings of one shingle."""
        least = alpha(f"n_{a}", f"n_{b}", self.numerator, self.denominator)
        return (f"{long_enough(f'n_{a}', f'n_{b}', self.numerator, self.denominator)} AND "
                f"least(p_{a}, p_{b}) + 1 + least(n_{a} - p_{a} - 1, n_{b} - p_{b} - 1) >= {least}")

    def suffix(self) -> str:
        """The suffix filter: parities of shared cells differ no more often than two linked sets may."""
        least = alpha("n_a", "n_b", self.numerator, self.denominator)
        apart = " + ".join(f"bit_count(f_a[{w}] ^ f_b[{w}])" for w in range(PARITY_WORDS))
        return f"{apart} <= n_a + n_b - 2 * {least}"

    def hub_pairs(self, posts: DataFrame, roots: DataFrame, nth: int) -> DataFrame:
        """Each posting's class beside the hub of its shingle, where they are in different components."""
        every = self.rooted(posts, roots)
        hubs = every.groupBy("gram").agg(
            F.min_by(F.struct("id", "n", "place", "root"), F.xxhash64("gram", "id", F.lit(nth))).alias("hub"),
            (F.min("root") < F.max("root")).alias("open")).where("open")
        met = every.join(hubs, "gram").where("root <> hub.root").select(
            F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"),
            F.col("hub.id").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.place").alias("p_b"))
        # Long sets meet by chance and the suffix filter cannot see it: they have to meet repeatedly.
        pairs = (met.where(self.near("a", "b")).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("met"))
                 .where(f"met >= 2 OR n_a + n_b <= {2 * SUFFIX_REACH}"))
        p = self.classes.select(F.col("id").alias("a"), F.col("parity").alias("f_a"))
        q = self.classes.select(F.col("id").alias("b"), F.col("parity").alias("f_b"))
        return session.stage(pairs.join(p, "a").join(q, "b").where(self.suffix())
                             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def candidates(self, posts: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of classes in different components that pass every filter."""
        every = self.rooted(posts, roots).repartition(F.col("gram"))
        # The component that holds most of a shingle's classes is joined with the others only.
        held = every.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("held"))
        most = (held.groupBy("gram").agg(F.max_by("root", F.struct("held", "root")).alias("most"), F.count(F.lit(1)).alias("kinds"))
                .where("kinds > 1").select("gram", "most"))
        every = every.join(most, "gram").join(self.classes.select("id", "parity"), "id")
        every = session.stage(every.select("gram", "most", "id", "n", "place", "root", "parity"))
        x = every.where("root <> most").select(
            "gram", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"), F.col("place").alias("p_a"),
            F.col("parity").alias("f_a"))
        y = every.select(
            "gram", "most", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("r_b"), F.col("place").alias("p_b"),
            F.col("parity").alias("f_b"))
        met = x.join(y, (x["gram"] == y["gram"]) & F.expr(
            f"r_a <> r_b AND (r_b = most OR a < b) AND {self.near('a', 'b')} AND {self.suffix()}"))
        # A pair shares as many prefix shingles as rows meet here; short sets share all they have.
        need = F.expr(f"least({REPEATS}, {alpha('n_a', 'n_b', self.numerator, self.denominator)})")
        return session.stage(
            met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), need.alias("need"))
            .groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("shared")).where("shared >= need").select("a", "b"))


def linked(docs: DataFrame, key: str = "doc_id", width: int = 3, numerator: int = 9, denominator: int = 10) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` of every row of ``docs``.

    A document's set is its distinct shingles of ``width`` words (fewer words: all of them as one).
    Documents link when ``denominator * |x & y| >= numerator * |x | y|``. ``component_id`` is the
    smallest key reachable over links; null keys count only where a component has no other.

    Null, empty and wordless texts have an empty set and are linked with nothing: their component is
    their own key. Repeated rows are reported once each. Other columns are neither read nor
    returned. Keys are integers or strings.
    """
    kind = docs.schema[key].dataType
    found = _linked(docs.select(plain_key(docs, key).alias("key"), "text"), width, numerator, denominator)
    return found.select(F.col("key").cast(kind).alias(key), "n_shingles", F.col("component_id").cast(kind).alias("component_id"))


def plain_key(docs: DataFrame, key: str):
    integral = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col(key).cast("bigint" if integral else "string")


def _linked(docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    join = Join(docs, width, numerator, denominator)
    roots = components(join.spark, join.verified(join.seeds()))
    posts = join.postings()
    for nth in range(HUB_ROUNDS + 1):
        more = join.verified(join.hub_pairs(posts, roots, nth) if nth < HUB_ROUNDS else join.candidates(posts, roots))
        if not more.isEmpty():
            roots = components(join.spark, roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    classes = join.classes.join(roots, F.col("id") == F.col("node"), "left").select(
        "h1", "h2", F.coalesce("root", "id").alias("root"))
    rows = join.signed.where("cell IS NULL").select("key", "text_hash", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    rows = session.stage(rows)
    smallest = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("key").alias("smallest"))
    return rows.join(smallest, "root", "left").select(
        "key", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("smallest", "key").alias("component_id"))


@common.shielded
def deduplicated(docs: DataFrame, key: str = "doc_id", width: int = 5, numerator: int = 8, denominator: int = 10) -> DataFrame:
    """One document of each component: the one with the smallest key, all columns kept.

    Documents with an empty set are never near copies of anything and stay. Repeated rows with one
    key and one text leave one; rows without a key stay only if nothing they link with has one.
    """
    found = _linked(docs.select(plain_key(docs, key).alias("key"), "text"), width, numerator, denominator)
    # Key and text together, as two hashes that are never null: one shuffle serves join and window.
    pair = F.xxhash64("key", "text_hash")
    kept = (found.where("n_shingles > 0").groupBy("component_id")
            .agg(F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("text_hash"))).alias("best"))
            .select(F.col("best.key").alias("key"), F.col("best.text_hash").alias("text_hash"))
            .select(pair.alias("__pair"), F.col("text_hash").alias("__hash"), F.lit(True).alias("__one")))
    empty = (found.where("n_shingles = 0").select(pair.alias("__pair"), F.col("text_hash").alias("__hash"),
                                                  F.lit(False).alias("__one")).distinct())
    chosen = session.stage(kept.union(empty))
    hashed = docs.withColumn("__hash", F.coalesce(F.xxhash64("text"), F.lit(0))).withColumn(
        "__pair", F.xxhash64(plain_key(docs, key), "__hash"))
    ordered = [f"`{f.name}`" for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    nth = F.row_number().over(Window.partitionBy("__pair", "__hash").orderBy(*ordered))
    joined = hashed.join(chosen, ["__pair", "__hash"]).withColumn("__nth", nth)
    return joined.where("NOT __one OR __nth = 1").select(*(f"`{c}`" for c in docs.columns))
