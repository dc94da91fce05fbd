"""Benchmark decontamination with one FM-index per shard of documents.

The benchmark is cut into windows of ``width`` consecutive words (an item with fewer words is one
window). Each task indexes its documents, about ``SHARD_BYTES`` of text at a time: words become
symbols of the benchmark's vocabulary, every run of other words becomes one separator, a suffix
array gives the Burrows-Wheeler string, and a wavelet matrix answers ranks on it. All windows are
searched backwards together, occurrences are located by walking to the next sampled suffix
position, and the ranges found are merged per document.

No document leaves its task, so the job has no shuffle at all. What travels is the benchmark, in
blocks of at most ``BLOCK_WORDS`` words; beyond one block, documents are indexed once per block and
the spans of all passes are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

WIDTH = 10
#: Words of the benchmark sent to the executors at once (about 24 bytes each).
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 1 << 20
#: Every so many positions of a shard keep their place in the suffix array.
SAMPLING = 8


class Wavelet:
    """Wavelet matrix: ``rank`` counts a symbol before a position, ``access`` reads one.

    A level is a bit per position in 64-bit words, and the number of ones before each word.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before))
            self.zeros.append(len(symbols) - int(before[-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.bits = bits

    @staticmethod
    def ones_before(level: tuple[np.ndarray, np.ndarray], position: np.ndarray) -> np.ndarray:
        words, before = level
        word = position >> 6
        below = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``position``, for arrays of both."""
        low, high = np.zeros(len(position), np.int64), position
        for bit, level, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            one = ((symbol >> bit) & 1).astype(bool)
            at_low, at_high = self.ones_before(level, low), self.ones_before(level, high)
            low = np.where(one, zeros + at_low, low - at_low)
            high = np.where(one, zeros + at_high, high - at_high)
        return high - low

    def access(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(symbol, rank of that symbol before position)``."""
        symbol, low = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            at, at_low = self.ones_before(level, position), self.ones_before(level, low)
            one = (level[0][position >> 6] >> (position & 63).astype(np.uint64)) & np.uint64(1) > 0
            symbol = symbol * 2 + one
            position = np.where(one, zeros + at, position - at)
            low = np.where(one, zeros + at_low, low - at_low)
        return symbol, position - low


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes, each read up to its first separator (0); ties stand by position.

    Prefix doubling on packed keys. Only suffixes that still tie and have not met a separator are
    sorted again, so copies cost extra rounds and ordinary text does not.
    """
    count = len(symbols)
    place = max(1, int(count).bit_length())
    depth = max(1, (62 - place) // bits)
    key, live = np.zeros(count, np.int64), np.ones(count, bool)
    for step in range(depth):
        at = np.zeros(count, np.int64)
        at[: max(0, count - step)] = symbols[step:]
        at[~live] = 0
        key = (key << bits) | at
        live &= at > 0
    order = np.sort((key << place) | np.arange(count))
    position, key = order & ((1 << place) - 1), order >> place
    group = np.zeros(count, np.int64)  # a suffix's rank is where its group of equals begins
    fresh = np.flatnonzero(np.diff(key)) + 1
    group[fresh] = fresh
    rank = np.empty(count, np.int64)
    rank[position] = np.maximum.accumulate(group)
    while True:
        sizes = np.bincount(rank, minlength=count)
        tied = np.flatnonzero(live & (sizes[rank] > 1))
        if not len(tied):
            break
        then = rank[tied + depth]
        joint = rank[tied] * count + then
        by = np.argsort(joint, kind="stable")
        tied, joint = tied[by], joint[by]
        old = rank[tied]
        new_group = np.concatenate([[True], old[1:] != old[:-1]])
        new_key = np.concatenate([[True], joint[1:] != joint[:-1]])
        index = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(new_group, index, 0))
        sub = np.maximum.accumulate(np.where(new_key, index, 0))
        still = live.copy()
        still[tied] = live[tied + depth]
        rank[tied] = old + (sub - begin)
        live = still
        depth *= 2
    return np.argsort(rank, kind="stable")


class Index:
    """FM-index of symbol strings joined by separators."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.size = len(symbols)
        bits = max(1, int(alphabet).bit_length())
        order = suffix_array(symbols, bits)
        self.wavelet = Wavelet(symbols[order - 1], bits)  # what stands before each suffix
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        before = np.concatenate([[0], symbols[:-1]])
        kept = (order % SAMPLING == 0) | (before[order] == 0)
        self.kept, self.nth = kept, np.cumsum(kept) - 1
        self.position = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned ``patterns``; an empty range where one does not occur."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            active = np.flatnonzero((lengths > step) & (high > low))
            if not len(active):
                break
            symbol = patterns[active, width - 1 - step]
            base = self.below[symbol]
            low[active] = base + self.wavelet.rank(symbol, low[active])
            high[active] = base + self.wavelet.rank(symbol, high[active])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, walking backwards to a sampled one. No walk passes a separator."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        moving = np.flatnonzero(~self.kept[rows])
        while len(moving):
            symbol, rank = self.wavelet.access(rows[moving])
            rows[moving] = self.below[symbol] + rank
            steps[moving] += 1
            moving = moving[~self.kept[rows[moving]]]
        return self.position[self.nth[rows]] + steps


class Phrases:
    """The windows of one benchmark block, as symbols over the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        text = pa.array([t for _, t in items], pa.string())
        words = common.find_words(*common.text_bytes(text), common.ALPHANUMERIC)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        found: dict[tuple, list[int]] = {}
        for nth in range(len(items)):
            own = symbols[words.first[nth] : words.first[nth + 1]].tolist()
            for begin in range(max(1, len(own) - width + 1) if own else 0):
                holders = found.setdefault(tuple(own[begin : begin + width]), [])
                if not holders or holders[-1] != nth:
                    holders.append(nth)
        self.ids = [i for i, _ in items]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), width), np.int64)
        for row, window in enumerate(found):
            self.patterns[row, width - len(window) :] = window
        counts = np.array([len(h) for h in found.values()], np.int64)
        self.holder_start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.holders = np.array([x for h in found.values() for x in h], np.int64)


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), with the range each came from."""
    counts = high - low
    which = np.repeat(np.arange(len(low)), counts)
    return np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which], which


def scan(batch: pa.RecordBatch, phrases: Phrases) -> pa.RecordBatch:
    """Word counts, merged spans (in bytes and in words) and items of each document of one shard."""
    data, offsets = common.text_bytes(batch.column("text"))
    words = common.find_words(data, offsets, common.ALPHANUMERIC)
    documents = batch.num_rows
    counts = np.diff(words.first)
    owner = words.owner()
    symbols = np.zeros(len(owner), np.int32)
    if len(phrases.vocabulary) and len(owner):
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
        symbols = np.where(phrases.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
    # One separator for each run of foreign words and one behind every document.
    keep = symbols > 0
    keep[1:] |= symbols[:-1] > 0
    kept = np.flatnonzero(keep)
    last_known = np.flatnonzero((symbols > 0) & np.append(owner[1:] != owner[:-1], True)) if len(owner) else kept
    nth = np.searchsorted(kept, last_known) + 1
    string = np.insert(symbols[kept], nth, 0)
    word_at = np.insert(kept, nth, -1)
    begin = end = item = np.zeros(0, np.int64)
    if len(string) and len(phrases.lengths):
        index = Index(np.append(string, 0), len(phrases.vocabulary))
        low, high = index.search(phrases.patterns, phrases.lengths)
        rows, which = expand(low, np.maximum(low, high))
        begin = word_at[index.locate(rows)]
        end, item = begin + phrases.lengths[which], which
    change = np.bincount(begin, minlength=len(owner) + 1) - np.bincount(end, minlength=len(owner) + 1)
    hit = np.cumsum(change[: len(owner)]) > 0
    n_hit = np.bincount(owner[hit], minlength=documents) if len(owner) else np.zeros(documents, np.int64)
    # Neighbouring hit words of one document form one span.
    opens, closes = hit.copy(), hit.copy()
    if len(owner):
        same = owner[1:] == owner[:-1]
        opens[1:] &= ~(hit[:-1] & same)
        closes[:-1] &= ~(hit[1:] & same)
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    home = owner[first] if len(owner) else first
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(home, np.arange(documents + 1)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(words.starts[first] - offsets[home], pa.int64()),
             pa.array(words.ends[last] - offsets[home], pa.int64()),
             pa.array(first - words.first[home], pa.int64()),
             pa.array(last + 1 - words.first[home], pa.int64())], ["start", "end", "word", "word_end"]))
    pair = np.zeros(0, np.int64)
    if len(item):
        member, source = expand(phrases.holder_start[item], phrases.holder_start[item + 1])
        pair = np.unique(owner[begin[source]] * len(phrases.ids) + phrases.holders[member])
    items = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(pair // max(1, len(phrases.ids)), np.arange(documents + 1)), pa.int32()),
        pa.array([phrases.ids[i] for i in (pair % max(1, len(phrases.ids))).tolist()], pa.string()))
    return pa.RecordBatch.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), spans, items],
        ["n_words", "n_hit", "spans", "items"])


#: What a pass adds; the prefix keeps clear of the documents' own columns.
FOUND = ("__n_words long, __n_hit long, "
         "__spans array<struct<start:long,end:long,word:long,word_end:long>>, __items array<string>")
ADDED = ("n_words", "n_hit", "spans", "items")


def _pass(docs: DataFrame, items: list[tuple[str, str]], width: int) -> DataFrame:
    """``docs`` (with a column ``text``) and what one block of the benchmark finds in it."""
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases(items, width))
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text", SHARD_BYTES):
                found = scan(piece, phrases.value)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *found.columns],
                    [*piece.schema.names, *("__" + n for n in found.schema.names)])

    return docs.mapInArrow(common.released(work), f"{kinds}, {FOUND}")


def blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of about ``limit`` words; only one block is held at a time."""
    block, size = [], 0
    for item, text in benchmark.where("text IS NOT NULL").toLocalIterator():
        block.append((item, text))
        size += len(text) // 4 + 1
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(docs: DataFrame, benchmark: DataFrame, width: int, limit: int) -> DataFrame:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    passes = [_pass(docs, block, width) for block in blocks(items, limit)] or [_pass(docs, [], width)]
    if len(passes) == 1:
        return passes[0].withColumn("__items", F.array_sort(F.array_distinct("__items")))
    # Several blocks: each document meets itself once per block. Identical rows come together and
    # are dealt out again; words are numbered, so overlapping ranges are counted once.
    every = passes[0]
    for other in passes[1:]:
        every = every.unionByName(other)
    together = every.groupBy(*docs.columns, "__n_words").agg(
        F.flatten(F.collect_list("__spans")).alias("__spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("__times"))
    merged = F.expr("""
        aggregate(array_sort(__spans, (a, b) -> CAST(a.word - b.word AS INT)),
          cast(array() as array<struct<start:bigint,end:bigint,word:bigint,word_end:bigint>>),
          (done, s) -> CASE WHEN size(done) > 0 AND s.word <= element_at(done, -1).word_end
            THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
                'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end),
                'word', element_at(done, -1).word,
                'word_end', greatest(element_at(done, -1).word_end, s.word_end))))
            ELSE concat(done, array(s)) END)""")
    return (together.withColumn("__spans", merged)
            .withColumn("__n_hit", F.expr("aggregate(__spans, 0L, (n, s) -> n + s.word_end - s.word)"))
            .withColumn("__copy", F.explode(F.expr("sequence(1, __times)"))))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                  width: int = WIDTH, limit: int = BLOCK_WORDS) -> DataFrame:
    """Every document with the benchmark passages in it: ``key`` and the following.

    ``n_words``; ``n_hit``, words inside an occurrence of a window; ``spans``, the merged ranges of
    those words, as bytes of the UTF-8 text and as word numbers; ``items``, the distinct items with
    an occurring window, sorted as strings.

    A null text has no words. A null benchmark text, or one without words, has no window; an item
    with a null id is named ``null``. An empty benchmark finds nothing. Repeated documents are
    reported once each, null keys too. Other columns are neither read nor returned.
    """
    found = _found(docs.select(key, "text"), benchmark, width, limit)
    return found.select(key, *(F.col("__" + n).alias(n) for n in ADDED))


@common.shielded
def removed(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with every benchmark passage cut out of the text; other texts are untouched.

    A document of which no word remains goes. ``n_chars`` is set anew where a text changed. Null
    texts stay as they are, and so do all further columns.
    """
    found = _found(docs, benchmark, width, limit)
    cut = F.expr("""
        concat_ws('', transform(sequence(0, size(__spans)), i -> decode(substring(encode(text, 'UTF-8'),
          CAST(IF(i = 0, 0, get(__spans, i - 1).end) AS INT) + 1,
          CAST(IF(i = size(__spans), octet_length(text), get(__spans, i).start)
             - IF(i = 0, 0, get(__spans, i - 1).end) AS INT)), 'UTF-8')))""")
    changed = F.size("__spans") > 0
    found = found.where(~changed | (F.col("__n_hit") < F.col("__n_words")))
    values = {"text": F.when(changed, cut).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))


def items_digest(items: str = "items"):
    """SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)
