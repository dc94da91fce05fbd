"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything that is not a letter becomes a blank, and pairs and triples of
code points are hashed into ``CELLS`` cells. Training counts (language, cell) inside the tasks and
adds the counts up with one small shuffle; the log-probabilities form matrices of CELLS rows and one
column per language, ``BLOCK_LANGUAGES`` at most in each, which are built one after another and
broadcast. Scoring gathers the rows of the n-grams that occur and sums them per text, a window of text at
a time; with several matrices the texts pass one after another, and carry what the next has to beat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import session
from rankloom.llm import common

CELLS = 1 << 15
#: Bytes of text whose n-grams are held at once; each takes about 60 times that while it is worked on.
WINDOW_BYTES = 1 << 17
#: Languages of one matrix; at most 52 MB.
BLOCK_LANGUAGES = 400
SMOOTHING = 0.5
#: n-grams after which a text's evidence stops making the score more certain.
EVIDENCE = 60
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def windows(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(cell, text number)`` of every n-gram with a letter in it and the numbers of texts with a letter, window by window.

    A window is ``size`` bytes (``WINDOW_BYTES``) of the texts put together; a longer text goes on in the next
    one, which sees the code points on either side of its edges.
    """
    data, offsets = common.text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    begin, size = 0, size or WINDOW_BYTES

    def cut(at: int, step: int) -> int:
        """Where a code point begins, at ``at`` or behind it (``step`` 1) or before it (-1)."""
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at += step
        return max(0, min(at, len(data)))

    while begin < len(data):
        end = cut(begin + size, 1)
        low, high = cut(begin - 1, -1), cut(end + 1, 1)
        seen = data[low:high]
        codes = np.frombuffer(seen.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        place = low + np.flatnonzero(seen & 0xC0 != 0x80)
        owner = np.searchsorted(offsets, place, side="right") - 1
        letter = letters()[codes]
        # A blank on each side of every text keeps n-grams from running into the next one.
        line = np.full(len(codes) + 2, 32, np.uint32)
        line[1:-1] = np.where(letter, codes, 32)
        same = owner[1:] == owner[:-1]
        at = np.flatnonzero(letter & (place >= begin) & (place < end))
        before = np.where(np.append(False, same)[at], line[at], np.uint32(32))
        after = np.where(np.append(same, False)[at], line[at + 2], np.uint32(32))
        owner, here = owner[at], line[at + 1]
        pair = (here * np.uint32(0x9E3779B1)) ^ (after * np.uint32(0x85EBCA77))
        triple = pair ^ (before * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F)
        cells = np.empty((len(at), 2), np.int64)
        for nth, value in enumerate((pair, triple)):
            value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            cells[:, nth] = (value ^ (value >> np.uint32(13))) & np.uint32(CELLS - 1)
        yield cells.reshape(-1), np.repeat(owner, 2), owner[np.append(True, owner[1:] != owner[:-1])[: len(owner)]]
        begin = end


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of ``windows`` at once, and whether a text has a letter."""
    has, found = np.zeros(len(column), bool), list(windows(column))
    for _, _, lettered in found:
        has[lettered] = True
    cell, owner = (np.concatenate([np.zeros(0, np.int64), *(f[n] for f in found)]) for n in (0, 1))
    return cell, owner, has


@dataclass
class Block:
    """Some of the languages."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray  # one row for each cell

    def judged(self, column: pa.Array) -> dict[str, np.ndarray]:
        """For each text its best language here and what other blocks need to know (see ``STATE``)."""
        count = len(column)
        total, has = np.zeros((count, len(self.languages))), np.zeros(count, bool)
        amount = np.zeros(count, np.int64)
        step = max(1, (1 << 21) // len(self.languages))
        for cell, owner, lettered in windows(column):
            has[lettered] = True
            for begin in range(0, len(cell), step):
                some = owner[begin : begin + step]
                first = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
                amount[some[first]] += np.diff(np.append(first, len(some)))
                total[some[first]] += np.add.reduceat(self.logs[cell[begin : begin + step]], first, axis=0, dtype=np.float64)
        amount = np.maximum(amount, 1)
        tempered = self.prior + total * np.minimum(1.0, EVIDENCE / amount)[:, None]
        best, each = np.argmax(self.prior + total, axis=1), np.arange(count)
        top = tempered.max(axis=1)
        gain = np.where(amount < EVIDENCE, np.inf, total[each, best] / amount + np.log(CELLS))
        return {"lang": np.array(self.languages, object)[best], "best": (self.prior + total)[each, best], "own": tempered[each, best],
                "top": top, "sum": np.exp(tempered - top[:, None]).sum(axis=1), "gain": gain, "has": has}


#: Of the blocks so far: best language, its log-probability, the same tempered, the highest tempered one, the
#: sum of all relative to that, and how much likelier the best makes an n-gram than chance. ``has``: a letter.
STATE = {"lang": "string", "best": "double", "own": "double", "top": "double", "sum": "double", "gain": "double", "has": "boolean"}
ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def together(before: dict[str, np.ndarray], now: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """State of two blocks; a tie stays with the first, whose languages sort before."""
    better = now["best"] > before["best"]
    out = {k: np.where(better, now[k], before[k]) for k in ("lang", "best", "own", "gain")}
    out["top"], out["has"] = np.maximum(before["top"], now["top"]), now["has"]
    out["sum"] = sum(s["sum"] * np.exp(s["top"] - out["top"]) for s in (before, now))
    return out


@dataclass
class Model:
    """Learned languages: one broadcast matrix for each block of them, in the order of their names."""

    blocks: list[Broadcast]


def counts(labelled: DataFrame) -> DataFrame:
    """``lang, cell, n``; cell -1 counts texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in common.slices(batch, "text"):
                names = piece.column("lang").to_pylist()
                known = sorted(set(names))
                number = np.array([known.index(n) for n in names])
                has = np.zeros(piece.num_rows, bool)
                for name in known:
                    sums.setdefault(name, np.zeros(CELLS + 1, np.int64))
                for cell, owner, lettered in windows(piece.column("text")):
                    has[lettered] = True
                    used, n = np.unique(number[owner] * CELLS + cell, return_counts=True)
                    edges = np.searchsorted(used, np.arange(len(known) + 1) * CELLS)
                    for name, low, high in zip(known, edges, edges[1:]):
                        sums[name][used[low:high] % CELLS] += n[low:high]
                for name, texts in zip(known, np.bincount(number[has], minlength=len(known))):
                    sums[name][CELLS] += texts
        for name, held in sums.items():
            used = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(np.where(used == CELLS, -1, used), pa.int32()),
                 pa.array(held[used], pa.int64())], ["lang", "cell", "n"])

    return (labelled.select("lang", "text").mapInArrow(common.released(work), "lang string, cell int, n long")
            .groupBy("lang", "cell").agg(F.sum("n").alias("n")))


def fit(labelled: DataFrame) -> Model:
    """Learn from every row of ``labelled(text, lang)``; rows without a text, letter or language teach nothing.

    The driver holds the names of all languages and the matrix of one block.
    """
    rows = session.stage(counts(labelled.where("lang IS NOT NULL AND text IS NOT NULL")))
    texts = dict(rows.where("cell = -1").select("lang", "n").collect())  # one row per language
    languages, every = sorted(k for k, n in texts.items() if n > 0), sum(texts.values())
    blocks = []
    for begin in range(0, len(languages), BLOCK_LANGUAGES):
        some = languages[begin : begin + BLOCK_LANGUAGES]
        number = {name: nth for nth, name in enumerate(some)}
        table = np.full((len(some), CELLS), SMOOTHING)
        for lang, cell, n in rows.where((F.col("cell") >= 0) & F.col("lang").isin(some)).toLocalIterator():
            table[number[lang], cell] += n
        logs = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)
        prior = np.log(np.array([texts[k] for k in some]) / every)
        blocks.append(labelled.sparkSession.sparkContext.broadcast(Block(some, prior, np.ascontiguousarray(logs))))
    return Model(blocks)


def _pass(docs: DataFrame, block: Broadcast, names: dict[str, str], first: bool) -> DataFrame:
    kept = docs.columns if first else [c for c in docs.columns if c not in names.values()]
    kinds = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text"):
                now = block.value.judged(piece.column("text"))
                if not first:
                    now = together({k: piece.column(n).to_numpy(zero_copy_only=False) for k, n in names.items()}, now)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), *(pa.array(now[k], ARROW[t]) for k, t in STATE.items())],
                    [*kept, *names.values()])

    return docs.mapInArrow(common.released(work), ", ".join([*kinds, *(f"{names[k]} {t}" for k, t in STATE.items())]))


def judged(docs: DataFrame, model: Model) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column for each entry of ``STATE``, and the names of these, which no column of ``docs`` has."""
    names = dict(zip(STATE, common.fresh(docs, *("__" + k for k in STATE))))
    for nth, block in enumerate(model.blocks):
        docs = _pass(docs, block, names, nth == 0)
    return docs, names


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__lang`` and ``__score``: predicted language and its probability.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text when nothing
    was learned. Ties go to the language that sorts first. Columns of ``docs`` with the two names are
    replaced; all others pass unread. Repeated rows are judged once each.
    """
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("__lang", "__score")]
    if not model.blocks:
        return docs.select(*kept, F.lit(UNDETERMINED).alias("__lang"), F.lit(0.0).alias("__score"))
    found, n = judged(docs.select(*kept), model)
    return found.select(*kept, F.when(F.col(n["has"]), F.col(n["lang"])).otherwise(UNDETERMINED).alias("__lang"),
                        F.when(F.col(n["has"]), F.exp(F.col(n["own"]) - F.col(n["top"])) / F.col(n["sum"])).otherwise(0.0).alias("__score"))


def training_rows(docs: DataFrame, held: Column) -> DataFrame:
    return docs.where(~held).select("text", "lang")


def recognised(docs: DataFrame, held: Column, least: float = 0.0) -> DataFrame:
    """``docs`` without the texts whose language cannot be told.

    Those are texts without a letter (null and empty ones too), and texts whose n-grams their best
    language makes less than ``least`` (a natural logarithm, on average) likelier than chance over all
    cells: no language learned explains them. That does not depend on how many were learned. Texts of
    fewer than ``EVIDENCE`` n-grams have the benefit of the doubt, and so has every text with a letter
    when nothing was learned. Repeated rows are judged once each; all columns are kept, whatever their names.
    """
    model = fit(training_rows(docs, held))
    if not model.blocks:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found, n = judged(docs, model)
    return found.where(F.col(n["has"]) & (F.col(n["gain"]) >= least)).select(*(f"`{c}`" for c in docs.columns))
