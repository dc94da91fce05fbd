"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps each character to one: accents and case go, look-alike letters of other scripts become
Latin, digits and signs that stand in for letters become those letters. The lexicon holds whole
words and word beginnings that training rows show to be toxic; a phrase around an entry that clean
rows use is an exception and cancels the match. A text's score is a logistic function of its matched
weight, once in all and once per hundred words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import session
from rankloom.llm import common, ngram_join

#: Labelled rows learned from, at most: those with the smallest hash of their id.
LABELLED_ROWS = 20_000
#: Toxic training rows a candidate must occur in; how much more often than in clean ones (log odds) and
#: how surely (half the likelihood-ratio statistic; many thousand candidates are tried) an entry does.
LEAST_ROWS, LEAST_ODDS, LEAST_EVIDENCE = 4, 1.5, 14.0
EXCEPTION_ROWS = 3
BEGINNINGS = (4, 5, 6, 7, 8)

# Look-alikes of other scripts and stand-ins for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ω": "w", "ß": "s", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "æ": "a", "œ": "o",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: Letters that a stand-in cannot tell apart are one letter to the matcher.
SAME = {"l": "i", "j": "i"}


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """Characters that folding changes, up to the end of the basic plane and the mathematical letters."""
    table: dict[int, str] = {}
    for code in (*range(0x20, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        own = chr(code)
        base = unicodedata.normalize("NFKD", own)[:1].lower() or own
        base = base if len(base) == 1 else own
        base = HOMOGLYPHS.get(own.lower(), HOMOGLYPHS.get(base, base))
        base = STAND_INS.get(base, base)
        base = SAME.get(base, base)
        if base != own:
            table[code] = base
    return table


def fold(text: str) -> str:
    """As long as ``text``, character for character."""
    return text.translate(folding())


#: Runs of letters, digits and stand-ins; stand-ins at either end are punctuation.
WORD = re.compile(r"[^\W_](?:[\w@$!|]*[^\W_])?")


#: Stand-ins that no word goes on after, or that stand before one: punctuation to the matcher.
MARKS = re.compile(r"[@$!|]+(?!\w)|(?<!\w)[@$!|]+")


def plain(text: str) -> str:
    """``text`` with those blanked, character for character."""
    if any(c in text for c in "@$!|"):
        return MARKS.sub(lambda m: " " * len(m[0]), text)
    return text


def words(text: str) -> list[str]:
    return [fold(w) for w in WORD.findall(text)]


def features(word: str) -> list[str]:
    """The word, and its beginnings, which are marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    coefficients: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def automaton(self):
        if not hasattr(self, "_automaton"):
            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                pattern, whole = entry.rstrip("*"), not entry.endswith("*")
                held = built.get(pattern, [])
                built.add_word(pattern, [*held, (len(pattern), whole, weight, entry)])
            if len(built):
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def matches(self, text: str) -> Iterator[tuple[int, int, float, str]]:
        """``(start, end, weight, entry)`` of the heaviest entry at each place where one begins a word."""
        text = plain(text)
        folded = fold(text)
        best: dict[int, tuple[int, float, str]] = {}
        if len(self.automaton):
            for last, entries in self.automaton.iter(folded):
                for size, whole, weight, entry in entries:
                    start = last - size + 1
                    if start and text[start - 1].isalnum():
                        continue
                    if whole and last + 1 < len(text) and text[last + 1].isalnum():
                        continue
                    if weight > best.get(start, (0, 0.0, ""))[1]:
                        best[start] = (last + 1, weight, entry)
        for start, (end, weight, entry) in best.items():
            yield start, end, weight, entry

    def neighbours(self, text: str, start: int, end: int, entry: str) -> tuple[tuple[str, str], tuple[str, str]]:
        """The entry with the word before it and with the word after it."""
        low, high = max(0, start - 40), min(len(text), end + 40)
        while low and text[low - 1].isalnum():  # no word is cut by the window
            low -= 1
        while high < len(text) and text[high].isalnum():
            high += 1
        before = WORD.findall(text[low:start])
        while end < len(text) and text[end].isalnum():
            end += 1
        after = WORD.findall(text[end:high])
        return (fold(before[-1]) if before else "", entry), (entry, fold(after[0]) if after else "")

    def found(self, text: str) -> tuple[float, list[str]]:
        """Matched weight and entries, without exceptions."""
        total, entries = 0.0, set()
        for start, end, weight, entry in self.matches(text):
            if self.exceptions and not self.exceptions.isdisjoint(self.neighbours(text, start, end, entry)):
                continue
            total += weight
            entries.add(entry)
        return total, sorted(entries)

    def inputs(self, text: str, total: float) -> tuple[float, float]:
        count = text.count(" ") + text.count("\n") + 1
        return math.log1p(total), math.log1p(100 * total / count)

    def judged(self, text: str) -> tuple[float, list[str]]:
        """Score and matched entries."""
        total, entries = self.found(text)
        a, b = self.inputs(text, total)
        c = self.coefficients
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, c[0] + c[1] * a + c[2] * b)))), entries


def sample(docs: DataFrame, labels: DataFrame, held: Column, limit: int) -> DataFrame:
    """``text, toxic`` of at most about ``limit`` labelled training rows, near copies left out.

    The rows are those with the smallest hash of their id, whichever they are; that many labels are
    few enough to send to every task, so documents stay where they are. Copies would make any word
    of theirs look typical: of documents with an equal minimum hash one stays, for three hashes.
    """
    marked = (labels.where("toxic IN (0, 1)").where(~held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    count = marked.count()
    if count > limit:
        least = int(-(1 << 63) + (1 << 64) * limit / count)
        marked = marked.where(F.xxhash64("doc_id", F.lit("labelled")) < F.lit(least))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text"):
                least = ngram_join.Shingles(piece.column("text"), 3).minima(3)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *(pa.array(least[:, n]) for n in range(3))], [*piece.schema.names, "m0", "m1", "m2"])

    rows = session.stage(rows.select("doc_id", "text", "toxic").mapInArrow(
        families, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, toxic int, m0 long, m1 long, m2 long"))
    kept = rows.select("doc_id", "toxic", "m0", "m1", "m2")
    for hashed in ("m0", "m1", "m2"):
        kept = kept.groupBy(hashed).agg(F.min_by(F.struct("doc_id", "toxic", *{"m0", "m1", "m2"} - {hashed}), "doc_id").alias("k")).select(hashed, "k.*")
    kept = kept.select("doc_id").distinct()
    return session.stage(rows.join(F.broadcast(kept), "doc_id", "left_semi").select("text", "toxic").distinct())


def _counted(rows: DataFrame, make) -> DataFrame:
    """``feature, toxic, clean``: rows of each label in which ``make(text)`` finds a feature."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic].update(set(make(text)))
        names = list(seen[0].keys() | seen[1].keys())
        for begin in range(0, len(names), 50_000):
            some = names[begin : begin + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([seen[1][n] for n in some], pa.int64()),
                 pa.array([seen[0][n] for n in some], pa.int64())], ["feature", "toxic", "clean"])

    return (rows.select("text", "toxic").mapInArrow(work, "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log likelihood ratio of the labels of the rows with a feature against the labels of all rows."""
    share, rows = all_toxic / (all_toxic + all_clean), toxic + clean
    return sum(n * math.log(n / (rows * p)) for n, p in ((toxic, share), (clean, 1 - share)) if n)


def fit(docs: DataFrame, labels: DataFrame, held: Column, limit: int = LABELLED_ROWS) -> Lexicon:
    """Learn from documents with a label that are not ``held``: entries, exceptions, then the score's slopes.

    Rows with a null text, or a label other than 0 and 1, teach nothing; a document labelled twice
    counts as toxic if one label says so. Without rows of both labels nothing is learned.
    """
    rows = sample(docs, labels, held, limit)
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    # Only what occurs in toxic rows can be an entry, so clean rows count nothing else.
    make = lambda text: (f for w in set(words(text)) for f in features(w))
    # A feature never met in a clean row has the most evidence that its toxic rows can give: fewer rows than
    # that needs cannot make an entry. The rows learned from bound how many features there are.
    least = max(LEAST_ROWS, math.ceil(LEAST_EVIDENCE / math.log((toxic + clean) / toxic)))
    found = _counted(rows.where("toxic = 1"), make).where(f"toxic >= {least}")
    candidates = {f: n for f, n in found.select("feature", "toxic").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(candidates))
    picked = lambda text: shared.value.intersection(f for w in set(words(text)) for f in features(w))
    in_clean = {f: c for f, _, c in _counted(rows.where("toxic = 0"), picked).collect()}
    strong = {f: odds(n, in_clean.get(f, 0), toxic, clean) for f, n in candidates.items()}
    strong = {f: w for f, w in strong.items() if w >= LEAST_ODDS
              and evidence(candidates[f], in_clean.get(f, 0), toxic, clean) >= LEAST_EVIDENCE}
    # A beginning stands for every entry it begins, unless it is the weaker one.
    weights: dict[str, float] = {}
    for entry in sorted(strong, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"), f)):
        shorter = [entry[:n] + "*" for n in BEGINNINGS if n < len(entry.rstrip("*")) or (n == len(entry.rstrip("*")) and not entry.endswith("*"))]
        if all(weights.get(s, 0.0) < strong[entry] - 0.7 for s in shorter):
            weights[entry] = strong[entry]
    lexicon = Lexicon(weights)
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(text: str) -> Iterator[str]:
        for start, end, _, entry in sent.value.matches(text):
            for a, b in sent.value.neighbours(text, start, end, entry):
                if a and b:
                    yield f"{a} {b}"

    usual = _counted(rows, phrases).where(f"clean >= {EXCEPTION_ROWS} AND clean > 4 * toxic")
    lexicon.exceptions = {tuple(p.split(" ", 1)) for p, _, _ in usual.collect()}
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [sent.value.inputs(t, sent.value.found(t)[0]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([round(p[0], 2) for p in pairs], pa.float64()), pa.array([round(p[1], 2) for p in pairs], pa.float64()),
                 batch.column("toxic")], ["a", "b", "toxic"])

    points = rows.select("text", "toxic").mapInArrow(inputs, "a double, b double, toxic int").groupBy("a", "b", "toxic").count()
    lexicon.coefficients = logistic(np.array([tuple(r) for r in points.collect()], float))
    return lexicon


def logistic(points: np.ndarray, penalty: float = 0.05) -> tuple[float, float, float]:
    """Newton's method on rows ``(a, b, label, count)`` with a small ridge on the slopes."""
    x = np.column_stack([np.ones(len(points)), points[:, :2]])
    y, n = points[:, 2], points[:, 3]
    beta, ridge = np.zeros(3), np.diag([1e-6, penalty, penalty])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def scored(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id") -> DataFrame:
    """``key``, ``score`` and ``matched`` (the entries matched) of every document.

    A null text reads as empty and scores like any text without a match; with nothing learned every
    score is a half. Repeated rows are scored once each. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    docs = docs.select(key, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "text"):
                found = [sent.value.judged(t or "") for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(key), pa.array([s for s, _ in found], pa.float64()),
                     pa.array([m for _, m in found], pa.list_(pa.string()))], [key, "score", "matched"])

    return docs.mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, matched array<string>")
