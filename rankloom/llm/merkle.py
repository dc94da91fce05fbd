"""A Merkle manifest of a table: one root over all rows, and for each row the witness that leads to it.

Rows become leaves, each source's leaves a tree, the trees' roots one more tree. A node hashes up to
``FANOUT`` consecutive ones below it.

Trees are built by appending in order. ``Appender`` keeps one open run of nodes per level; a node that
completes a run gives every leaf below it that level's siblings, so witnesses grow as the tree does and
only open subtrees are held. Appends are dealt to tasks in aligned blocks of ``FANOUT ** BLOCK_LEVELS``
leaves: no run crosses a block, so blocks are independent, and the roots of blocks are appended in turn
as the leaves of the next tree, until one node per source is left. Going down again, each block extends
the witness of its root with what its own leaves need. No task holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom import session
from rankloom.llm import common
from rankloom.operators import ordering

FANOUT = 16
#: Levels of a tree that one task builds.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Appender:
    """A tree of ``levels`` levels that grows by appended leaves.

    With ``witnessed``, each leaf's witness is a list of ``place:siblings`` from the leaf upwards: its
    ancestor's place among its run, and the other digests of the run in order.
    """

    def __init__(self, levels: int, witnessed: bool):
        self.levels, self.witnessed = levels, witnessed
        self.open: list[list[tuple[str, list[list[str]]]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[str]] = []

    def append(self, leaf: str) -> None:
        below: list[list[str]] = [[]] if self.witnessed else []
        self.witnesses += below
        self._add(0, leaf, below)

    def _add(self, level: int, node: str, below: list[list[str]]) -> None:
        self.open[level].append((node, below))
        if level < self.levels and len(self.open[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        joined = "".join(node for node, _ in run)
        every: list[list[str]] = []
        for place, (node, below) in enumerate(run):
            if below:
                at = place * len(node)
                siblings = f"{place}:{joined[:at]}{joined[at + len(node) :]}"
                for witness in below:
                    witness.append(siblings)
                every += below
        self._add(level + 1, digest(joined), every)

    def root(self) -> str:
        """Close all open runs; the last of a level may be short."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def folded(leaf: str, witness: str) -> str:
    """The root that ``leaf`` leads to."""
    for step in witness.split(",") if witness else []:
        place, _, siblings = step.partition(":")
        at = 64 * int(place)
        leaf = digest(siblings[:at] + leaf + siblings[at:])
    return leaf


def proof(witness: str) -> str:
    """SHA-256 of a witness's siblings, level by level."""
    whole = hashlib.sha256()
    for step in witness.split(",") if witness else []:
        whole.update(step.partition(":")[2].encode())
    return whole.hexdigest()


def levels_of(nodes: int, most: int) -> int:
    """Levels above ``nodes`` nodes until one is left, at most ``most``."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def leaf(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*(
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def leaves(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """``doc_id, source, leaf, tampered`` of every row; ``tampered`` is null where the row is left as it is."""
    own = {c: F.col(c) for c in fields}
    changed = own | {"text": F.translate("text", UPPER, LOWER)}
    tamper = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return docs.select("doc_id", "source", leaf(own).alias("leaf"), F.when(tamper, leaf(changed)).alias("tampered"))


def block(levels: int) -> Column:
    return F.floor(F.col("at") / FANOUT**levels).cast("long")


def blocked(nodes: DataFrame, levels: int) -> DataFrame:
    """Nodes of each block together and in order."""
    return nodes.withColumn("block", block(levels)).repartition("tree", "block").sortWithinPartitions(
        F.col("tree").asc_nulls_first(), "block", "at")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of one block after the other."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != key:
                yield key, held
                held = []
            key = (row["tree"], row["block"])
            held.append(row)
    if held:
        yield key, held


def block_roots(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One node for each block of ``nodes(tree, at, node, n)``: the nodes of the next tree."""
    narrow = blocked(nodes.select("tree", "at", "node", "n"), levels)
    names = ["tree", "at", "node", "n"]
    schema = to_arrow_schema(nodes.select(names).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*key, _root(rows, levels), -(-rows[0]["n"] // FANOUT**levels)) for key, rows in _runs(batches))
        for some in _batched(found, 1000):
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in some], schema)

    return narrow.mapInArrow(common.released(work), nodes.select(names).schema)


def _root(rows: list[dict], levels: int) -> str:
    tree = Appender(levels_of(rows[0]["n"], levels), False)
    for row in rows:
        tree.append(row["node"])
    return tree.root()


def _batched(rows, size: int):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


WITNESS = T.StructType().add("witness", T.StringType())


def witnessed(nodes: DataFrame, above: DataFrame, levels: int = BLOCK_LEVELS, finish=None,
              added: T.StructType = WITNESS) -> DataFrame:
    """``nodes(tree, at, node, n, ...)`` with the witness that leads to the root of everything.

    ``above(tree, at, witness)`` has the witnesses of the blocks. ``finish`` turns a row and its witness
    into the values of ``added``; without it the witness itself is returned.
    """
    table = nodes.columns
    up = above.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("witness").alias("_above"))
    placed = nodes.withColumn("block", block(levels))
    joined = placed.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_at")))
    joined = blocked(joined.select(*table, "_above"), levels)
    out = T.StructType([*nodes.schema.fields, *added.fields])
    schema = to_arrow_schema(out)
    finish = finish or (lambda row, witness: (witness,))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            for _, rows in _runs(batches):
                tree = Appender(levels_of(rows[0]["n"], levels), True)
                for row in rows:
                    tree.append(row["node"])
                tree.root()
                for row, own in zip(rows, tree.witnesses):
                    witness = ",".join([*own, row["_above"]] if row["_above"] else own)
                    yield {c: row[c] for c in table} | dict(zip(added.names, finish(row, witness)))

        for some in _batched(found(), 1000):
            yield pa.RecordBatch.from_pylist(some, schema)

    return joined.mapInArrow(common.released(work), out)


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the trees above them, the last with one node for each tree; each is a staged table."""
    trees = [nodes]
    while not trees[-1].where("n > 1").isEmpty():
        trees.append(session.stage(block_roots(trees[-1], levels)))
    return trees


def descend(trees: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Witnesses of the blocks of the lowest of ``trees``, from those of the nodes of the highest."""
    for nodes in reversed(trees[1:-1]):
        above = session.stage(witnessed(nodes, above, levels).select("tree", "at", "witness"))
    return above


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Places from 0 within each group, ``at``, whatever the size of a group."""
    return ordering.running_total(rows, group, order, before="at", hot_rows=0)


def manifest(docs: DataFrame, fields=FIELDS, witnesses: bool = False, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    ``leaf`` hashes the row's ``fields``, ``subroot`` the leaves of its source in ascending order of
    ``doc_id``, ``root`` the subroots in order of their sources (null first, by code point). ``proof_sha256``
    hashes the row's witness. Rows whose crc32 of ``doc_id`` is divisible by 5 are read again with the
    letters A-Z of their text lower-cased; ``folded_root`` is where that leaf, or else the row's own, leads
    by the witness, and ``verified`` whether that is the root. ``witnesses`` adds the witness itself.

    Null values hash as ``-``, empty texts as ``0:``. A null ``doc_id`` comes first in its source and is
    never tampered with; null is a source of its own. Equal ids are ordered by their leaves, and repeated
    rows are leaves of their own. An empty table gives an empty one. Other columns take no part.
    """
    rows = session.stage(leaves(docs, fields))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(rows.withColumnRenamed("leaf", "node"), ["source"], [F.col("doc_id").asc_nulls_first(), F.col("node").asc()])
    nodes = session.stage(ordering.attach(placed, counts, ["source"], size="n").select(
        F.col("source").alias("tree"), "at", "node", "n", "doc_id", "tampered"))
    sources = climb(nodes, levels)
    # The subroots are the leaves of the last tree.
    tops = numbered(sources[-1].select("tree", "node"), [], [F.col("tree").asc_nulls_first()])
    tops = session.stage(tops.select(F.lit("").alias("tree"), "at", "node", F.col("tree").alias("source")))
    many = tops.count()
    tops = tops.withColumn("n", F.lit(many).cast("long"))
    upper = climb(tops, levels)
    last = upper[-1].select("node").first()
    root = last[0] if last else ""
    start = docs.sparkSession.createDataFrame([("", 0, "")], "tree string, at long, witness string")
    of_tops = session.stage(witnessed(tops, descend(upper, start, levels), levels).select("source", "node", "witness"))
    above = of_tops.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), "witness")
    above = descend(sources, above, levels)

    def finish(row: dict, witness: str) -> tuple:
        reached = folded(row["tampered"] or row["node"], witness)
        return (proof(witness), reached, reached == root, *([witness] if witnesses else []))

    added = T.StructType().add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    if witnesses:
        added = added.add("witness", "string")
    found = witnessed(nodes, above, levels, finish, added).select(
        "doc_id", F.col("tree").alias("source"), F.col("node").alias("leaf"), F.lit(root).alias("root"), *added.names)
    subroots = of_tops.select("source", F.col("node").alias("subroot"))
    return ordering.attach(found, subroots, ["source"], salts=1)
