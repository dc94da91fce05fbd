"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each node every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the
child's name, and the smallest draw wins. A node weighs what its shards weigh together. A key's
draws under a node do not depend on the rest of the tree, so a change of weights moves keys only
into or out of the subtrees whose weights changed; a shard opened as a region of its own takes keys
only into itself.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import session
from rankloom.functions import hashing
from rankloom.llm import common

#: Rows numbered by one task.
NUMBERED_ROWS = 20_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular(shards: int, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Equal shards, ``per_rack`` to a rack and ``racks`` racks to a region; the last ones may be partly filled."""
    return [Leaf(f"region{n // (racks * per_rack)}", f"rack{n // per_rack % racks}", n) for n in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, opened as a region of its own."""
    nth = max((leaf.shard for leaf in leaves), default=-1) + 1
    return [*leaves, Leaf(f"region+{nth}", "rack0", nth, weight)]


def children(leaves: list[Leaf]) -> dict[str, dict[str, float]]:
    """Weights of the children of every inner node, by path."""
    found: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for leaf in leaves:
        if leaf.weight < 0:
            raise ValueError(f"shard {leaf.shard} has a negative weight")
        if leaf.weight:
            found[""][leaf.region] += leaf.weight
            found[f"/{leaf.region}"][leaf.rack] += leaf.weight
            found[f"/{leaf.region}/{leaf.rack}"][str(leaf.shard)] += leaf.weight
    if not found:
        raise ValueError("a tree needs a shard with a positive weight")
    return found


def _tree(leaves: list[Leaf]) -> str:
    """The tree as a map literal: path -> array of (name, weight)."""
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = []
    for path, below in children(leaves).items():
        nodes = ", ".join(f"named_struct('name', {quoted(n)}, 'weight', CAST({w!r} AS DOUBLE))" for n, w in sorted(below.items()))
        parts.append(f"{quoted(path)}, array({nodes})")
    return f"map({', '.join(parts)})"


def draw(key: str, path: str, name: str, seed: str) -> str:
    """SQL text: a number in (0, 1) hashed from the key and a child's place in the tree."""
    joined = f"concat_ws(':', '{seed}', {key}, concat({path}, '/', {name}))"
    return f"((CAST(conv(substring(md5({joined}), 1, 13), 16, 10) AS BIGINT) + 0.5D) / 4503599627370496D)"


def placed(docs: DataFrame, key: Column, leaves: list[Leaf], into: str, seed: str = "0") -> DataFrame:
    """``docs`` with a column ``into``: the path ``/region/rack/shard`` of each row's key. No shuffle."""
    out = docs.withColumn("__key", F.coalesce(key.cast("string"), F.lit(""))).withColumn("__path", F.lit(""))
    tree = _tree(leaves)
    for _ in range(3):
        cost = f"-ln({draw('__key', '__path', 'c.name', seed)}) / c.weight"
        best = (f"array_min(transform(element_at({tree}, __path), "
                f"c -> named_struct('cost', {cost}, 'name', c.name))).name")
        out = out.withColumn("__path", F.expr(f"concat(__path, '/', {best})"))
    return out.withColumn(into, F.col("__path")).drop("__key", "__path")


def shard_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).cast("int")


def order_number(key: Column, seed: str = "slot") -> Column:
    """Place of a key in its shard's order: 60 hashed bits."""
    return hashing.draw_number(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))


def numbered(docs: DataFrame, rows: int, shard: str, order: str, ties: list[str], into: str) -> DataFrame:
    """Gapless numbers from 0 within each shard, by ``order`` then ``ties``.

    A shard is cut into ranges of the hashed order, about NUMBERED_ROWS rows each; a range is
    numbered in its task and starts where the counts of the ranges before it end. The table of
    counts has one row for that many rows.
    """
    from pyspark.sql import Window

    ranges = max(1, rows // NUMBERED_ROWS)
    ranged = docs.withColumn("__range", F.expr(f"CAST(floor({order} / 1152921504606846976D * {ranges}) AS INT)"))
    counts = ranged.groupBy(shard, "__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    within = Window.partitionBy(shard, "__range").orderBy(order, *ties)
    return (ranged.withColumn("__within", F.row_number().over(within))
            .join(starts, [shard, "__range"])
            .withColumn(into, F.col("__start") + F.col("__within") - 1)
            .drop("__range", "__within", "__start"))


def sharded(docs: DataFrame, key: str = "doc_id", shards: int = 16, leaves: list[Leaf] | None = None) -> DataFrame:
    """Every row of ``docs`` with its place: size, checksum, region, rack, shard, slot, and where it would
    go with one more shard.

    Only ``key`` and the number of shards decide (law ``key``). A null key is placed as the empty
    string; rows with equal keys share a shard. Slots follow a hash of the key, ties by key, checksum
    and size; equal rows take neighbouring slots. A null text has size 1 and no checksum. Other
    columns are neither read nor returned.
    """
    leaves = leaves or regular(shards)
    narrow = docs.select(
        F.col(key), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    narrow = placed(narrow, F.col(key), leaves, "__old")
    narrow = placed(narrow, F.col(key), grown(leaves), "__new")
    narrow = session.stage(narrow.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), shard_of(F.col("__old")).alias("shard"),
        shard_of(F.col("__new")).alias("grown_shard"), F.split("__old", "/")[1].alias("region"),
        F.split("__old", "/")[2].alias("rack"), order_number(F.col(key)).alias("__order")))
    found = numbered(narrow, narrow.count(), "shard", "__order", [key, "text_crc32", "size"], "slot")
    return found.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


@common.shielded
def assigned(docs: DataFrame, key: str = "doc_id", shards: int = 16) -> DataFrame:
    """``docs``, all columns, with ``region``, ``rack``, ``shard`` and ``slot``; columns of those names are replaced.

    Only ``key`` decides the shard, and a null key is placed as the empty string. Slots follow a hash of the
    key, ties go by all columns, equal rows take neighbouring slots. Null texts are rows like others; an
    empty table gives none.
    """
    kept = [c for c in docs.columns if c not in ("region", "rack", "shard", "slot")]
    path = placed(docs.select(*(f"`{c}`" for c in kept)), F.col(f"`{key}`"), regular(shards), "__old")
    path = path.withColumn("__shard", shard_of(F.col("__old"))).withColumn("__order", order_number(F.col(f"`{key}`")))
    ties = [f"`{f.name}`" for f in docs.schema if f.name in kept and not f.dataType.simpleString().startswith(("map", "variant"))]
    found = numbered(path, docs.count(), "__shard", "__order", ties, "__slot")
    return found.select(*(f"`{c}`" for c in kept), F.split("__old", "/")[1].alias("region"), F.split("__old", "/")[2].alias("rack"),
                        F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
