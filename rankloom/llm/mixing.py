"""Mixing sources to target weights: exact block quotas dealt to shards by a splitting tree.

Each source's documents are laid end to end in a hashed order and cut into blocks of ``block``
words. A source's target becomes a number of blocks, its quota, of which the last is taken only up to
the word at which the target is reached. A binary tree over the output
shards deals the quotas: at every node the left half of the shards gets its exact share of blocks,
and how many come from each source is a multivariate-hypergeometric draw (source by source, each a
hypergeometric draw conditioned on the ones before, by inversion around its mode). A source's
blocks are then taken in a permuted order, pass after pass, each shard a disjoint run of them, and
shuffled inside the shard by a hashed key.

Only DataFrame and SQL functions are used. Sources are one small table; the only order over a
source's documents is a running sum within ranges of the hashed order, added to a table of one row
for every ``SUMMED_ROWS`` documents, so no source passes through one task however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom import session
from rankloom.functions import hashing
from rankloom.llm import common

WEIGHTS = (5, 2, 1)
#: Words taken altogether, as a share of all words.
SHARE = 1.5
#: A source or document is taken at most so many times.
PASSES = 2
BLOCK = 64
SHARDS = 16
SUMMED_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"
#: Primes for the permutation of blocks; one that does not divide the number of blocks is used.
PRIMES = (536870909, 536870879)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null sources are one source of their own, the last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def sized(docs: DataFrame, key: str, source: str, seed: str) -> DataFrame:
    """``id, source, size, h``: what the layout needs of each document. ``h`` orders documents within a source."""
    checked = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(-1))
    return docs.select(
        F.col(key).alias("id"), source_key(F.col(source)).alias("source"), words(F.col("text")).alias("size"),
        hashing.draw_number(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), checked).alias("h"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, source_size, target``: weights repeat over the sources in code point order, null last.

    A source stops at PASSES times its size and the excess is shared again by weight. The end of that
    is a level: sources stop in the order of size per weight, and the others take the rest by weight.
    """
    listed = totals.withColumn("nth", F.row_number().over(Window.orderBy("source")))
    picked = F.element_at(F.lit(list(weights)).cast("array<double>"), F.expr(f"CAST((nth - 1) % {len(weights)} AS INT) + 1"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = (listed.withColumn("weight", picked).withColumn("cap", (F.col("source_size") * PASSES).cast("double"))
              .withColumn("amount", F.sum("source_size").over(every) * share))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onwards = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # Were this source and all after it uncapped, they would share what the ones before leave.
    level = (F.col("amount") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    listed = listed.withColumn("level", level).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("cap"), free.getItem("level") * F.col("weight")))
    return listed.select("source", "source_size", target.alias("target"))


def unit(*parts: str) -> str:
    """SQL text: a number in (0, 1) hashed from the parts."""
    return (f"((CAST(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) AS BIGINT) + 0.5D)"
            " / 4503599627370496D)")


def bound(name: str, body: str, **fields: str) -> str:
    """SQL text: ``body``, in which ``name.field`` stands for the value of each of ``fields``, worked out once."""
    values = ", ".join(f"'{field}', {value}" for field, value in fields.items())
    return f"element_at(transform(array(named_struct({values})), {name} -> {body}), 1)"


def hypergeometric(rest: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL text: how many of ``drawn`` items are marked, when ``marked`` of ``rest`` items are.

    Inversion of the distribution, outwards from its mode: weights follow by ratio, twelve standard
    deviations to each side, so the work grows with the root of the numbers and nothing overflows.
    Every step is bound to a name: put in as text where it is used, steps within steps make an
    expression of thousands of nodes, and the driver's memory goes into analysing it.
    """
    mode = ("least(e.high, greatest(e.low, CAST(floor(CAST(i.drawn + 1 AS DOUBLE) * (i.marked + 1) / (i.rest + 2)) AS BIGINT)))")
    spread = ("CAST(ceil(12 * sqrt(CAST(i.drawn AS DOUBLE) * i.marked / greatest(1, i.rest)"
              " * (1 - CAST(i.marked AS DOUBLE) / greatest(1, i.rest)))) AS BIGINT) + 2")
    up = "CAST(i.marked - k AS DOUBLE) * (i.drawn - k) / (CAST(k + 1 AS DOUBLE) * (i.rest - i.marked - i.drawn + k + 1))"
    down = "CAST(k AS DOUBLE) * (i.rest - i.marked - i.drawn + k) / (CAST(i.marked - k + 1 AS DOUBLE) * (i.drawn - k + 1))"
    zero = "named_struct('w', 1.0D, 'sum', {start}, 'at', {at})"
    # Numbers from the mode up, then from below the mode down; `at` is where the running sum first
    # passes the goal. Each half is summed once to find the total and once to find the place.
    ups = "IF(m.mode < n.top, sequence(m.mode, n.top - 1), cast(array() as array<bigint>))"
    downs = "IF(m.mode > n.bottom, sequence(m.mode, n.bottom + 1, -1L), cast(array() as array<bigint>))"

    def walk(numbers: str, ratio: str, start: str, goal: str, step: int) -> str:
        return (f"aggregate({numbers}, {zero.format(start=start, at='-1L')}, (s, k) -> named_struct("
                f"'w', s.w * {ratio}, 'sum', s.sum + s.w * {ratio}, "
                f"'at', IF(s.at < 0 AND s.sum + s.w * {ratio} >= {goal}, k + {step}L, s.at)))")

    found_up = f"{walk('w.ups', up, '1.0D', 'g.goal', 1)}.at"
    found_down = bound("f", "IF(f.at < 0, m.mode, f.at)", at=f"{walk('w.downs', down, 't.up', 'g.goal', -1)}.at")
    out = f"CASE WHEN g.goal <= 1 THEN m.mode WHEN g.goal <= t.up THEN greatest(e.low, {found_up}) ELSE {found_down} END"
    out = bound("g", out, goal="i.uniform * (t.up + t.down)")
    out = bound("t", out, up=f"{walk('w.ups', up, '1.0D', '1e300', 1)}.sum", down=f"{walk('w.downs', down, '0.0D', '1e300', -1)}.sum")
    out = bound("w", out, ups=ups, downs=downs)
    out = bound("n", out, top="least(e.high, m.mode + m.spread)", bottom="greatest(e.low, m.mode - m.spread)")
    out = bound("m", out, mode=mode, spread=spread)
    out = bound("e", out, low="greatest(0L, i.drawn - (i.rest - i.marked))", high="least(i.marked, i.drawn)")
    return bound("i", out, rest=rest, marked=marked, drawn=drawn, uniform=uniform)


def split_quotas(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """``source, cuts``: for each source, where its run of blocks ends in each shard.

    ``quotas(source, quota)`` is packed into one row, the root of the tree; a level of the tree is one
    projection. The row has one number per source.
    """
    node = (quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("all"))
            .select(F.col("all.source").alias("sources"), F.col("all.quota").alias("quota"),
                    F.lit(0).alias("first"), F.lit(shards).alias("width")))
    drawn = hypergeometric("a.rest", "q", "a.left", unit(f"'{seed}'", "first", "width", "size(a.out)"))
    total = "aggregate(quota, 0L, (t, q) -> t + q)"
    half = "CAST(floor(width / 2) AS INT)"
    while shards > 1:
        dealt = node.withColumn("total", F.expr(total)).withColumn("room", F.expr(f"CAST(floor(CAST(total AS DECIMAL(38,0)) * {half} / width) AS BIGINT)"))
        dealt = dealt.withColumn("lefts", F.expr(
            "aggregate(quota, named_struct('rest', total, 'left', room, 'out', cast(array() as array<bigint>)), (a, q) -> "
            f"element_at(transform(array({drawn}), d -> named_struct('rest', a.rest - q, 'left', a.left - d, 'out', concat(a.out, array(d)))), 1),"
            " a -> a.out)"))
        node = session.stage(dealt.select("sources", F.explode(F.expr(
            "filter(array("
            f" named_struct('quota', lefts, 'first', first, 'width', {half}),"
            f" named_struct('quota', zip_with(quota, lefts, (q, l) -> q - l), 'first', first + {half}, 'width', width - {half})),"
            " n -> n.width > 0)")).alias("n")).select("sources", "n.quota", "n.first", "n.width"))
        shards = -(-shards // 2)
    per = node.select("first", F.posexplode(F.arrays_zip("sources", "quota")).alias("nth", "s")).select(
        "first", F.col("s.sources").alias("source"), F.col("s.quota").alias("quota"))
    run = F.sum("quota").over(Window.partitionBy("source").orderBy("first"))
    return (per.withColumn("cut", run).groupBy("source")
            .agg(F.array_sort(F.collect_list(F.struct("first", "cut"))).alias("c")).select("source", F.col("c.cut").alias("cuts")))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
         share: float = SHARE, block: int = BLOCK, shards: int = SHARDS, seed: str = "0", whole: bool = False) -> DataFrame:
    """What the mix takes of every document: ``id, h, source, size, source_size, target, pieces``.

    ``pieces`` lists the runs of words taken: ``copy`` (which pass over the source), ``start`` and
    ``words`` within the document, ``shard``, and ``spot``, the hashed place inside the shard. A source
    takes its target to within a word; no word is taken more than PASSES times.

    With ``whole`` a block owns the documents that begin in it, and blocks are taken as they lie (the
    documents already lie in a hashed order). A pass then takes a document from its first word to its
    last; only the one document of a source in which its target is reached is cut, at that word.

    Documents without words (null or empty texts) are listed with no pieces; a null source is a source
    of its own, last in order; equal rows are laid one behind the other; an empty table gives no rows.
    Ties of the hashed order are settled by id and size. Reruns agree: only digests decide.
    """
    docs = session.stage(sized(docs, key, source, seed))
    totals = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    aims = session.stage(targets(totals, weights, share))
    blocks = (aims.withColumn("blocks", F.expr(f"CAST(ceil(source_size / {block}) AS BIGINT)"))
              .withColumn("goal", F.expr("coalesce(CAST(round(target) AS BIGINT), 0L)")))
    multiplier = F.expr("element_at(filter(array(" + ", ".join(f"{p}L" for p in PRIMES) + "), p -> blocks = 0 OR blocks % p <> 0), 1)")
    offset = F.expr(f"CAST(floor({unit(f"'{seed}'", "'offset'", 'source')} * blocks) AS BIGINT)")
    blocks = blocks.withColumn("by", F.lit(1).cast("long") if whole else multiplier).withColumn("shift", F.lit(0).cast("long") if whole else offset)
    # The source's last block as it lies is the only shorter one: `short` words at turn `odd` of a pass.
    # `rest` words are wanted of the last pass that takes any but not all.
    blocks = (blocks.withColumn("rest", F.expr("coalesce(goal % nullif(source_size, 0), 0L)"))
              .withColumn("odd", F.expr("coalesce(((blocks - 1) * by + shift) % nullif(blocks, 0), 0L)"))
              .withColumn("short", F.expr(f"source_size - (blocks - 1) * {block}"))
              .withColumn("early", F.expr(f"least(rest, odd * {block})"))
              .withColumn("middle", F.expr("least(rest - early, short)"))
              .withColumn("late", F.expr("rest - early - middle"))
              .withColumn("quota", F.expr(f"coalesce(CAST(goal DIV nullif(source_size, 0) AS BIGINT) * blocks, 0L)"
                                          f" + CAST(ceil(early / {block}) + IF(middle > 0, 1, 0) + ceil(late / {block}) AS BIGINT)"))
              .withColumn("final", F.expr(f"CASE WHEN late > 0 THEN (late - 1) % {block} + 1 WHEN middle > 0 THEN middle"
                                          f" WHEN early > 0 THEN (early - 1) % {block} + 1 ELSE CAST({block} AS BIGINT) END")))
    cuts = split_quotas(blocks.select("source", "quota"), shards, seed)
    blocks = blocks.select("source", "source_size", "target", "blocks", "goal", "by", "shift", "quota", "final")
    blocks = session.stage(blocks.join(cuts, "source"))

    ranges = max(1, docs.count() // SUMMED_ROWS)
    ranged = docs.withColumn("range", F.expr(f"CAST(floor(h / 1152921504606846976D * {ranges}) AS INT)"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("begin", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    within = Window.partitionBy("source", "range").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(starts, ["source", "range"]).withColumn("at", F.col("begin") + F.col("inside")).drop("inside", "begin", "range"))
    # Blocks a document lies in, once per pass in which the source's quota reaches them.
    pieces = F.expr(f"""
        IF(size = 0, cast(array() as array<struct<copy:int,start:bigint,words:bigint,shard:int,spot:bigint>>),
        filter(flatten(transform(sequence(CAST(floor(at / {block}) AS BIGINT), CAST(floor((at + size - 1) / {block}) AS BIGINT)), b ->
          transform(filter(transform(sequence(0, {PASSES - 1}), c -> named_struct('copy', c,
              'turn', c * blocks + (b * by + shift) % blocks)), t -> t.turn < quota), t ->
            named_struct('copy', t.copy,
              'start', greatest(b * {block} - at, 0L),
              'words', least(b * {block} + IF(t.turn = quota - 1, final, {block}L), at + size) - greatest(b * {block}, at),
              'shard', size(filter(cuts, e -> e <= t.turn)),
              'spot', xxhash64('{seed}', source, t.turn))))), p -> p.words > 0))""")
    if whole:
        pieces = F.expr(f"""
            filter(transform(transform(sequence(0, {PASSES - 1}), c -> named_struct('copy', c,
                'turn', c * blocks + CAST(floor(at / {block}) AS BIGINT))), t -> named_struct('copy', t.copy,
                  'start', 0L,
                  'words', least(size, goal - t.copy * source_size - at),
                  'shard', size(filter(cuts, e -> e <= t.turn)),
                  'spot', xxhash64('{seed}', source, t.turn))), p -> p.words > 0)""")
    joined = laid.join(blocks, "source")
    return joined.select("id", "h", "source", "size", "source_size", "target", pieces.alias("pieces"))


def taken(pieces: str = "pieces") -> Column:
    return F.expr(f"aggregate({pieces}, 0L, (n, p) -> n + p.words)")


def shard_pieces(planned: DataFrame, partitions: int) -> DataFrame:
    """One row per piece, range-partitioned by shard and in shuffled order within each."""
    every = planned.select("id", "source", F.explode("pieces").alias("p")).select("id", "source", "p.*")
    order = ["shard", "spot", "copy", "id", "start"]
    return every.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


@common.shielded
def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: str = "0", shards: int = SHARDS,
          **how) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: each document once per pass that takes any of it.

    A pass that takes the whole document returns its text as it is; one that takes some words of it
    returns those with what stood before each, and ``n_chars`` follows. With ``whole`` (see ``plan``)
    texts have no gaps and at most one document of a source is cut. Documents without words count
    nothing and stay once. Equal rows are matched with their places one by one. Rows come in the order
    of the tree's shards and, inside a shard, of its shuffled spots; a document of several pieces goes
    by its first.
    """
    planned = plan(docs, key, source, shards=shards, seed=seed, **how)
    copies = F.expr(f"""
        filter(transform(sequence(0, {PASSES - 1}), c -> named_struct('copy', c,
          'parts', array_sort(transform(filter(pieces, p -> p.copy = c),
              p -> named_struct('start', p.start, 'words', p.words, 'shard', p.shard, 'spot', p.spot))))),
          c -> size(c.parts) > 0)""")
    places = planned.select(F.col("h").alias("__h"), F.col("size").alias("__size"), copies.alias("__copies"))
    nth = F.row_number().over(Window.partitionBy("__h").orderBy("__size", "__copies"))
    places = places.withColumn("__place", nth)
    ordered = [f"`{f.name}`" for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))]
    checked = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(-1))
    hashed = docs.withColumn("__h", hashing.draw_number(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), checked))
    hashed = hashed.withColumn("__nth", F.row_number().over(Window.partitionBy("__h").orderBy(*ordered)))
    # The place is compared by two inequalities, so that rows and places meet on the hash alone.
    met = hashed.join(places, "__h").where("__nth >= __place AND __nth <= __place")
    # A document without words has no place in the tree and gets one by its hash.
    rows = met.withColumn("__copy", F.explode(F.expr(f"""
        IF(__size = 0, array(named_struct('copy', 0, 'parts', array(named_struct('start', 0L, 'words', 0L,
            'shard', CAST(__h % {shards} AS INT), 'spot', xxhash64('{seed}', __h))))), __copies)""")))
    whole = F.expr("aggregate(__copy.parts, 0L, (n, p) -> n + p.words) = __size")
    part = F.expr(r"""array_join(flatten(transform(__copy.parts, p -> slice(
        regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), CAST(p.start AS INT) + 1, CAST(p.words AS INT)))), '')""")
    part = F.when(F.expr("__copy.parts[0].start = 0"), part).otherwise(F.regexp_replace(part, r"^[\x20\x09-\x0D]+", ""))
    values = {"text": F.when(whole, F.col("text")).otherwise(part)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(part).cast(docs.schema["n_chars"].dataType))
    # A partition is an even range of one shard's spots, so that none needs to be sampled for.
    per = max(1, docs.count() // (shards * SUMMED_ROWS))
    first, spot = "__copy.parts[0].shard", "__copy.parts[0].spot"
    rows = rows.repartitionById(shards * per, F.expr(
        f"CAST({first} * {per} + least({per - 1}, floor(({spot} / 18446744073709551616D + 0.5D) * {per})) AS INT)"))
    rows = rows.sortWithinPartitions(F.expr(first), F.expr(spot), "__copy.copy", "__h", "__nth")
    return rows.select(*(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))
