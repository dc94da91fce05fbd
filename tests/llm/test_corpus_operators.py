"""Sharding, decontamination, language, n-gram join, mixing and the pipeline against brute force and odd rows."""

import os
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom import session
from rankloom.llm import common, decontaminate, language, mixing, ngram_join, shard_tree

LOWER = {n: n + 32 for n in range(65, 91)}
BLANK = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD_TEXTS = [None, "", " \n", "é", "a b", "same text here", "same text here", "x" * 50_000, "word " * 30_000, "日本語 текст ümlaut"]


def documents(spark, texts, source=None):
    rows = [(n, t, "en", source[n] if source else "src0", len(t or "")) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def odd(spark):
    """Null and repeated keys, texts of every kind, and a column that clashes with the operators' own names."""
    df = documents(spark, ODD_TEXTS)
    df = df.union(df.where("doc_id = 4")).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    return df.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source"))).withColumn("size", F.lit("x")).withColumn("n_words", F.lit(0.5))


# -- sharding --------------------------------------------------------------------------------------


def test_growing_takes_rows_only_into_the_new_shard(spark):
    got = shard_tree.sharded(documents(spark, [f"text {n}" for n in range(3000)])).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert 0.3 / 17 < sum(r.grown_shard == 16 for r in got) / 3000 < 3 / 17
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_slots_do_not_depend_on_ranges_or_layout(spark, monkeypatch):
    df = documents(spark, [f"text {n}" for n in range(500)])
    before = sorted(map(tuple, shard_tree.sharded(df).collect()))
    monkeypatch.setattr(shard_tree, "NUMBERED_ROWS", 20)
    assert sorted(map(tuple, shard_tree.sharded(df.repartition(5)).collect())) == before


def test_weights_move_rows_only_within_changed_subtrees(spark):
    leaves = shard_tree.regular(16)
    heavier = [shard_tree.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else 1.0) for x in leaves]
    df = documents(spark, ["t"] * 4000).select("doc_id")
    moved = shard_tree.placed(shard_tree.placed(df, F.col("doc_id"), leaves, "a"), F.col("doc_id"), heavier, "b").where("a <> b").collect()
    assert moved
    for r in moved:
        # Rows move towards the heavier path at the level where the paths part, never between untouched nodes.
        old, new = r.a.split("/")[1:], r.b.split("/")[1:]
        level = next(n for n in range(3) if old[n] != new[n])
        assert new[level] == ["region0", "rack0", "0"][level]
    shares = Counter(r.s for r in shard_tree.placed(df, F.col("doc_id"), heavier, "b").select(shard_tree.shard_of(F.col("b")).alias("s")).collect())
    assert 0.7 < shares[0] / (4000 * 3 / 18) < 1.3


def test_sharding_of_odd_rows(spark):
    got = shard_tree.sharded(odd(spark)).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    assert {r["size"] for r in got if r.text_crc32 is None} == {1}
    assert shard_tree.sharded(odd(spark).where("false")).count() == 0
    placed = shard_tree.assigned(odd(spark).withColumn("slot", F.lit("old")))
    assert placed.count() == len(ODD_TEXTS) + 1 and "size" in placed.columns


# -- decontamination -------------------------------------------------------------------------------


def brute_contamination(texts, items, width):
    windows = defaultdict(set)
    for name, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for at in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[at : at + width])].add(name)
    out = []
    for text in texts:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                names = windows.get(tuple(words[at : at + size]))
                if names:
                    found |= names
                    hit.update(range(at, at + size))
        out.append((len(words), len(hit), sorted(found)))
    return out


def random_benchmark(seed, texts=40):
    rng = random.Random(seed)
    words = ["a", "b", "É1", "C", "d9", "x"]
    items = [(str(n), " ".join(rng.choice(words[:4]) for _ in range(rng.randint(0, 14)))) for n in range(8)] + [("8", None)]
    made = [None, ""] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice(["", " "]) + rng.choice(items)[1]
                         if rng.random() < 0.9 else "b! a? c" for _ in range(texts)]
    made = [m if m is not None else None for m in made]
    return made + made[5:9], items


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_WORDS, 4])
def test_contamination_against_brute_force(spark, limit):
    for seed, width in ((1, 10), (2, 3)):
        texts, items = [], []
        while not texts:
            try:
                texts, items = random_benchmark(seed)
            except TypeError:  # the null item was drawn
                seed += 10
        bench = spark.createDataFrame(items, "item_id string, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(documents(spark, texts), bench, width=width, limit=limit).collect()}
        assert got == dict(enumerate(brute_contamination(texts, items, width)))


def test_index_locates_every_occurrence():
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        symbols = [rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randint(1, 200))] + [0]
        index = decontaminate.Index(np.array(symbols), 3)
        for size in (1, 2, 4):
            pattern = [rng.randint(1, 3) for _ in range(size)]
            low, high = index.search(np.array([[0] * (4 - size) + pattern]), np.array([size]))
            rows, _ = decontaminate.expand(low, np.maximum(low, high))
            want = [n for n in range(len(symbols) - size + 1) if symbols[n : n + size] == pattern]
            assert sorted(index.locate(rows).tolist()) == want


def test_removed_passages(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, this. {passage.upper()}! After é.", passage, "clean text", None, ""]
    df = documents(spark, texts).withColumn("n_hit", F.lit("mine")).withColumn("items", F.array(F.lit(1)))
    bench = spark.createDataFrame([(1, passage), (None, None)], "item_id int, text string")
    got = {r.doc_id: r for r in decontaminate.removed(df, bench).collect()}
    assert {k: v.text for k, v in got.items()} == {0: "Before, this. ! After é.", 2: "clean text", 3: None, 4: ""}
    assert got[0].n_chars == len(got[0].text) and got[0].n_hit == "mine" and decontaminate.removed(df, bench).columns == df.columns


def test_contamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "same text here"), (2, "")], "item_id int, text string")
    got = decontaminate.contamination(odd(spark), bench).collect()
    assert len(got) == len(ODD_TEXTS) + 1 and sum(r.n_hit for r in got) == 6
    assert decontaminate.contamination(odd(spark), bench.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(odd(spark).where("false"), bench).count() == 0


# -- language --------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    docs = common.table(spark, folder, "documents")
    held = common.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(language.training_rows(docs, held))
    got = language.identified(docs, model).where(held).select("lang", "__lang").collect()
    assert sum(r[0] == r[1] for r in got) / len(got) > 0.98


def test_language_of_odd_rows(spark):
    docs = odd(spark).withColumn("lang", F.when(F.length("text") > 1, F.lit("en")))
    model = language.fit(docs)
    got = language.identified(docs.withColumn("score", F.lit(1)), model).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    assert all((r["__lang"] == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in got)
    assert all(0 <= r["__score"] <= 1 for r in got)
    nothing = language.fit(docs.where("false"))
    assert {r["__lang"] for r in language.identified(docs, nothing).collect()} == {"und"}
    assert language.identified(docs.where("false"), model).count() == 0


ALPHABETS = {f"l{n:03}": "".join(chr(0x400 + 3 * n + k) for k in range(6)) for n in range(7)}


def written(rng, lang, words=12):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(words))


def test_languages_in_blocks_score_as_in_one(spark, monkeypatch):
    rng = random.Random(2)
    langs = [rng.choice(sorted(ALPHABETS)) for _ in range(150)]
    docs = documents(spark, [written(rng, k) for k in langs], langs).withColumnRenamed("source", "lang2").drop("lang")
    docs = docs.withColumnRenamed("lang2", "lang")
    at_once = {r.doc_id: (r["__lang"], r["__score"]) for r in language.identified(docs, language.fit(docs)).collect()}
    # Brute force: counts of every (language, cell) and sums of their logarithms.
    import numpy as np
    import pyarrow as pa

    rows = docs.select("doc_id", "text", "lang").collect()
    names, table, cells = sorted(set(langs)), {}, {}
    for r in rows:
        cells[r.doc_id] = language.grams(pa.array([r.text]))[0]
        np.add.at(table.setdefault(r.lang, np.full(language.CELLS, language.SMOOTHING)), cells[r.doc_id], 1)
    for r in rows:
        own = {k: np.log(langs.count(k) / len(langs)) + np.log(table[k] / table[k].sum())[cells[r.doc_id]].sum() for k in names}
        assert at_once[r.doc_id][0] == max(names, key=lambda k: own[k])
    monkeypatch.setattr(language, "BLOCK_LANGUAGES", 2)
    model = language.fit(docs)
    assert len(model.blocks) == 4
    clashing = docs.withColumn("__best", F.lit("x")).withColumn("__SUM", F.lit("y")).withColumn("__lang", F.lit("z"))
    got = language.identified(clashing, model).collect()
    assert {r["__best"] for r in got} == {"x"}
    for r in got:
        assert r["__lang"] == at_once[r.doc_id][0] and abs(r["__score"] - at_once[r.doc_id][1]) < 1e-9
    kept = language.recognised(clashing, F.lit(False))
    assert kept.columns == clashing.columns and sorted(kept.collect()) == sorted(clashing.collect())


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(4)
    langs = [rng.choice(sorted(ALPHABETS)[:2]) for _ in range(80)]
    texts = [written(rng, k, 30) for k in langs]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(20)]
    short = ["qzx vkw"]
    docs = documents(spark, texts + noise + short + [None, "", "1 2 !"], langs + [None] * 24)
    docs = docs.drop("lang").withColumn("lang", F.col("source"))
    kept = {r.doc_id for r in language.recognised(docs, F.lit(False)).collect()}
    assert kept == set(range(80)) | {100}
    # Without labels nothing is learned: only the texts without a letter go.
    assert language.recognised(docs, F.lit(True)).count() == 101
    assert language.recognised(docs.where("false"), F.lit(False)).count() == 0


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(40)) for _ in range(12)] + [None, ""]
    docs = documents(spark, [*texts, texts[0]]).withColumn("lang", F.lit("en"))
    names = "__lang __has __h __hash __pair __nth __one __size __copies __spans __items __old __shard __order __slot __range".split()
    for nth, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(nth))
    bench = spark.createDataFrame([("b", texts[1])], "item_id string, text string")
    for got in (language.recognised(docs, F.lit(False)), ngram_join.deduplicated(docs), decontaminate.removed(docs, bench),
                mixing.mixed(docs, whole=True), shard_tree.assigned(docs)):
        assert got.columns[: len(docs.columns)] == docs.columns
        assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(range(len(names)))}


def test_counts_of_grams():
    import numpy as np
    import pyarrow as pa

    together = language.grams(pa.array(["Ab c", None, "ab  c!", "12"]))
    assert together[2].tolist() == [True, False, True, False]
    alone = language.grams(pa.array(["ab c"]))
    assert np.array_equal(together[0][together[1] == 0], alone[0])


def test_grams_are_held_a_window_at_a_time(monkeypatch):
    import tracemalloc

    import numpy as np

    rng = random.Random(5)
    texts = pa.array([None if rng.random() < 0.1 else "".join(rng.choice("aé日😀 .Ж\u0130") for _ in range(rng.randint(0, 40))) for _ in range(200)])
    whole = language.grams(texts)
    assert whole[2].tolist() == [any(c.isalpha() for c in t or "") for t in texts.to_pylist()]
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(language, "WINDOW_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(language.grams(texts), whole))
    monkeypatch.undo()
    rows = pa.record_batch({"text": ["Öl und Wasser " * 150_000, "word " * 100_000]})
    logs = np.zeros((language.CELLS, 3), np.float32)
    language.letters()
    tracemalloc.start()
    try:
        language.Block(["a", "b", "c"], np.zeros(3), logs).judged(rows.column(0))
        assert tracemalloc.get_traced_memory()[1] < 50e6  # about 300 MB when all n-grams are held
    finally:
        tracemalloc.stop()


# -- n-gram join -----------------------------------------------------------------------------------


def shingles(text, width):
    words = BLANK.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[n : n + width]) for n in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_join(rows, width, numerator, denominator):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and denominator * shared >= numerator * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    least = {}
    for n, (key, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), key), key)
    return {key: (len(sets[n]), least[find(n)]) for n, (key, _) in enumerate(rows)}


def near_copies(seed, count=150):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(6)]
    texts = []
    for _ in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        texts.append(" ".join(words))
    return texts + [None, "", "one", "one two", "One two", " \n"]


@pytest.mark.parametrize("seed, width, numerator", [(1, 3, 9), (2, 5, 8)])
def test_join_against_brute_force(spark, monkeypatch, seed, width, numerator):
    texts = near_copies(seed)
    want = brute_join(list(enumerate(texts)), width, numerator, 10)
    got = ngram_join.linked(documents(spark, texts), width=width, numerator=numerator).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    # Without seeds every link has to come through the prefixes.
    monkeypatch.setattr(ngram_join.Join, "seeds", lambda self: self.spark.createDataFrame([], "a long, b long"))
    got = ngram_join.linked(documents(spark, texts), width=width, numerator=numerator).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_wide_parities_bound_the_difference():
    rng = random.Random(4)
    words = [f"w{n}" for n in range(4000)]
    near = [w if rng.random() < 0.99 else w + "x" for w in words]
    other = [f"v{n}" for n in range(2100)]
    texts = [" ".join(t) for t in (words, near, other, words[:1200], words[:20], [])]
    sets = ngram_join.Shingles(pa.array(texts), 3)
    flat, first = sets.wide_parities()
    parts = [flat[first[n] : first[n + 1]] for n in range(len(texts))]
    assert [len(p) for p in parts[4:]] == [0, 0]
    assert all(64 * len(p) >= 2 * sets.counts[n] for n, p in enumerate(parts[:4]))
    held = [set(sets.values[sets.first[n] : sets.first[n + 1]].tolist()) for n in range(len(texts))]
    for x, y in ((0, 1), (0, 2), (1, 2), (2, 3), (0, 3)):
        a, b = sorted((parts[x], parts[y]), key=len)
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        apart = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in a ^ b)
        assert 0.4 * min(len(held[x] ^ held[y]), 64 * len(a)) <= apart <= len(held[x] ^ held[y])


def test_long_sets_of_unlike_sizes(spark):
    """Sets whose wide parities differ in length, linked and not, against brute force."""
    rng = random.Random(8)
    base = [f"w{n}" for n in range(1050)]
    texts = [" ".join(base), " ".join(base[:960]), " ".join(base[:900]), " ".join(f"u{n}" for n in range(1000)),
             " ".join(w if rng.random() < 0.9 else w + "x" for w in base)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(documents(spark, texts)).collect()}
    assert got == {0: (1048, 0), 1: (958, 0), 2: (898, 0), 3: (998, 3), 4: (1048, 4)}


def test_deduplicated_leaves_one_of_each_component(spark):
    texts = near_copies(3)
    want = brute_join(list(enumerate(texts)), 5, 8, 10)
    got = sorted(r.doc_id for r in ngram_join.deduplicated(documents(spark, texts)).collect())
    assert got == sorted(k for k, (n, c) in want.items() if c == k or not n)


def test_join_of_odd_rows(spark):
    got = ngram_join.linked(odd(spark)).collect()
    assert len(got) == len(ODD_TEXTS) + 1
    assert sorted(r.component_id for r in got if r.n_shingles == 1 and r.doc_id in (5, 6)) == [5, 5]
    assert ngram_join.linked(odd(spark).where("false")).count() == 0
    kept = ngram_join.deduplicated(odd(spark))
    assert kept.columns == odd(spark).columns
    # Two null texts (one of them with a null key), and all different texts once.
    assert kept.count() == len(ODD_TEXTS) - 1
    named = odd(spark).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id")))
    assert ngram_join.linked(named).where("doc_id = 'k6'").first().component_id == "k5"


def test_components_of_chains(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(spark, links).collect()}
    assert got == {**{n: 0 for n in range(1, 41)}, 101: 100}


# -- mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    amount = 1.5 * sum(sizes.values())
    stopped = set()
    while True:
        free = [s for s in order if s not in stopped]
        rest = amount - sum(2 * sizes[s] for s in stopped)
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in stopped else level * weight[s] for s in order}
        stopped |= above


def test_targets_and_taken_words(spark):
    rng = random.Random(7)
    sources = [rng.choice(["a", "B", "c", "dd", "é", None]) for _ in range(400)]
    texts = [" ".join(["w"] * rng.randint(0, 300)) for _ in range(400)]
    sizes = Counter()
    for s, t in zip(sources, texts):
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    rows = mixing.plan(documents(spark, texts, sources)).select("id", "size", "source_size", "target", mixing.taken().alias("taken"), "pieces").collect()
    assert len(rows) == 400
    taken = Counter()
    for r in rows:
        s = sources[r.id]
        assert r["size"] == len(texts[r.id].split()) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 2 * r["size"]
        taken[s] += r.taken
        spans = sorted((p.copy, p.start, p.start + p.words) for p in r.pieces)
        assert all(a[0] < b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    per_shard = Counter(p.shard for r in rows for p in r.pieces)
    assert set(per_shard) == set(range(mixing.SHARDS))


def test_small_sources_reach_their_targets(spark):
    rng = random.Random(3)
    sources = [f"s{n % 60:02}" for n in range(180)]
    texts = [" ".join(["w"] * rng.choice([0, 1, 5, 20, 90])) for _ in range(180)]
    sizes, taken = Counter(), Counter()
    for s, t in zip(sources, texts):
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    for r in mixing.plan(documents(spark, texts, sources)).select("id", "pieces").collect():
        words = Counter((p.copy, w) for p in r.pieces for w in range(p.start, p.start + p.words))
        assert set(words.values()) <= {1} and all(p.words > 0 for p in r.pieces)
        taken[sources[r.id]] += len(words)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([("=a", 1000), ("=b", 37), ("=c", 0), ("~", 411)], "source string, quota long")
    got = {r.source: r.cuts for r in mixing.split_quotas(quotas, 16, "s").collect()}
    counts = {s: [b - a for a, b in zip([0, *c], c)] for s, c in got.items()}
    assert {s: sum(c) for s, c in counts.items()} == {"=a": 1000, "=b": 37, "=c": 0, "~": 411}
    totals = [sum(c[n] for c in counts.values()) for n in range(16)]
    assert max(totals) - min(totals) <= 1 and all(x >= 0 for c in counts.values() for x in c)


def test_hypergeometric_draws_follow_the_distribution(spark):
    from math import comb

    text = mixing.hypergeometric("rest", "marked", "drawn", "u")
    grid = spark.range(4000).select(F.lit(30).cast("long").alias("rest"), F.lit(11).cast("long").alias("marked"),
                                    F.lit(13).cast("long").alias("drawn"), ((F.col("id") + 0.5) / 4000).alias("u"))
    got = Counter(r.x for r in grid.select(F.expr(text).alias("x")).collect())
    for k in range(12):
        share = comb(11, k) * comb(19, 13 - k) / comb(30, 13) if 13 - k <= 19 else 0
        assert abs(got.get(k, 0) / 4000 - share) < 0.002


def test_the_draw_has_each_of_its_parts_once():
    text = mixing.hypergeometric("REST", "MARKED", "DRAWN", "UNIFORM")
    assert [text.count(part) for part in ("REST", "MARKED", "DRAWN", "UNIFORM")] == [1, 1, 1, 1]


def test_a_round_of_contraction_is_one_query(spark):
    def begun() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsparkSession.sharedState().statusStore().executionsCount()

    star = session.stage(spark.createDataFrame([(n, 1) for n in range(1, 6)], "a long, b long"))
    before = begun()
    roots = ngram_join.components(spark, star)
    assert begun() - before <= 3  # a look whether there are any, and two rounds
    assert sorted((r.node, r.root) for r in roots.collect()) == [(n, 1) for n in range(2, 6)]
    before = begun()
    roots = ngram_join.components(spark, star.where("a = b"))
    assert begun() - before <= 1
    assert roots.columns == ["node", "root"] and not roots.collect()


def test_mixed_documents_hold_the_taken_words(spark):
    rng = random.Random(11)
    sources = [rng.choice("abc") for _ in range(120)]
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 400))) for _ in range(120)]
    df = documents(spark, texts, sources).withColumn("pieces", F.lit(1))
    want = {r.id: r.taken for r in mixing.plan(df).select("id", mixing.taken().alias("taken")).collect()}
    got = mixing.mixed(df)
    assert got.columns == df.columns
    words = Counter()
    for r in got.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in words.items() if v}
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mixed(df.repartition(9)).collect()))


def test_mixing_of_odd_rows(spark):
    planned = mixing.plan(odd(spark))
    assert planned.count() == len(ODD_TEXTS) + 1
    assert mixing.plan(odd(spark).where("false")).count() == 0
    assert mixing.mixed(odd(spark).where("false")).count() == 0
    got = mixing.mixed(odd(spark))
    assert got.where("text IS NULL").count() == 1 and got.columns == odd(spark).columns
    wordless = documents(spark, [None, "", " "])
    assert [r.target for r in mixing.plan(wordless).collect()] == [0.0, 0.0, 0.0]


def test_pieces_of_a_shard_are_disjoint(spark):
    docs = documents(spark, ["w " * n for n in range(1, 200)], ["a" if n % 3 else "b" for n in range(1, 200)])
    rows = mixing.shard_pieces(mixing.plan(docs), 4).collect()
    seen = Counter((r.id, r.copy, w) for r in rows for w in range(r.start, r.start + r.words))
    assert set(seen.values()) == {1}


def test_pipeline_mix_leaves_no_holes(spark):
    import corpus_pipeline

    rng = random.Random(13)
    sources = [rng.choice("abc") for _ in range(150)]  # c has a third of all and weighs little: not even one pass is taken of it
    texts = ["".join(f"w{rng.randint(0, 99)}" + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randint(0, 500))) for _ in range(150)]
    df = documents(spark, texts, sources)
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    sizes, taken, cut = Counter(), Counter(), Counter()
    for source, text in zip(sources, texts):
        sizes[source] += len(text.split())
    for r in got:
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        taken[r.source] += len(r.text.split())
        cut[r.source] += r.text != texts[r.doc_id]
    assert max(cut.values()) <= 1
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and want["c"] < sizes["c"]
    # Rows lie by shard and spot, and every copy in the shard the tree dealt it to.
    planned = mixing.plan(df, whole=True).select("id", F.explode("pieces").alias("p")).select("id", "p.*").collect()
    places = {(p.id, p.words): (p.shard, p.spot) for p in sorted(planned, key=lambda p: p.copy) if p.copy == 1}
    once = {p.id: (p.shard, p.spot) for p in planned if p.copy == 0 and p.id not in {k for k, _ in places}}
    order = [once[r.doc_id] for r in got if r.doc_id in once]
    assert len(order) > 20 and order == sorted(order)


# -- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    texts = near_copies(5, 80)
    passage = " ".join(f"b{n}" for n in range(14))
    texts[3] = texts[3] + " " + passage
    texts.append(passage)
    sources = [f"s{n % 4}" for n in range(len(texts))]
    documents(spark, texts, sources).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for nth, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{nth}")
        docs = spark.read.parquet(f"{tmp_path}/out{nth}")
        seen.append(docs.collect())
        if nth < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in seen[0]} == {n for n, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    left = [(r.doc_id, r.text) for r in seen[0]]
    want = brute_join(left, 5, 8, 10)
    assert {r.doc_id for r in seen[1]} == {k for k, (_, c) in want.items() if c == k}
    assert not any(passage in r.text for r in seen[2])
    assert {r.doc_id for r in seen[1]} - {r.doc_id for r in seen[2]} == {len(texts) - 1}
    total = sum(len(r.text.split()) for r in seen[2])
    assert abs(sum(len(r.text.split()) for r in seen[3]) - 1.5 * total) < 4 * 2 * mixing.BLOCK
    slots = defaultdict(list)
    for r in seen[4]:
        slots[r.shard].append(r.slot)
    assert len(seen[4]) == len(seen[3]) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, seen[4]))
