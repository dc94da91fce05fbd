"""SimHash, conversation repair and the Merkle manifest against brute force and odd rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import conversations, merkle, queries, simhash

LOWER = {n: n + 32 for n in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " \n", "é", "A b", "same text here", "same text here", "x" * 50_000, "Word " * 3_000, "日本語 текст ümlaut\tend"]


def documents(spark, texts, ids=None, sources=None):
    ids = ids or range(len(texts))
    rows = [(i, t, None if n % 3 else "en", (sources or ["s"] * len(texts))[n], None if t is None else len(t))
            for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
        "key", F.lit("x")).withColumn("fp", F.lit(1.5)).withColumn("root", F.lit(0))


# -- SimHash ---------------------------------------------------------------------------------------


def brute_fingerprint(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[n : n + width]) for n in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=4):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                label[find(a)] = find(b)
    least = {}
    for n, i in enumerate(ids):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [least.get(find(n)) for n in range(len(prints))]


def near_copies(seed, count):
    source = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    texts = []
    while len(texts) < count:
        words = [source.choice(vocabulary) for _ in range(source.choice([2, 5, 40, 120]))]
        texts.append(" ".join(words))
        for _ in range(source.choice([0, 0, 1, 4])):
            words = list(words)
            words[source.randrange(len(words))] = source.choice(vocabulary)
            texts.append("\n".join(words).upper() if source.random() < 0.3 else " ".join(words))
    return texts[:count] + texts[:10]


@pytest.mark.parametrize("tile_rows", [20, 8192])
def test_simhash_against_brute_force(spark, tile_rows):
    texts = near_copies(3, 250) + ODD_TEXTS
    ids = [None if n % 37 == 5 else n * 3 % 1000 for n in range(len(texts))]
    got = simhash.linked(documents(spark, texts, ids), tile_rows=tile_rows).collect()
    prints = [brute_fingerprint(t) for t in texts]
    expected = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(prints, ids))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert len({c for _, _, c in expected}) < len(texts) - 40


def test_hash_is_sparks_own(spark):
    texts = ["one two three four", "Überfall im Wald", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    lowered = [t.translate(LOWER) for t in texts]
    assert [r[0] & (1 << 64) - 1 for r in rows][2] == xxhash.xxh64_intdigest(lowered[2].encode(), 42) == brute_fingerprint("X")


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = pa.array([" ".join(near_copies(1, 60)), None, "a b c d e"])
    whole = simhash.fingerprints(text)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    assert (simhash.fingerprints(text) == whole).all()
    assert int(whole[0]) == brute_fingerprint(text[0].as_py()) and whole[1] == 0


def test_ties_of_one_large_group():
    """Thousands of fingerprints within the radius of each other: fewer links than fingerprints."""
    one = np.uint64(0x123456789ABCDEF0)
    near = np.unique(np.array([one ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(64)], np.uint64))
    far = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64))
    a, b = simhash.ties(near, far, 4)
    assert len(a) == 0 or len(a) < len(near) + len(far)
    a, b = simhash.ties(near, None, 4)
    assert len(a) == len(near) - 1 and len(set(b.tolist())) == 1


def test_tiles_meet_wherever_counts_allow():
    source = np.random.default_rng(5)
    fp = np.unique(source.integers(0, 1 << 63, 4000).astype(np.uint64))
    fp = np.concatenate([fp, fp[:2000] ^ np.uint64(0x8001000000000101)])
    ones = np.stack([np.bitwise_count(fp >> np.uint64(16 * q) & np.uint64(0xFFFF)) for q in range(4)], axis=1).astype(np.int64)
    cells = (ones * 17 ** np.arange(4)).sum(axis=1)
    known, counts = np.unique(cells, return_counts=True)
    tiles = simhash.Tiles(known, counts, 50)
    home = tiles.homes(cells, np.arange(len(fp)))
    assert set(home.tolist()) <= set(range(tiles.tiles.sum())) and np.bincount(home).max() <= 100
    for n in range(2000):
        a, b = int(home[n]), int(home[len(fp) - 2000 + n])
        assert a in tiles.met(b, 4) and b in tiles.met(a, 4)
    assert any(len(tiles.met(t, 4)) < tiles.tiles.sum() for t in range(tiles.tiles.sum()))


def test_simhash_of_empty_table(spark):
    assert simhash.linked(documents(spark, ["a"]).where("false")).count() == 0


# -- conversation repair ---------------------------------------------------------------------------

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        lot = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def brute_repair(turns):
    kinds, seen = [], set()
    for _, role, text in turns:
        said = text.strip(SPACES)
        kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(n, state, room):
        """(cost, audit, lines) of everything from turn n on."""
        found = [(0, "", ())] if n == len(turns) and state in ("", "a") else []

        def go(cost, edit, line, then):
            if then:
                found.append((cost + then[0], edit + then[1], ((line,) if line is not None else ()) + then[2]))

        for initial, name in (("u", "user"), ("a", "assistant")):
            if room and initial in follows[state]:
                go(2, "I", f"{name}:", best(n, initial, room - 1))
        if n < len(turns):
            _, role, text = turns[n]
            go(3, "D", None, best(n + 1, state, 3))
            if kinds[n] not in ("blank", "duplicate"):
                cut = kinds[n] == "truncated"
                if role[:1] in follows[state]:
                    go(cut, "K", f"{role}:{text}", best(n + 1, follows[state][role[:1]], 3))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in follows[state]:
                        go(2 + cut, "R", f"{name}:{text}", best(n + 1, initial, 3))
        return min(found, default=None)

    for n in range(len(turns), 0, -40):
        for state in ("", "s", "u", "a"):
            best(n, state, 3)
    cost, audit, lines = best(0, "", 3)
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversation_rows(seed):
    source = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        size = 300 if conv == 7 else source.choice([0, 1, 2, 3, 5, 9])
        for turn in range(size):
            role = source.choice(["user", "assistant"]) if source.random() < 0.3 else ("user", "assistant")[turn % 2]
            if turn == 0 and source.random() < 0.5:
                role = "system"
            role = source.choice([None, "", "tool", "superuser"]) if source.random() < 0.05 else role
            text = source.choice(["Hi.", "Same?", "no end", " \n", "a. \t", None, "Ünder!", "x" * 2000])
            rows.append((conv, None if source.random() < 0.05 else turn + source.choice([0, 0, 0, 2]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("seed,least", [(1, 64), (2, 3)])
def test_conversations_against_brute_force(spark, monkeypatch, tmp_path, seed, least):
    monkeypatch.setattr(conversations, "LEAST_BLOCK", least)
    rows = conversation_rows(seed)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn(
        "kind", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    assert got.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        turns = brute_damage(own)
        expected = brute_repair(turns) if turns else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
        assert got[conv] == expected, conv


def test_repaired_turns_are_legal(spark):
    rows = spark.createDataFrame(conversation_rows(4), "conv_id long, turn long, role string, text string")
    _, edits = conversations.repair(conversations.damaged(rows))
    out = {}
    for r in sorted(conversations.repaired(edits).collect(), key=lambda r: (r.conv_id or -1, r.pos, r.nth)):
        out.setdefault(r.conv_id, []).append(r.role[:1])
    assert out and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in out.values())


def test_conversations_of_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found, edits = conversations.repair(conversations.damaged(rows))
    assert found.count() == 0 and conversations.digested(edits).count() == 0


# -- Merkle manifest -------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, text):
    fields = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_tree(nodes):
    """Root, and for each node the levels of (place, siblings)."""
    paths, member = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[n : n + 16] for n in range(0, len(nodes), 16)]
        for n, at in enumerate(member):
            run = runs[at // 16]
            paths[n].append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        member = [at // 16 for at in member]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def brute_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row.source, []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)))
        trees[source] = own, *brute_tree([brute_leaf(r, r.text) for r in own])
    root, tops = brute_tree([trees[s][1] for s in order])
    out = []
    for source, top in zip(order, tops):
        own, subroot, paths = trees[source]
        for row, path in zip(own, paths):
            leaf = node = brute_leaf(row, row.text)
            if row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0 and row.text is not None:
                node = brute_leaf(row, row.text.translate(LOWER))
            for place, siblings in path + top:
                node = sha("".join(siblings[:place] + [node] + siblings[place:]))
            proof = sha("".join(x for _, siblings in path + top for x in siblings))
            out.append((row.doc_id, source, leaf, subroot, root, proof, node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_against_brute_force(spark, levels):
    source = random.Random(9)
    texts = ODD_TEXTS * 3 + [f"Text {n}" for n in range(670)]
    names = [source.choice(["big", "big", None, "é", "z", f"s{n % 40}"]) for n in range(len(texts))]
    ids = [None if n % 50 == 3 else n // 2 for n in range(len(texts))]
    docs = documents(spark, texts, ids, names)
    got = merkle.manifest(docs, levels=levels).select(
        "doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(docs.collect())))
    assert 0.1 < sum(not r.verified for r in got) / len(got) < 0.3


def test_witnesses_lead_to_the_root(spark):
    docs = documents(spark, [f"Text {n}" for n in range(40)], sources=["a"] * 39 + ["b"])
    for row in merkle.manifest(docs, witnesses=True).collect():
        assert merkle.folded(row.leaf, row.witness) == row.root
        assert merkle.proof(row.witness) == row.proof_sha256


def test_manifest_of_small_tables(spark):
    assert merkle.manifest(documents(spark, ["a"]).where("false")).count() == 0
    only = merkle.manifest(documents(spark, ["a"])).first()
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == sha("")
