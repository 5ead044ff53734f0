import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from blocklens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path long, id string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 5, "i", None) for r in rows], SCHEMA).repartition(3)


def rebuild(rows, group=100, most=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))]
           for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c % group if c >= 0 else -(-c % group))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    saved, leaves = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        text = len(path[-1][1]) if path else 0
        own = children.get(path, [])
        saved[path] = (len(nodes[path]) - 1) * text + sum(saved[x] for x in own)
        leaves[path] = sum(leaves[x] for x in own) if own else 1
    out = []
    for path, ids in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(convs[c]) == len(path)))
        out.append((min(ids), len(path), min(nodes[path[:-1]]) if path else None, len(ids),
                    len(children.get(path, [])), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def direct(spark, convs, chunk=pt.CHUNK):
    """The trie of conversations as they are, without openings."""
    lengths = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, length long")
    steps = [(c, d + 1, r, t) for c, turns in convs.items() for d, (r, t) in enumerate(turns)]
    steps = spark.createDataFrame(steps, "conv_id long, depth long, role string, text string").select(
        "conv_id", "depth", F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(3), "text", "role").alias("h2"), F.char_length("text").cast("long").alias("chars"))
    return rows_of(pt.trie_nodes(lengths, steps.repartition(3), chunk))


def test_rebuilt_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in rng.sample(range(-150, 420), 160) + [2 ** 60 + 1, 2 ** 60 + 3]:
        own = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé", "日本", f"t{c}"]))
               for t in range(rng.randrange(1, 10))]
        rng.shuffle(own)
        rows += own
    rows += [(7, None, None, None), (None, 1, "user", "nobody's"), (None, None, None, None)]
    assert rows_of(pt.conversation_trie(frame(spark, rows))) == brute(rebuild(rows))


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 4), (3, 1)])
def test_random_tries_whatever_the_chunk(spark, seed, chunk):
    rng = random.Random(seed)
    convs = {}
    for c in range(120):
        mother = convs[rng.randrange(c)] if c and rng.random() < 0.8 else []
        convs[c] = mother[:rng.randrange(len(mother) + 1)] + [
            ("u", rng.choice("abc")) for _ in range(rng.randrange(0, 6))]
    assert direct(spark, convs, chunk) == brute(convs)


def test_hot_conversation_and_common_openings(spark):
    same = [("u", "hello"), ("a", "hello to you"), ("u", "bye")]
    convs = {c: list(same) for c in range(200)}                    # one conversation a third of all
    convs |= {c: same[:1] + [("a", f"answer {c}")] for c in range(200, 400)}      # one opening
    convs |= {c: [("u", f"own {c}")] for c in range(400, 600)}
    assert direct(spark, convs) == brute(convs)


def test_path_with_a_branch_at_every_depth(spark):
    spine = [("u", f"s{i}") for i in range(40)]
    convs = {i: spine[:i] + [("a", "off")] for i in range(40)} | {100: spine, 101: spine[:7]}
    assert direct(spark, convs) == brute(convs)
    assert direct(spark, convs, 16) == brute(convs)


def test_long_conversation_in_chunks(spark):
    turns = [("u", f"turn {i % 9}") for i in range(300)]
    convs = {1: turns, 2: turns[:150], 3: turns[:150] + [("a", "x")] * 3, 4: turns + [("a", "y")]}
    assert direct(spark, convs, 64) == brute(convs)


def test_turnless_and_empty(spark):
    assert direct(spark, {1: [], 2: []}) == brute({1: [], 2: []})
    empty = pt.conversation_trie(frame(spark, []))
    assert empty.count() == 0 and empty.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert pt.conversation_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_ties_and_repeated_rows_are_turns_of_their_own(spark):
    rows = [(0, 1, "u", "same")] * 3 + [(0, None, "u", "first")] + [(1, 5, "u", "x"), (1, 5, "u", "y")]
    got = pt.conversation_trie(frame(spark, rows)).collect()
    convs = rebuild(rows)
    assert max(r.depth for r in got) == max(len(t) for t in convs.values())
    assert sum(r.n_convs for r in got) == sum(len(t) + 1 for t in convs.values())


def test_two_fattest_number(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.withColumn("f", pt.two_fattest(F.col("a"), F.col("b"))).collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_digests_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(pt, "LIST_IDS", 7)
    ends = [(n, c) for n in range(4) for c in random.Random(n).sample(range(-50, 5000), 30 * n + 1)]
    got = pt.ends_digests(spark.createDataFrame(ends, "id long, conv_id long").repartition(5)).collect()
    assert {r.id: r.sha for r in got} == {n: hashlib.sha256(",".join(map(str, sorted(
        c for m, c in ends if m == n))).encode()).hexdigest() for n in range(4)}
