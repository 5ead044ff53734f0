import random

import numpy as np
import pytest
import xxhash

from blocklens.llm import simhash as sh
from tests.llm.conftest import ODD


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, limit):
    label = {k: k for k in range(len(fps))}
    for _ in range(len(fps)):
        moved = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= limit and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
        if not moved:
            break
    out = []
    for i in range(len(fps)):
        known = [ids[j] for j in range(len(fps)) if label[j] == label[i] and ids[j] is not None]
        out.append(min(known) if known else None)
    return out


@pytest.mark.parametrize("text", [t for _, t in ODD if t is not None] + ["A b C", "Ä a b c d", "x\x0by\x1cz"])
def test_fingerprint(text):
    assert sh.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_is_the_engines_hash(spark):
    row = spark.sql("select xxhash64('one two three') as h").first()
    assert np.int64(row.h) == np.uint64(sh.fingerprint("One two THREE")).astype(np.int64)


@pytest.mark.parametrize("limit,bucket", [(3, sh.BUCKET), (3, 3), (1, 2)])
def test_links_connect_what_brute_force_connects(spark, limit, bucket):
    """Dense clusters, also with keys split by the finer level."""
    from blocklens.llm.common import connected_components
    rng = random.Random(limit * 100 + bucket)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = sh.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), limit, bucket)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(signed, fps, limit)
    assert [got.get(s, s) for s in signed] == want


def test_chain_budgets_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        found = [sh.chain_distance(np.array([a]), np.array([b]), np.array([s]))[0] <= 3 for s in range(8)]
        assert any(found)


def test_odd_rows_and_keeping_one(make_docs):
    docs = make_docs(ODD)
    got = sh.near_duplicates(docs).collect()
    assert len(got) == len(ODD)
    ids = [r.doc_id for r in got]
    fps = [int(np.int64(r.fp).astype(np.uint64)) for r in got]
    assert [r.component_id for r in got] == brute_components(ids, fps, 3)
    out = sh.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    groups = set(brute_components(ids, fps, 3))
    assert out.count() == len(groups)


def test_empty_table(make_docs):
    assert sh.near_duplicates(make_docs([])).count() == 0
    assert sh.drop_near_duplicates(make_docs([])).count() == 0
