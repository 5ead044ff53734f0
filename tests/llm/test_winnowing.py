import hashlib
import random

import pytest
from pyspark.sql import functions as F

from blocklens.llm import winnowing as wn
from tests.llm.conftest import ODD

K, W, P, B = wn.GRAM, wn.WINDOW, wn.PRIME, wn.BASE


def rolling(text):
    """Karp-Rabin hashes by the plain recurrence."""
    codes = [ord(c) for c in text]
    out, h, top = [], 0, pow(B, K - 1, P)
    for i, c in enumerate(codes):
        if i >= K:
            h = (h - codes[i - K] * top) % P
        h = (h * B + c) % P
        if i >= K - 1:
            out.append(h)
    return out


def brute(text):
    """[(position, hash)] of winnowing by its definition."""
    if not text:
        return []
    if len(text) < K:
        h = 0
        for c in text:
            h = (h * B + ord(c)) % P
        return [(0, h)]
    hashes, out = rolling(text), []
    for at in range(max(1, len(hashes) - W + 1)):
        window = [(h, -(at + i)) for i, h in enumerate(hashes[at:at + W])]
        h, place = min(window)
        if not out or out[-1] != (-place, h):
            out.append((-place, h))
    return out


def digest(entries):
    return hashlib.sha256(",".join(f"{p}:{h}" for p, h in entries).encode()).hexdigest()


def near(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(ordered):
    """Rows of the contract for (doc_id, text) in their order."""
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, follow = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        own, new = brute(text), brute(edited)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own),
                    digest(new), near(own, new), near(own, brute(follow))))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdeé日🙂") for _ in range(rng.randrange(1, 9))) for _ in range(words))


def test_entries_are_those_of_the_definition(spark):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 3, 5, 6, 7, 12, 40, 200)] + [
        "x" * 500, "ab" * 3000, "", "a", prose(rng, 2000), "q" * (wn.PIECE + 5), prose(rng, 900)[:wn.PIECE + 40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in wn.fingerprints(df).collect():
        assert [(e.position, e.hash) for e in r.fingerprint] == brute(texts[r.doc_id]), len(texts[r.doc_id])


def test_whole_contract(make_docs):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 2, 4, 8, 30, 120])) for _ in range(150)]
    texts += [texts[3], None, "", texts[100], prose(rng, 3000), "word " * 3000]
    ids = rng.sample(range(-50, 2 ** 61), len(texts) - 1) + [2 ** 60 + 1]
    ordered = sorted(zip(ids, texts), reverse=True, key=lambda r: r[0])
    assert rows_of(wn.winnow_documents(make_docs(ordered))) == expected(ordered)


@pytest.mark.parametrize("bucket", [1, 2, 3, 64])
def test_next_in_any_buckets(make_docs, bucket):
    rows = [(i * 7 % 41, f"text {i}") for i in range(41)]
    got = wn.with_next(make_docs(rows), bucket=bucket).select("doc_id", F.col("next.text").alias("t")).collect()
    ordered = sorted(rows, reverse=True)
    assert sorted((r.doc_id, r.t) for r in got) == sorted(
        (d, ordered[(i + 1) % 41][1]) for i, (d, _) in enumerate(ordered))


def test_odd_rows_and_repeated_rows(make_docs):
    got = rows_of(wn.winnow_documents(make_docs(ODD)))
    assert len(got) == len(ODD)
    assert sorted((r[0], r[1], r[3]) for r in got if r[0] is not None) == sorted(
        (d, len(t or ""), digest(brute(t or ""))) for d, t in ODD if d is not None)
    assert sum(r[0] is None for r in got) == 2 and all(0 <= x <= 1 for r in got for x in r[5:])
    # a third of all rows are one row: all but the last have their like as next
    many = [(5, "same text as all the others of this group")] * 40 + [(i, f"own text of {i}") for i in range(10, 90)]
    ordered = sorted(many, reverse=True)
    assert rows_of(wn.winnow_documents(make_docs(many))) == expected(ordered)


def test_one_row_and_empty_table(make_docs):
    assert rows_of(wn.winnow_documents(make_docs([(3, "a single text of some length, longer than a window")]))) == \
        expected([(3, "a single text of some length, longer than a window")])
    empty = wn.winnow_documents(make_docs([]))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                             "near_edited", "near_next"]


def test_shared_passage_of_guaranteed_length_is_found(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(wn.GUARANTEE))
    pairs = [(prose(rng, 20) + passage + prose(rng, 15), prose(rng, 9) + passage + prose(rng, 31)) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    assert df.select(wn.likeness(wn.hashes(wn.winnow(F.col("a"))), wn.hashes(wn.winnow(F.col("b")))).alias("s")).where("s = 0").count() == 0


def test_no_python_on_the_main_path(spark, make_docs):
    plan = wn.winnow_documents(make_docs([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
