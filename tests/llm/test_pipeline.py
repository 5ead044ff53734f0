"""The pipeline against brute force, stage by stage, and as a whole."""
import collections

import corpus_pipeline as cp
from blocklens.llm import simhash
from blocklens.llm.common import stage
from tests.llm.test_simhash import brute_components
from tests.llm.test_suffix_dedup import brute as brute_suffix

SF = "/root/testdata/sf0.001"


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, step in cp.STAGES[:4]:
        new = stage(step(spark, docs, SF), f"t-{name}")
        assert new.columns == columns and new.dtypes == docs.dtypes
        kept[name] = (docs.collect(), new.collect())
        docs = new
    before, after = kept["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(not any(c.isalpha() for c in r.text) for r in before if r.doc_id in gone) or len(gone) < 5
    before, after = kept["exact_dedup"]
    last = {}
    for r in before:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(last.values())
    before, after = kept["simhash_near_dedup"]
    ids = [r.doc_id for r in before]
    groups = brute_components(ids, [simhash.fingerprint(r.text) for r in before], 3)
    assert sorted(r.doc_id for r in after) == sorted(set(groups))
    before, after = kept["suffix_array_dedup"]
    want = {i: (n, gone) for i, n, gone, _, _ in brute_suffix([(r.doc_id, r.text) for r in before], 200)}
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        n, removed = want[r.doc_id]
        if r.doc_id in texts:       # a character cut in two goes with its bytes
            assert 0 <= n - removed - len(texts[r.doc_id].encode()) <= 8
            assert removed or texts[r.doc_id] == r.text
        else:
            assert removed > 0.9 * n
    packed = cp.pack_sequences(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(texts)
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_run_gives_the_last_stages_rows(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_queries_are_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q[:q.index("_") + 1] for q in names if q.startswith("op")}
    assert "pipeline" in names and set(e.oracle_sql()) <= names


def test_packing_stage_handles_an_empty_corpus(spark, make_docs):
    docs = make_docs([])
    for _, step in cp.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 0
