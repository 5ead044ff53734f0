"""The registered queries of the operators, with SQL where SQL can express them.

Each query applies its operator, with production parameters, to the whole of
its table and derives the contracted columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.llm import bpe, embedding_dedup, exact_dedup, hmm, language_id, packing, paragraph_dedup, prefix_trie, simhash, suffix_dedup, warc, whitening, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to paragraphs that stand elsewhere before."""
    return paragraph_dedup.paragraph_dedup(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), valid AS (
  SELECT * FROM vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM vectors
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), component AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN component ON vec_id = node LEFT JOIN degree ON vec_id = a
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op4_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden-Markov log10 probability of every document."""
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), _word_bpe())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after the way through ARC and WARC archives."""
    return warc.archive_pages(_table(spark, sf_dir, "pages")).drop("record_id", "url")


OP6_SQL = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, coalesce(html, '') AS body FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM sized
)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM grouped
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return bpe.digest_documents(_table(spark, sf_dir, "documents"), _word_bpe())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses to strings of 200 bytes that stand twice."""
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; two of three folds are learned from."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and verdict of every document among those of equal text."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("part", "row")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct opening of the rebuilt conversations."""
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
               lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)),
             4294967295) % 6 AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h
), paths AS (
  SELECT conv_id, row_number() OVER own AS depth, length(text) AS chars,
         list(sha256(to_json([role, text]))) OVER own AS path
  FROM rebuilt WINDOW own AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), ends AS (
  SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), nodes AS (
  SELECT p.path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.chars) AS chars,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)
                           FILTER (p.depth = e.depth), '')) AS ends_sha256
  FROM paths p JOIN ends e USING (conv_id) GROUP BY p.path, p.depth
), linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.path[:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1]
), above AS (
  SELECT path, depth, path AS top, depth AS top_depth FROM linked
  UNION ALL SELECT l.path, l.depth, l.path[:d], d
  FROM linked l, unnest(range(l.depth)) AS r(d)
), subtree AS (
  SELECT a.top, a.top_depth, count(*) FILTER (l.n_children = 0) AS n_leaves,
         sum((l.n_convs - 1) * l.chars) AS saved_tokens
  FROM above a JOIN linked l ON l.path = a.path AND l.depth = a.depth GROUP BY a.top, a.top_depth
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, l.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, l.ends_sha256
FROM linked l JOIN subtree s ON s.top = l.path AND s.top_depth = l.depth
"""


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprint of every document and of its edited text."""
    return winnowing.winnow_documents(_table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    """Winnowing by its definition: one row a code point, windows over rows."""
    gram, window, prime, base = winnowing.GRAM, winnowing.WINDOW, winnowing.PRIME, winnowing.BASE
    rolled = " + ".join(f"lead(c, {j}) OVER w * {pow(base, gram - 1 - j, prime)}::BIGINT % {prime}"
                        for j in range(gram))
    return f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS t, count(*) OVER () AS n,
         row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r FROM documents
), paired AS (
  SELECT a.doc_id, a.t, b.t AS follow,
         left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS edited
  FROM ordered a JOIN ordered b ON b.r = a.r % a.n + 1
), texts AS (
  SELECT t, row_number() OVER () AS id, length(t) AS n
  FROM (SELECT t FROM paired UNION SELECT edited FROM paired)
), codes AS (
  SELECT id, n, unnest(list_transform(string_split(t, ''), lambda x: unicode(x)))::BIGINT AS c,
         generate_subscripts(string_split(t, ''), 1) - 1 AS pos
  FROM texts WHERE n > 0
), hashed AS (
  SELECT id, pos, n, ({rolled}) % {prime} AS h FROM codes
  WINDOW w AS (PARTITION BY id ORDER BY pos)
), keyed AS (
  SELECT id, pos, n, h * 4294967296 + (4294967295 - pos) AS k FROM hashed WHERE h IS NOT NULL
), chosen AS (
  SELECT id, pos, n, min(k) OVER (PARTITION BY id ORDER BY pos
                                  ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS k FROM keyed
  QUALIFY pos <= greatest(n - {gram + window - 1}, 0)
), short AS (
  SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(t, ''),
           lambda x: unicode(x)::BIGINT)), lambda h, c: (h * {base} + c) % {prime})
           * 4294967296 + 4294967295 AS k
  FROM texts WHERE n BETWEEN 1 AND {gram - 1}
), entries AS (
  SELECT DISTINCT id, k FROM chosen UNION ALL SELECT id, k FROM short
), printed AS (
  SELECT id, list(DISTINCT k >> 32) AS hashes,
         sha256(string_agg((4294967295 - (k & 4294967295)) || ':' || (k >> 32), ','
                           ORDER BY 4294967295 - (k & 4294967295))) AS print
  FROM entries GROUP BY id
), prints AS (
  SELECT t, coalesce(hashes, []) AS hashes, coalesce(print, sha256('')) AS print
  FROM texts LEFT JOIN printed USING (id)
)
SELECT p.doc_id, length(p.t)::BIGINT AS n_chars, sha256(p.edited) AS edited_sha256,
       a.print AS fingerprint, e.print AS edited_fingerprint,
       CASE WHEN len(a.hashes) + len(e.hashes) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(a.hashes, e.hashes))::DOUBLE
                 / len(list_distinct(list_concat(a.hashes, e.hashes))) END AS near_edited,
       CASE WHEN len(a.hashes) + len(f.hashes) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(a.hashes, f.hashes))::DOUBLE
                 / len(list_distinct(list_concat(a.hashes, f.hashes))) END AS near_next
FROM paired p JOIN prints a ON a.t = p.t JOIN prints e ON e.t = p.edited JOIN prints f ON f.t = p.follow
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector along the first 16 components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_paragraph_dedup": op1_paragraph_dedup,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_simhash": op3_simhash,
        "op4_hmm_scoring": op4_hmm_scoring,
        "op5_packing": op5_packing,
        "op6_warc": op6_warc,
        "op7_bpe": op7_bpe,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_language_id": op9_language_id,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_winnowing": op12_winnowing,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2_SQL, "op6_warc": OP6_SQL, "op10_exact_dedup": OP10_SQL,
            "op11_prefix_trie": OP11_SQL, "op12_winnowing": _op12_sql()}
