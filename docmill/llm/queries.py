"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, centroids, codes, common, embedding_dedup, exact_dedup, jaccard, line_dedup, packing, pipeline, sharding, simhash, substring_dedup, toxicity, url_filter

#: The vocabulary of op2 and op7.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that at least five documents hold, kept in the largest doc_id alone."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, rid, u.pos, u.line, translate(trim(u.line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS own FROM documents) d,
    LATERAL (SELECT unnest(own) AS line, unnest(range(len(own))) AS pos) u
), keys AS (SELECT k, max(doc_id) AS keep_id FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, keep_id IS NOT NULL AND doc_id <> keep_id AS gone FROM lines l LEFT JOIN keys USING (k)) GROUP BY rid, doc_id
"""


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY, with_ids=False)


#: Bytes of text in a shard of op3, small enough that small tables split as well.
SHARD_BYTES = 64 << 10

#: (host, path, verdict) of op9.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extendible-hash shards of documents by doc_id."""
    return sharding.shard(_table(spark, sf_dir, "documents", "doc_id", "text"), SHARD_BYTES)


OP3_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), sums AS (
  SELECT depth, h >> (60 - depth)::INT AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows
  FROM hashed, (SELECT unnest(range(0, 31)) AS depth) GROUP BY ALL
), leaves AS (
  SELECT s.* FROM sums s LEFT JOIN sums p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1
  WHERE s.shard_bytes <= {SHARD_BYTES} AND (s.depth = 0 OR p.shard_bytes > {SHARD_BYTES})
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, CAST(depth AS INTEGER) AS depth,
  CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_rows AS BIGINT) AS shard_rows
FROM hashed JOIN leaves ON h >> (60 - depth)::INT = prefix
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the sentences of spans that stand earlier in the corpus."""
    return substring_dedup.dedup_spans(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of documents, the largest doc_id kept."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = """
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
groups AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM folded JOIN groups USING (norm)
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts; every twentieth doc_id is searched among all fingerprints."""
    with common.scratch() as keep:
        keep(prints := common.saved(simhash.fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text")), "prints"))
    return simhash.near_counts(prints)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded texts of documents."""
    return bpe.encode_digests(_table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets overlap by three quarters."""
    return jaccard.similar_groups(_table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of pages."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


OP9_SQL = f"""
WITH rules(rhost, rpath, ruled) AS (VALUES {", ".join(map(str, URL_RULES))}),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.ruled, 'allow') AS verdict
FROM (SELECT page_id, host, path, max(CASE WHEN ruled IS NULL THEN NULL ELSE {{'n': length(rhost || rpath), 'ruled': ruled, 'rule': rhost || rpath}} END) AS best
      FROM split LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of documents."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of embeddings by exact integer k-means."""
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _op11_round(n: int) -> str:
    """The assignment to the centroids c{n}, and the centroids after it."""
    return f"""
a{n} AS (
  SELECT vec_id, v, unnest(best, recursive := true) FROM (
    SELECT vec_id, v, min({{'distance': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'cluster': cluster}}) AS best
    FROM kept, c{n} GROUP BY vec_id, v)
), m{n} AS (
  SELECT cluster, list(s ORDER BY i) AS c FROM (
    SELECT cluster, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS s FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY cluster, i)
  GROUP BY cluster
), c{n + 1} AS (SELECT c{n}.cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS cluster, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16
), {", ".join(_op11_round(n) for n in range(4))}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of embeddings, and their errors."""
    return codes.code_report(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def _op12_round(n: int) -> str:
    """The assignment of all parts to the entries e{n}, and the entries after it."""
    return f"""
a{n} AS (
  SELECT vec_id, label, p, x0, x1, x2, x3, unnest(best, recursive := true) FROM (
    SELECT q.vec_id, q.label, q.p, x0, x1, x2, x3,
      min({{'d': (x0 - y0) * (x0 - y0) + (x1 - y1) * (x1 - y1) + (x2 - y2) * (x2 - y2) + (x3 - y3) * (x3 - y3), 'entry': entry}}) AS best
    FROM parts q JOIN e{n} ON q.p = e{n}.p GROUP BY ALL)
), m{n} AS (
  SELECT p, entry, {", ".join(f"floor(sum(x{j})::DOUBLE / count(*))::BIGINT AS z{j}" for j in range(4))} FROM a{n} GROUP BY p, entry
), e{n + 1} AS (SELECT e.p, e.entry, {", ".join(f"coalesce(z{j}, y{j}) AS y{j}" for j in range(4))} FROM e{n} e LEFT JOIN m{n} m ON e.p = m.p AND e.entry = m.entry)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (
  SELECT vec_id, label, p, {", ".join(f"v[4 * p + {j + 1}] AS x{j}" for j in range(4))} FROM kept, (SELECT unnest(range(16)) AS p)
), e0 AS (
  SELECT p, entry, x0 AS y0, x1 AS y1, x2 AS y2, x3 AS y3
  FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)
), {", ".join(_op12_round(n) for n in range(3))},
books AS (SELECT sha256(string_agg(concat_ws(',', y0, y1, y2, y3), ',' ORDER BY p, entry)) AS h FROM e2),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books
"""


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings whose cosine is 0.95 or more."""
    return embedding_dedup.near_groups(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_pack": op2_pack,
        "op3_shard": op3_shard,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_simhash": op6_simhash,
        "op7_bpe": op7_bpe,
        "op8_jaccard": op8_jaccard,
        "op9_url_filter": op9_url_filter,
        "op10_toxicity": op10_toxicity,
        "op11_centroids": op11_centroids,
        "op12_codes": op12_codes,
        "op13_embedding_dedup": op13_embedding_dedup,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_shard": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op8_jaccard": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_centroids": OP11_SQL, "op12_codes": OP12_SQL}
