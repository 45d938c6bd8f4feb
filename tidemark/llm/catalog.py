"""The queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark import workspace as ws
from tidemark.llm import bpe, decontaminate, exact, language, lempel, merkle, minhash, negatives, neighbours, quality, suffix, tokens, warc


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_warc(spark: SparkSession, root: str) -> DataFrame:
    """Every page written as WARC records and read back."""
    read = warc.archive(table(spark, root, "pages"), ws.fresh_folder(spark, "warc"))
    return read.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Every document encoded and decoded."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(table(spark, root, "documents"), path, ids=False, digests=True)


def op3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The nearest vectors of every twentieth one."""
    return neighbours.nearest(table(spark, root, "embeddings"))


def op4_quality(spark: SparkSession, root: str) -> DataFrame:
    """The quality score of every document."""
    return quality.classify(table(spark, root, "documents"), table(spark, root, "labels"))


def op5_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokens.count_tokens(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.summary(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the bytes of repeated strings."""
    return suffix.summary(table(spark, root, "documents"))


def op8_language(spark: SparkSession, root: str) -> DataFrame:
    """The language of every document."""
    return language.identify(table(spark, root, "documents"))


def op9_minhash(spark: SparkSession, root: str) -> DataFrame:
    """The component of every document among near-duplicates."""
    return minhash.cluster(table(spark, root, "documents"))


def op10_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the words of windows that an earlier one holds."""
    return lempel.cut(table(spark, root, "documents"), with_text=False)


def op11_negatives(spark: SparkSession, root: str) -> DataFrame:
    """Hard negatives for the positives of every fiftieth vector."""
    return negatives.mine(table(spark, root, "embeddings"))


def op12_merkle(spark: SparkSession, root: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the fold of a tampered copy."""
    return merkle.manifest(table(spark, root, "documents"))


def op13_exact(spark: SparkSession, root: str) -> DataFrame:
    """The document that stays for every document, of those with one text."""
    return exact.copies(table(spark, root, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_neighbours": op3_neighbours,
    "op4_quality": op4_quality,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language": op8_language,
    "op9_minhash": op9_minhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_negatives": op11_negatives,
    "op12_merkle": op12_merkle,
    "op13_exact": op13_exact,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"



def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    shown = [f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in fields]
    return f"sha256({' || '.join(shown)})"


#: crc32 of doc_id in decimal, bit by bit: a byte is added, -1 shifts.
_CRC32 = (
    "xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
    "lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
)
_SIDES = (
    "coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS a, coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS b"
)

SQL = {
    "op1_warc": """
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     g AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM d),
     m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM g)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > f THEN f END AS refers_to
FROM m
""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_ALNUM}), []) AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce(regexp_extract_all({_LOWER}, {_ALNUM}), []) AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, CAST(least(len(w), 10) AS INTEGER) AS n,
                   array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
            FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
     dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
            FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
     hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
     pos AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
     its AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
     w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(0, n - 399)) AS t(i) WHERE n >= 400),
     hit AS (SELECT doc_id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) AS r USING (k)),
     step AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS s FROM hit),
     run AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b
             FROM (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM step) GROUP BY doc_id, g),
     gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM run
             UNION ALL SELECT doc_id, max(b), NULL FROM run GROUP BY doc_id),
     kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS k
              FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
     cut AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_SPACED}), []) AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS k
           FROM d, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
               FROM s AS x JOIN s AS y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
     link AS (SELECT a, b FROM both_ JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b
              WHERE 100 * c >= 80 * (p.n + q.n - c)),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach AS r JOIN link AS l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS c USING (doc_id)
""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
             FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
     least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
     gone AS (SELECT DISTINCT win.doc_id, i + j AS p
              FROM win JOIN least_ USING (k), unnest(range(0, 13)) AS t(j) WHERE m < win.doc_id),
     word AS (SELECT doc_id, i AS p, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept
              FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
     cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
""",
    "op11_negatives": """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
     pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                     CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s
              FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
     pos AS (SELECT anchor_id, id, s, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) AS r
             FROM pair WHERE same QUALIFY r <= 5),
     neg AS (SELECT p.anchor_id, p.id AS positive_id, p.s AS positive_score, n.id AS negative_id, n.s AS negative_score,
                    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.s DESC, n.id) AS INTEGER) AS rank
             FROM pos AS p JOIN pair AS n
               ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
""",
    "op12_merkle": f"""
WITH RECURSIVE d AS (
         SELECT row_number() OVER () AS r, coalesce('=' || source, '') AS tree, doc_id, {_leaf("text")} AS leaf,
                CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS bent
         FROM documents),
     l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, bent) - 1 AS i,
                  count(*) OVER (PARTITION BY tree) AS n FROM d),
     node AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM l
              UNION ALL
              SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
              FROM node WHERE n > 1 GROUP BY tree, level, i // 3, n),
     side AS (SELECT tree, level, i, n, {_SIDES} FROM node WINDOW w AS (PARTITION BY tree, level, i // 3 ORDER BY i)),
     fold AS (SELECT r, tree, 0 AS level, i, n, bent AS h, '' AS proof FROM l
              UNION ALL
              SELECT r, f.tree, f.level + 1, f.i // 3, (f.n + 2) // 3, sha256(a || h || b), proof || a || b
              FROM fold AS f JOIN side AS s ON f.tree = s.tree AND f.level = s.level AND f.i = s.i WHERE f.n > 1),
     sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
     node2 AS (SELECT 0 AS level, i, n, h FROM sub
               UNION ALL
               SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
               FROM node2 WHERE n > 1 GROUP BY level, i // 3, n),
     side2 AS (SELECT level, i, n, {_SIDES} FROM node2 WINDOW w AS (PARTITION BY level, i // 3 ORDER BY i)),
     fold2 AS (SELECT r, f.tree, 0 AS level, sub.i, sub.n, f.h, proof FROM fold AS f JOIN sub ON f.tree = sub.tree WHERE f.n = 1
               UNION ALL
               SELECT r, f.tree, f.level + 1, f.i // 3, (f.n + 2) // 3, sha256(a || h || b), proof || a || b
               FROM fold2 AS f JOIN side2 AS s ON f.level = s.level AND f.i = s.i WHERE f.n > 1)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM l JOIN fold2 AS f ON l.r = f.r AND f.n = 1 JOIN sub ON sub.tree = l.tree JOIN (SELECT h FROM node2 WHERE n = 1) AS top ON true
""",
    "op13_exact": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
}
