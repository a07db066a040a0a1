"""The registered queries of this subpackage, and SQL that checks those it can express."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relvalue.llm import alignment, bpe, counts, decontamination, extraction, idfiles, jaccard, merkle, neighbours, packing, quality, substrings, warc
from relvalue.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_FILE, WORD_FILE, PIECE_FILE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # executors find this package where the driver did
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The group of near copies of every document: 5-word shingles, similarity 0.8."""
    return jaccard.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, for every document."""
    path = vocabulary(BYTE_FILE)
    encoded = bpe.encode(table(spark, folder, "documents"), path)
    return bpe.decode(encoded, path, bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place and checksum of every document's ids, as read back from the id files."""
    scratch = Scratch(spark, "ids")
    files, order = idfiles.write_files(table(spark, folder, "documents"), vocabulary(BYTE_FILE), 0, scratch)
    return idfiles.read_files(files, order, lambda ids: (zlib.crc32(ids.tobytes()),), {"ids_crc32": pa.int64()})


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), vocabulary(WORD_FILE), end_id=1)


def op6_quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document, the base rules and the verdict."""
    return quality.judge(table(spark, folder, "documents")).select("doc_id", *quality.STATISTICS, "base_failed", "kept")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return extraction.extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses to passages of 20 words or more that occur earlier, and a digest of the rest."""
    kept = substrings.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t-\\r]+", " "))
    return kept.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether they are over 512 tokens."""
    return counts.count_tokens(table(spark, folder, "documents"), vocabulary(BYTE_FILE), limit=512)


def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    return neighbours.nearest(table(spark, folder, "embeddings"), every=50, k=5)


def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers, and how common the links are."""
    return alignment.align(table(spark, folder, "documents"), vocabulary(BYTE_FILE), vocabulary(PIECE_FILE))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf and proof; where the id's checksum is even, its fold starts from the text without line ends."""
    docs = table(spark, folder, "documents")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.verified_manifest(docs, F.replace("text", F.lit("\n"), F.lit("")), altered)


def op13_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The words of every document that lie in a window of a benchmark item, and the items."""
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_id_files": op4_id_files,
    "op5_packing": op5_packing,
    "op6_quality_outliers": op6_quality_outliers,
    "op7_main_text": op7_main_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

#: Base32 in SQL: the digest's 160 bits, five at a time, as letters.
_OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
     b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1 + 16), 4)), '') AS bits FROM d),
     r AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INTEGER) * (16 >> j)))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM r
"""

_OP8 = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM w WHERE len(words) >= 20),
     k AS (SELECT doc_id, start, md5(array_to_string(words[start : start + 19], ' ')) AS key FROM s),
     r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY key ORDER BY doc_id, start) AS nth FROM k),
     gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM r WHERE nth > 1),
     p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
     kept AS (SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.place) AS text FROM p ANTI JOIN gone USING (doc_id, place) GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP1 = """
WITH RECURSIVE
     w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                                          ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

#: Level by level: nodes of all trees, then each leaf's way up. The checksum is the bitwise one of zlib.
_OP12 = """
WITH RECURSIVE
     f AS (SELECT doc_id, source, text, 'x' || coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') AS head,
                  concat_ws('', coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
                            coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS middle,
                  replace(text, chr(10), '') AS cut,
                  list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::UBIGINT)),
                    lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda j: 0::UBIGINT)),
                      lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS crc FROM documents),
     d AS (SELECT doc_id, source, sha256(substr(head, 2) || middle || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                  CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN sha256(substr(head, 2) || middle || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) END AS altered FROM f),
     l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                  count(*) OVER (PARTITION BY source) AS n FROM d),
     nodes AS (SELECT tree, 0 AS level, idx, n, leaf AS hash FROM l
               UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
     subs AS (SELECT tree, hash, max(level) OVER () AS deepest FROM nodes WHERE n = 1),
     tops AS (SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subs) AS n, hash FROM subs
              UNION ALL SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n),
     kin AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lefts, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rights
             FROM (SELECT tree, level, idx, n, hash FROM nodes UNION ALL SELECT -1, level, idx, n, hash FROM tops) a
             JOIN (SELECT tree, level, idx, hash FROM nodes UNION ALL SELECT -1, level, idx, hash FROM tops) b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
             WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx),
     way AS (SELECT doc_id, leaf, tree AS home, tree, 0 AS level, idx, n, coalesce(altered, leaf) AS now, '' AS proof, row_number() OVER () AS row FROM l
             UNION ALL
             SELECT doc_id, leaf, home, CASE WHEN up THEN -1 ELSE w.tree END, CASE WHEN up THEN 0 ELSE w.level + 1 END, CASE WHEN up THEN home ELSE w.idx // 3 END,
                    CASE WHEN up THEN (SELECT count(*) FROM subs) ELSE (w.n + 2) // 3 END, CASE WHEN up THEN now ELSE sha256(lefts || now || rights) END, CASE WHEN up THEN proof ELSE proof || lefts || rights END, row
             FROM (SELECT *, n = 1 AS up FROM way WHERE n > 1 OR tree >= 0) w LEFT JOIN kin k ON NOT up AND k.tree = w.tree AND k.level = w.level AND k.idx = w.idx)
SELECT doc_id, leaf, subs.hash AS subroot, t.hash AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.hash AS verified
FROM way JOIN subs ON subs.tree = way.home JOIN (SELECT hash FROM tops WHERE n = 1) t ON true WHERE way.tree = -1 AND way.n = 1
"""

_OP13 = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
     i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
     s AS (SELECT item, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS start, words FROM i WHERE len(words) > 0),
     w AS (SELECT DISTINCT item, size, array_to_string(words[start : start + size - 1], ' ') AS wind FROM s),
     z AS (SELECT DISTINCT size FROM w),
     p AS (SELECT row, size, unnest(range(1, len(words) - size + 2)) AS start, words FROM d JOIN z ON len(words) >= size),
     h AS (SELECT row, start, p.size, item FROM p JOIN w ON w.size = p.size AND w.wind = array_to_string(words[start : start + p.size - 1], ' ')),
     n AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(start, start + size)) AS place FROM (SELECT DISTINCT row, start, size FROM h)) GROUP BY row),
     t AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": _OP1, "op8_substring_dedup": _OP8, "op3_warc_round_trip": _OP3, "op12_merkle_manifest": _OP12, "op13_benchmark_decontamination": _OP13}
