"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import hashlib
import re
import zlib
from html import unescape

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from relvalue.llm.encoding import library_ids
from relvalue.llm.queries import ORACLE, QUERIES
from test_llm_rules import brute_measures

FOLDER = "/root/testdata/sf0.001"


def read(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in read("documents")}


def ids_of(documents, path):
    return dict(zip(documents, library_ids(path)(list(documents.values()))))


def rows_of(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", ORACLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, result.fetchall()))


def test_op2(spark, documents, byte_file):
    want = [(d, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(documents[d].encode()).hexdigest()) for d, i in ids_of(documents, byte_file).items()]
    assert sorted(map(tuple, rows_of(spark, "op2_bpe_round_trip"))) == sorted(want)


def test_op4(spark, documents, byte_file):
    start, want = 0, []
    for d, i in sorted(ids_of(documents, byte_file).items()):
        i += b"\0\0\0\0"
        want.append((d, start, len(i) // 4, zlib.crc32(i)))
        start += len(i) // 4
    assert sorted(map(tuple, rows_of(spark, "op4_id_files"))) == want


def test_op5(spark, documents, word_file):
    ids = {d: i + b"\1\0\0\0" for d, i in ids_of(documents, word_file).items()}
    rows, filled, sequences = rows_of(spark, "op5_packing"), dict.fromkeys(ids, 0), {}
    for r in rows:
        piece = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(piece) == r["ids_crc32"] and len(piece) == 4 * r["length"]
        filled[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(4 * n == len(ids[d]) for d, n in filled.items())
    for pieces in sequences.values():
        assert sorted(o for o, _ in pieces) == np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 2048
    assert len(sequences) * 2048 <= 1.03 * sum(filled.values()) + 2048


def test_op6(spark, documents):
    quality = {r["doc_id"]: r["quality"] for r in read("labels")}
    for r in rows_of(spark, "op6_quality_outliers"):
        assert tuple(r)[1:6] == brute_measures(documents[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        if not r["base_failed"] and r["doc_id"] in quality:
            assert r["kept"] == bool(quality[r["doc_id"]])


def test_op7(spark):
    def article(html):
        inner = re.sub(r"</?b>", "", html[html.index("<article>") + 9 : html.index("</article>")])
        blocks = (" ".join(unescape(b).split()) for b in re.sub(r"<[^>]+>", "\0", inner).split("\0"))
        return " ".join(b for b in blocks if b)

    html = {r["page_id"]: r["html"] for r in read("pages")}
    rows = rows_of(spark, "op7_main_text")
    assert len(rows) == len(html) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert np.mean([r["text"] == article(html[r["page_id"]]) for r in rows]) >= 0.95


def test_op9(spark, documents, byte_file):
    want = [(d, len(documents[d].encode()), len(i) // 4, len(i) > 4 * 512) for d, i in ids_of(documents, byte_file).items()]
    assert sorted(map(tuple, rows_of(spark, "op9_token_counts"))) == sorted(want)


def test_op10(spark):
    table = read("embeddings")
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], np.float64)
    norms, got = np.linalg.norm(x, axis=1), {}
    for r in rows_of(spark, "op10_nearest_neighbours"):
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(got) == asked and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    found = 0
    for q in asked:
        at = np.flatnonzero(ids == q)[0]
        scores = x @ x[at] / (norms * norms[at])
        scores[at] = -9
        found += len(set(got[q].values()) & set(ids[np.lexsort((ids, -scores))[:5]].tolist()))
    assert found >= 0.95 * 5 * len(asked)


def test_op11(spark, documents, byte_file):
    import public_tokenizers
    from test_llm_round3 import brute_alignment

    want = brute_alignment(list(documents.items()), byte_file, public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(map(tuple, rows_of(spark, "op11_cross_tokenizer_alignment"))) == sorted(want)
