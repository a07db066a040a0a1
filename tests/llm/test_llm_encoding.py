"""Encoding operators, held against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from relvalue.llm import bpe, counts, encoding, idfiles, packing
from relvalue.llm.encoding import fast_ids, library_ids, second_library, stretches, words
from relvalue.llm.scratch import Scratch

PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "'s", "'re", "'ll", "\xa0", " ", "\x1c", "\x85", "é", "中", "🎉", "<|endoftext|>", "<|endo", "<|startoftext|>", "!", "...",
         "1", "²", "Ⅷ", "́", "​", "　", "﻿", "᠎", "Zz", "aaaa", "====", "_", "ß", "İ", "Σ", "ﬁ"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    return ["", " ", "\n\n", "<|endoftext|>"] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]


def test_whole_texts_through_stretches_and_the_second_library(texts, byte_file, word_file):
    raw = [t.encode() for t in texts]
    want = library_ids(byte_file)(texts)
    assert stretches(byte_file).ids(raw) == want
    assert fast_ids(byte_file)(raw) == want
    assert words(word_file).ids(raw) == library_ids(word_file)(texts)


def test_unsure_characters_are_left_to_the_library(byte_file):
    _, unsure = second_library(byte_file)
    assert unsure.search("中") and not unsure.search("plain é text")


@pytest.mark.parametrize("space", [" ", "\n", " \n", "\t"])
@pytest.mark.parametrize("n", [99_998, 100_000, 2_000_000])
def test_long_white_space(space, n, byte_file):
    text = "Before" + space * (n // len(space)) + "after it"
    assert fast_ids(byte_file)([text.encode(), b"next"]) == library_ids(byte_file)([text, "next"])


def test_what_the_second_library_raises_on_is_left_to_the_first(byte_file, monkeypatch):
    class Raising:
        def encode_to_numpy(self, *args, **more):
            raise ValueError("Max stack size exceeded for backtracking")

    monkeypatch.setattr(encoding, "second_library", lambda path: (Raising(), second_library(path)[1]))
    assert fast_ids(byte_file)([b"some text"]) == library_ids(byte_file)(["some text"])


def test_backtracking_is_exact_on_every_entry_and_on_chance_texts(texts, byte_file):
    coder, memory = bpe.codec(byte_file)
    assert all(coder.word(t) == [i] == coder._walk(t, t.decode("latin-1")) for t, i in coder.vocab.items())
    assert memory.ids([t.encode() for t in texts]) == library_ids(byte_file)(texts)
    rnd = random.Random(3)
    for _ in range(2000):
        word = bytes(rnd.choice(b"aabbeerstthing ") for _ in range(rnd.randint(1, 30)))
        assert coder.word(word) == coder._walk(word, word.decode("latin-1"))


def test_decoding_by_offsets(texts, byte_file):
    library = Tokenizer.from_file(byte_file)
    rnd = np.random.default_rng(1)
    for ids in [rnd.integers(0, 50257, n).astype("<u4") for n in (0, 1, 5, 2000)]:
        assert bpe.decode_ids(ids, *bpe.codec_table(byte_file)) == library.decode(ids.tolist(), skip_special_tokens=False)


ROWS = [(3, "Some words, and more words."), (1, None), (2, ""), (2, ""), (None, "no id"), (9, "x" * 50_000), (7, " ".join(f"w{i}'s" for i in range(9000))), (4, "<|endoftext|> é\xa0中")]


def test_round_trip_rows(docs, byte_file):
    got = bpe.decode(bpe.encode(docs(ROWS), byte_file), byte_file).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((d or 0, t or "") for d, t in ROWS)
    got = bpe.decode(bpe.encode(docs(ROWS), byte_file), byte_file, bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    ids = library_ids(byte_file)([t or "" for _, t in ROWS])
    want = [(d or 0, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), i in zip(ROWS, ids)]
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want)


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (200, 64), (110, 36)])
def test_counts_by_overlap(docs, byte_file, chunk, overlap):
    rows = [*ROWS, (11, "ab  \n" * 400 + "'re" * 300), (12, " " * 3000 + "end"), (13, "1,2;3." * 500), (13, "1,2;3." * 500), (14, "x<|endoftext|>y" * 200)]
    got = counts.count_tokens(docs(rows), byte_file, 512, chunk, overlap).collect()
    ids = library_ids(byte_file)([t or "" for _, t in rows])
    want = [(d or 0, len((t or "").encode()), len(i) // 4, len(i) // 4 > 512) for (d, t), i in zip(rows, ids)]
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want)


def test_counts_of_an_empty_table(docs, byte_file):
    assert counts.count_tokens(docs([]), byte_file, 512).collect() == []
    with pytest.raises(ValueError):
        counts.count_tokens(docs([]), byte_file, 512, chunk=100, overlap=60)


@pytest.mark.parametrize("top", [0, 255, 256, 65_536, 1 << 24, 2**32 - 1])
def test_variable_length_coding(top):
    rnd = np.random.default_rng(top % 97)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rnd.integers(0, top + 1, n).astype("<u4")
        control, data = idfiles.pack(values)
        assert len(control) == -(-n // 4)
        assert (idfiles.unpack(control, data, n) == values).all()


def test_id_files(spark, docs, byte_file):
    files, order = idfiles.write_files(docs(ROWS), byte_file, 0, Scratch(spark, "t"))
    from pyarrow import int64

    got = idfiles.read_files(files, order, lambda x: (zlib.crc32(x.tobytes()),), {"crc": int64()}).collect()
    ids = [i + b"\0\0\0\0" for i in library_ids(byte_file)([t or "" for _, t in ROWS])]
    assert sorted((r[0] or 0, r["n_tokens"], r["crc"]) for r in got) == sorted((d or 0, len(i) // 4, zlib.crc32(i)) for (d, _), i in zip(ROWS, ids))
    placed = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in placed] == [None, 1, 2, 2, 3, 4, 7, 9]
    assert [r["start"] for r in placed] == np.cumsum([0] + [r["n_tokens"] for r in placed])[:-1].tolist()
    counts_ = idfiles.frequencies(idfiles.encode_documents(docs(ROWS), byte_file, 0), 50257)
    assert (np.diff(counts_[order]) <= 0).all()


def test_id_files_of_an_empty_table(spark, docs, byte_file):
    files, order = idfiles.write_files(docs([]), byte_file, 0, Scratch(spark, "t"))
    assert idfiles.read_files(files, order, lambda x: (), {}).collect() == []


def test_fill_comes_closest_of_all_subsets():
    rnd = random.Random(2)
    for _ in range(300):
        items = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        capacity = rnd.randint(max(items), 45)
        left = {x: items.count(x) for x in items}
        used = packing.fill(left, capacity)
        assert all(k <= left[x] for x, k in used.items()) and max(items) in used
        rest = sorted(items)[:-1]
        best = max(max(items) + sum(s for i, s in enumerate(rest) if m >> i & 1) for m in range(1 << len(rest)) if max(items) + sum(s for i, s in enumerate(rest) if m >> i & 1) <= capacity)
        assert sum(x * k for x, k in used.items()) == best


def test_packing_covers_every_id_once(docs, word_file):
    rnd = random.Random(4)
    rows = [*ROWS, *[(100 + i, " ".join(rnd.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(rnd.randint(0, 900)))) for i in range(120)]]
    got = packing.pack(docs(rows), word_file, end_id=1, capacity=512).collect()
    ids = {}
    for (d, _), i in zip(rows, library_ids(word_file)([t or "" for _, t in rows])):
        ids.setdefault(d, np.frombuffer(i + b"\1\0\0\0", "<u4"))
    covered, sequences = {}, {}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered.pop(2) == 2 * len(ids[2])  # the repeated row
    assert covered == {d: len(i) for d, i in ids.items() if d != 2}
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 512
    full = sum(len(i) for i in ids.values())
    assert len(sequences) <= full / 512 + 3
    assert packing.pack(docs([]), word_file, 1).collect() == []
