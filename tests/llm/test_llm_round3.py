"""Alignment, Merkle manifests and decontamination, held against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relvalue.llm import alignment, decontamination, merkle
from relvalue.llm.encoding import byte_characters


@pytest.fixture(scope="module")
def piece_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture()
def eight_ranges(spark):
    """Small tables in as many ranges and partitions as large ones."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


# --- alignment ---------------------------------------------------------------------------------


def brute_alignment(rows, byte_file, piece_file):
    """Both encodings of each text as a whole, cuts by set intersection, links by comparing ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(byte_file)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    byte_of = byte_characters()

    def tokens(text):
        whole = (" " + text).encode()
        a = [(i, bytes(byte_of[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in b_lib.encode(text):
            piece = b_lib.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()))
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    made, counts = [], {}
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        ends = [np.cumsum([0] + [len(x) for _, x in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        groups, at = [], [0, 0]
        place = [{x: i for i, x in enumerate(e)} for e in ends]
        for cut in cuts:
            upto = [p[cut] for p in place]
            groups.append("|".join(",".join(str(i) for i, _ in side[f:t]) for side, f, t in zip((a, b), at, upto)))
            at = upto
        links = []
        first = 0
        for i, (x, _) in enumerate(a):
            while first < len(b) and ends[1][first + 1] <= ends[0][i]:
                first += 1
            j = first
            while j < len(b) and ends[1][j] < ends[0][i + 1]:
                links.append((x, b[j][0]))
                j += 1
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        made.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(d, na, nb, ng, len(ln), sum(counts[x] == most[x[1]] for x in ln), sum(counts[x] for x in ln), g) for d, na, nb, ng, ln, g in made]


def odd_texts(seed, n):
    rnd = random.Random(seed)
    parts = ["the", "The", " ", "  ", "\n", "\t", "\r\n", "é", "é", "ﬁ", "日本語", "한국", "🙂", "👩‍👧", " ", "　", "​", "1234", "..", "don't", "<s>", "</s>", "<unk>",
             "<|endoftext|>", "<0x0A>", "\x00", "\x1c", "ſ", "İ", "x" * 30, "_", "a-b", "﻿", "ß", "中", "word", "tokenization", " ", "\x85"]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " ", ""]) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def test_alignment(docs, byte_file, piece_file):
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "mark ▁ inside", "▁", "▁▁ x", "日" * 50, " " * 300, "\n" * 70, "the cat " * 2000, "é" * 3000, "\x00\x01", "<s> </s> <|endoftext|>"]
    rows = list(enumerate(texts + odd_texts(1, 400))) + [(None, "no id"), (7, "repeated"), (7, "repeated")]
    want = brute_alignment(rows, byte_file, piece_file)
    for parts in (1 << 20, 50):  # the table of counts whole, and in many parts
        got = alignment.align(docs(rows), byte_file, piece_file, part_pairs=parts)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_alignment_of_one_very_long_word(docs, byte_file, piece_file):
    rows = [(1, "abcdefg" * 30_000), (2, "x " * 100_000)]
    got = alignment.align(docs(rows), byte_file, piece_file).collect()
    assert sorted(map(tuple, got)) == sorted(brute_alignment(rows, byte_file, piece_file))


def test_alignment_of_nothing(docs, byte_file, piece_file):
    assert alignment.align(docs([]), byte_file, piece_file).collect() == []
    assert [tuple(r) for r in alignment.align(docs([(1, None)]), byte_file, piece_file).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("seed", range(40))
def test_cut_groups(seed):
    """Groups end where both sides end, also where cuts are rare."""
    rnd = np.random.default_rng(seed)
    low, high, starts, size = [], [], 0, 0
    ends_a, ends_b = [], []
    for _ in range(rnd.integers(1, 6)):
        n = int(rnd.integers(1, 400))
        a = set(rnd.choice(n, int(rnd.integers(0, n)), replace=False).tolist()) - {0} | {n}
        b = set(rnd.choice(n, int(rnd.integers(0, n)), replace=False).tolist()) - {0} | {n}
        if seed % 3 == 0:
            b -= a - {n}  # no cut inside
        low.append(starts)
        starts += len(a)
        high.append(starts - 1)
        ends_a += sorted(x + size for x in a)
        ends_b += sorted(x + size for x in b)
        size += n
    got = alignment.cut_groups(np.array(ends_a), np.array(ends_b), np.array(low), np.array(high))
    assert got.tolist() == [i for i, x in enumerate(ends_a) if x in set(ends_b)]


# --- Merkle manifests --------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, altered):
    """One list a level, one loop a leaf."""

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[1], r[2], r[3], text))))

    def build(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
        return levels

    def way(levels, place):
        out = []
        for level in levels[:-1]:
            at = place // 3 * 3
            out.append((level[at:place], level[place + 1 : at + 3]))
            place //= 3
        return out

    order = sorted(((r, leaf(r, r[4])) for r in rows), key=lambda x: ((x[0][1] is not None, (x[0][1] or "").encode()), (x[0][0] is not None, x[0][0] or 0), x[1]))
    names = []
    for r, _ in order:
        if not names or names[-1] != r[1]:
            names.append(r[1])
    trees = {s: build([h for r, h in order if r[1] == s]) for s in names}
    top = build([trees[s][-1][0] for s in names])
    out, seen = [], {s: 0 for s in names}
    for r, h in order:
        steps = way(trees[r[1]], seen[r[1]]) + way(top, names.index(r[1]))
        seen[r[1]] += 1
        now = leaf(r, r[4].replace("\n", "") if r[4] is not None else None) if altered(r) else h
        for before, after in steps:
            now = sha("".join([*before, now, *after]))
        out.append((r[0], h, trees[r[1]][-1][0], top[-1][0], sha("".join(x for b, a in steps for x in [*b, *a])), now, now == top[-1][0]))
    return out


def is_altered(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 3, "z") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string, hash string, idx int, key string")
    return merkle.verified_manifest(docs.repartition(4), F.replace("text", F.lit("\n"), F.lit("")), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


def make_rows(n, sources, seed=0):
    rnd = random.Random(seed)
    return [(i, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([1, None]), rnd.choice([None, "", "a\nb", "é\n", "long " * 50])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [(5, "s", "en", 3, "a\nb")],
    [(5, None, None, None, None)],
    [(1, "s", "en", 3, "a"), (1, "s", "en", 3, "a"), (1, "s", "en", 3, "b\n"), (None, "s", "en", 1, "x"), (None, None, "en", 1, "x")],
    [(i, f"s{i}", "en", 1, "\n") for i in range(11)],  # a lone leaf each
    make_rows(28, ["one"]),
    make_rows(90, ["hot"] * 6 + ["a", "b", "", None, "é", "z", "\U0001f600", "￮"], 1),
], ids=range(6))
def test_manifest(spark, rows):
    got = manifest(spark, rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_manifest(rows, is_altered)))


def test_manifest_over_many_ranges(spark, eight_ranges):
    rows = make_rows(260, [None, *"abcdefghijklmnopqrstuvwxyz"] + ["hot"] * 12, 2)
    assert sorted(map(repr, map(tuple, manifest(spark, rows).collect()))) == sorted(map(repr, brute_manifest(rows, is_altered)))


def test_manifest_of_nothing(spark):
    got = manifest(spark, [])
    assert got.collect() == [] and got.columns[0] == "doc_id"


def test_manifest_of_a_very_long_text(spark):
    rows = [(i, "s", "en", 1, "line\n" * 400_000) for i in range(4)]
    assert sorted(map(tuple, manifest(spark, rows).collect())) == sorted(brute_manifest(rows, is_altered))


# --- decontamination ---------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_contamination(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def items_of(spark, items, kind="long"):
    return spark.createDataFrame([(*x, 1, "w") for x in items], f"item_id {kind}, text string, size int, window string")


def contaminated_rows(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "x1"]
    say = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 3, 4, 5, 9, 10, 11, 14, 40]))) for i in range(25)]
    items += [(900, items[3][1]), (900, say(12)), (901, None), (902, " ,.! "), (None, say(15)), (10, items[5][1]), (9, "it's A-b c.d e_f g'h I j k l m n o p")]
    template = say(12)  # that many items begin with
    items += [(i, f"{template} {say(5)}") for i in range(1000, 1040)]
    rows = [(0, None), (1, ""), (2, " .,! "), (3, items[0][1]), (None, template), (4, "IT S a B C d E f g h i J k L m"), (5, template), (5, template)]
    for i in range(10, 90):
        text = say(rnd.randint(1, 60))
        for _ in range(rnd.choice([0, 1, 3])):
            text += " " + (rnd.choice(items)[1] or "").upper() + " " + say(rnd.randint(0, 5))
        rows.append((i, text))
    return rows, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contamination(spark, docs, seed):
    rows, items = contaminated_rows(seed)
    got = decontamination.contamination(docs(rows), items_of(spark, items))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_contamination(rows, items)))


def test_contamination_across_blocks(spark, docs, monkeypatch):
    """Texts and items in blocks of a few words: windows that lie across are found once."""
    rows, items = contaminated_rows(4)
    monkeypatch.setattr(decontamination, "PIECE", 40)
    for text in [t for _, t in rows if t]:
        flat = [w.encode() for w in split(text)]
        own = []
        for words, first, start, upto in decontamination.blocks(text.encode(), 9):
            assert words == flat[first : first + len(words)] and first <= max(0, start - 9) + 9
            assert first + len(words) >= min(len(flat), upto + 9)
            own += range(start, upto)
        assert own == list(range(len(flat)))


def test_contamination_of_a_very_long_text(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    text = "some other words " * 150_000 + item + " and more" * 100_000 + " " + item
    rows = [(1, text), (2, "x" * 3_000_000), (3, item)]
    got = decontamination.contamination(docs(rows), items_of(spark, [("a", item), ("b", "nothing like it at all")], "string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_contamination(rows, [("a", item), ("b", "nothing like it at all")]))


def test_contamination_without_rows(spark, docs):
    none = hashlib.sha256(b"").hexdigest()
    assert decontamination.contamination(docs([]), items_of(spark, [(1, "a b")])).collect() == []
    assert [tuple(r) for r in decontamination.contamination(docs([(1, "a b"), (1, "a b")]), items_of(spark, [])).collect()] == [(1, 2, 0, 0, none, False)] * 2


def test_bits_of_the_map():
    """A hash's first bits name its bit, as Spark sets them."""
    found = np.array([0, 1 << 44, (1 << 64) - 1, 12345678901234567890], np.uint64)
    bit_map = np.zeros(1 << 17, np.uint8)
    for x in found.tolist():
        bit_map[x >> 44 >> 3] |= 1 << (x >> 44 & 7)
    assert decontamination._marked(found, bit_map, 20).tolist() == [0, 1, 2, 3]
    assert decontamination._marked(found ^ np.uint64(1 << 50), bit_map, 20).tolist() == []
