"""Quality rules, archives, main text and the pipeline."""

import base64
import hashlib
import random
import re
from html import escape

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relvalue.llm import extraction, quality, warc
from relvalue.llm.boosting import Boosted
from relvalue.llm.dom import Page, features, kept_text
from relvalue.llm.scratch import Scratch

SPACE = " \t\n\r\x0b\x0c"


def brute_measures(text):
    words = (text or "").encode().split()
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\n", "one", "a b", "é ü\xa0x $5 <b>", "a b c a b c", "la la la la la", "x\nx\n\ny\nx\r\n \n", "\x1c\x0b|#\x0c"])
def test_measures(text):
    assert quality.measures((text or "").encode()) == brute_measures(text)


def make_docs(seed=1, n=400):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rnd.randint(60, 300)))
        if i % 20 == 7:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, rnd.choice(["en", "de"]), rnd.choice(["a", "a", "b", None])))
    return rows + [(9000, None, None, None), (9001, "", "en", "a"), (9002, "short", "en", "a"), (9003, "la " * 100, "de", "a"), (None, rows[0][1], "en", "a"), (1, rows[1][1], *rows[1][2:])]


def test_outliers_go_and_clean_documents_stay(spark):
    rows = make_docs()
    table = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, text string, lang string, source string, n_words double, _key string").repartition(5)
    got = quality.judge(table).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        assert tuple(r[c] for c in quality.STATISTICS) == brute_measures(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and "%%%" not in text)
    assert quality.judge(table.limit(0)).collect() == []
    few = quality.judge(table.where("doc_id < 5")).collect()
    assert all(r["distance"] is None and r["kept"] for r in few)


@pytest.mark.parametrize("share", [0.35, 0.4])
def test_a_source_filled_with_one_kind_of_junk(spark, share):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rnd.randint(60, 300))]
        junk = i < 300 * share
        rows.append((i, " ".join(w + "%%%" if junk else w for w in words), "en", "a", junk))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(table).collect()}
    assert [i for i, *_, junk in rows if got[i] == junk] == []


def brute_determinant(x, core, starts, rnd):
    """The least determinant that concentration steps from random subsets reach, with its centre and covariance."""
    best = None
    h = int(np.ceil(core * len(x)))
    for _ in range(starts):
        some = x[rnd.choice(len(x), 10, replace=False)]
        det = np.inf
        while True:
            m, cov = some.mean(axis=0), quality.floored(np.cov(some.T, bias=True) * quality.consistency(core))
            now = np.linalg.det(cov)
            if len(some) == h and now >= det * (1 - 1e-9):
                break
            det = now if len(some) == h else np.inf
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov), x - m)
            some = x[np.argsort(d, kind="stable")[:h]]
        if best is None or now < best[0]:
            best = (now, m, cov)
    return best


def test_estimates_reach_the_least_determinant(spark):
    """Ten groups, each with outliers of its own kind, against many random starts in numpy."""
    frames, groups = [], {}
    for seed in range(10):
        rnd = np.random.default_rng(seed)
        n, share = int(rnd.integers(200, 500)), rnd.choice([0.0, 0.1, 0.3, 0.4])
        x = rnd.multivariate_normal([5, 1.5, 0.3, 0.5, 1], np.diag([1.2, 0.4, 0.9, 1.1, 1.8]) @ (np.eye(5) + 0.2) @ np.diag([1.2, 0.4, 0.9, 1.1, 1.8]), n)
        x[: int(share * n)] += rnd.normal(size=5) * 25
        groups[f"g{seed}"] = x
        frames += [(f"g{seed}", *map(float, r)) for r in x]
    table = spark.createDataFrame(frames, "_key string, " + ", ".join(f"x{i} double" for i in range(5)))
    rows = {r["_key"]: r for r in quality.estimates(table, Scratch(spark, "t")).collect()}
    assert set(rows) == set(groups)
    for key, x in groups.items():
        det, m, cov = brute_determinant(x, quality.CORE, 30, np.random.default_rng(7))
        centre = np.array([rows[key][c] for c in quality.CENTRE])
        mine = np.array([rows[key][c] for c in quality.COVARIANCE]).reshape(5, 5)
        assert rows[key]["determinant"] <= 1.3 * det, (key, rows[key]["determinant"], det)  # the core is exact to a cell
        far = lambda m, c: np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) > quality.CUTOFF
        assert (far(centre, mine) == far(m, cov)).mean() > 0.99


def spam_table(spark, groups, seed=3):
    """Documents of groups (lang, source, sound, spam, letters, word lengths)."""
    rnd = random.Random(seed)
    rows = []
    for lang, source, sound, spam, letters, low, high in groups:
        for i in range(sound + spam):
            words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(rnd.randint(60, 400))]
            rows.append((len(rows), " ".join(w + "%%%" if i >= sound else w for w in words), lang, source, i >= sound))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, spam boolean").repartition(3)


def shares_kept(table):
    got = quality.judge(table).join(table.select("doc_id", "lang", "spam"), "doc_id").groupBy("lang", "spam").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    return {(r["lang"], r["spam"]): r["kept"] for r in got.collect()}


@pytest.mark.parametrize("sound, spam", [(30, 15), (33, 17), (50, 25), (10, 4)])
def test_no_size_switches_verdicts(spark, sound, spam):
    got = shares_kept(spam_table(spark, [("en", "a", sound, spam, "abcdefgh", 2, 8)]))
    assert got["en", True] == 0 and got["en", False] >= 0.95


def test_a_rare_language_is_kept(spark):
    """Beside many English documents, 40, 10 and 1 of languages with much longer words, and a small source."""
    got = shares_kept(spam_table(spark, [
        ("en", "a", 290, 0, "abcdefgh", 2, 8), ("en", "b", 10, 3, "abcdefgh", 2, 8), ("fi", "a", 40, 0, "aeiouklmn", 9, 22),
        ("hu", "a", 10, 0, "aeiouklmn", 9, 22), ("et", "x", 1, 0, "aeiouklmn", 14, 30),
    ]))
    assert all(share >= 0.95 for (_, spam), share in got.items() if not spam) and got["en", True] == 0


def test_quality_of_a_very_long_text(spark):
    rows = [(i, "some sound words here " * 30 + str(i), "en", "a") for i in range(3)] + [(9, "la " * 3_000_000, None, None)]
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["kept"]) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[9] == (3_000_000, 3_000_000, False)


def test_chi_square():
    assert quality.chi2_cdf(quality.CUTOFF, 5) == pytest.approx(1 - 1.5e-7, abs=5e-8)
    assert quality.chi2_quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-3)


PAGES = [(4, "http://a/é x", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", ""), (5, "u", None), (7, "u", "é" * 3_000_000), (6, "u", "two"), (6, "u", "two"), (None, "u", "<p>one</p>"), (8, "u\nv", "x" * (1 << 20))]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "z", 3) for r in PAGES], "page_id long, url string, html string, record_type string, chunk int").repartition(3)
    got = warc.round_trip(pages, least).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        refers = first.get(h or "", i)
        want.append((i or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers == i else "revisit", -1 if refers == i else refers))
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or -1) for r in got) == sorted(want)


def test_large_records_come_in_chunks(spark):
    scratch = Scratch(spark, "t")
    pages = spark.createDataFrame([(1, "u", "abc" * 1000), (2, "u", "z")], "page_id long, url string, html string")
    files = scratch.keep(warc.write_archives(warc.records(pages), f"{scratch.path}/a", 700), "files")
    rows = sorted(warc.read_archives(files, chunk_bytes=512).where("page_id = 1").collect(), key=lambda r: r["chunk"])
    assert [r["chunk"] for r in rows] == list(range(6)) and [r["is_last"] for r in rows] == [False] * 5 + [True]
    so_far = b""
    for r in rows:
        so_far += bytes(r["payload"])
        assert r["payload_bytes"] == len(so_far) and r["payload_digest"] == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
    assert so_far == b"abc" * 1000
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_tree_of_a_page():
    page = Page("<!-- <p>no</p> --><script>var a='<p>no</p>';</script><div class=\"a>b\"><p>one <b>t</b>wo<p>th&eacute;re&nbsp;is<br/>more</div><ul><li>x<li>y</ul>a < b <unknown>c</unknown>")
    assert [t for t in page.text if t] == ["one two", "thére is", "more", "x", "y", "a < b c"]
    assert [t for t in Page("").text if t] == [] and [t for t in Page("<<<p").text if t] == ["<<<p"]
    deep = Page("<div>" * 5000 + "x")
    assert kept_text(deep, np.ones(len(deep.tag))) == "x"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>t</title><body><article><p>text</p></article>", ["text"]),
        ("<head><meta name=a><title>t</title><script>x</script>bare text", ["bare text"]),
        ("<head><title>t</title></head><p>a<head-line>b</head-line><button-group>c</button-group>", ["abc"]),
        *((f"<article><p>a</p><{x}><p>b</p></article><{x}>no</{x}><p>c</p>", ["a", "b", "c"]) for x in "svg button select object canvas iframe noscript template".split()),
        *((f"<p>a</p><{x}><i>no</i><div><p>no</p></div></{x}>b", ["a", "b"]) for x in "svg button object canvas iframe noscript template".split()),
        ("<div>a<svg>no</div>b</svg>c", ["a", "bc"]),
        ("<div>a<svg><svg>no</svg>no</svg>b</div>", ["ab"]),
        ("<button>no<button>no</button>a<a>b<svg></a>no<br>c", ["ab", "c"]),
        ("<template><article><p>no</p></article></div></template>a<title>no<p>no", ["a"]),
    ],
)
def test_silent_elements_end_where_they_have_to(html, want):
    assert [t for t in Page(html).text if t] == want


def test_a_dropped_node_takes_all_below():
    page = Page("<body><div><p>aa</p></div><section><p>bb</p></section></body>")
    score = np.array([1.0, 1, -20, 3, 3, 1, 1, 1])
    assert kept_text(page, score) == "bb"


def article(rnd):
    return [" ".join(rnd.choice(["alpha", "beta", "gamma, delta", "of", "the"]) for _ in range(rnd.randint(8, 60))) + "." for _ in range(rnd.randint(2, 9))]


def raw_page(rnd, parts):
    menu = "".join(f"<li><a href='/{i}'>menu{i}</a></li>" for i in range(6))
    return f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><div class='ad'>Buy this now.</div><article><h1>{escape(parts[0])}</h1>{''.join(f'<p>{escape(p)}</p>' for p in parts[1:])}</article><footer>&copy; me &middot; All of it.</footer></body></html>"


def test_main_text_on_held_out_pages(spark):
    rnd = random.Random(8)
    made = [(i, f"u{i}", parts := article(rnd), raw_page(rnd, parts)) for i in range(160)]
    odd = [(900, "u", None), (901, "u", ""), (None, "u", "<p>")]
    table = spark.createDataFrame([(i, u, h, "x") for i, u, _, h in made] + [(*r, "x") for r in odd], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(table, sample_pages=80).collect()}
    assert np.mean([got[i] == " ".join(parts) for i, _, parts, _ in made]) > 0.97
    assert got[900] == got[901] == got[None] == ""
    assert extraction.extract(table.limit(0)).collect() == []
    plain = table.where("page_id >= 900").limit(0).unionByName(spark.createDataFrame([(1, "u", "<p>a</p><p>b c</p>", "")], table.schema))
    assert extraction.extract(plain).collect()[0]["text"] == "a b c"


def test_rare_marked_pages_are_all_sampled(spark):
    rnd = random.Random(3)
    rows = [(i, raw_page(rnd, article(rnd)) if i % 40 == 3 else "<script>'<article>'</script><p>plain</p>" if i % 2 else "<article></article><p>plain</p>") for i in range(400)]
    table = spark.createDataFrame([*rows, (None, None)], "page_id long, html string").repartition(3)
    assert sorted(r["page_id"] for r in extraction.sample(table, 240).collect()) == [i for i in range(400) if i % 40 == 3]
    few = [r["page_id"] for r in extraction.sample(table, 4).collect()]
    every = [r["page_id"] for r in extraction.sample(table, 10).collect()]
    assert few == every[:4] and len(every) == 10


@pytest.fixture(scope="module")
def pages():
    """Pages of the tables, and the article each marks."""
    htmls = [r for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist() if r]
    wanted = []
    for html in htmls:
        page = Page(html)
        wanted.append(" ".join(t for t, keep in zip(page.text, extraction.marked(page)) if t and keep))
    return htmls, wanted


def unmarked(html, attribute):
    return re.sub(r"<(/?)(?:article|main)\b[^>]*>", lambda m: "</div>" if m[1] else f"<div{attribute}>", html)


def exact(model, htmls, wanted):
    made = [Page(h) for h in htmls]
    x, starts = features(made)
    score = model.score(x)
    got = [kept_text(p, score[a:b]) for p, a, b in zip(made, starts, starts[1:])]
    return np.mean([g == w for g, w in zip(got, wanted)]), got


@pytest.mark.parametrize("marked, least", [(240, 0.9), (20, 0.9), (5, 0.3)])
def test_main_text_of_pages_without_a_mark(pages, marked, least):
    """The same pages with a plain element in place of the mark; long articles lose no paragraph."""
    htmls, wanted = pages
    model = extraction.train(htmls[:marked])
    for attribute in ("", ' class="x1"', ' class="content"'):
        share, got = exact(model, [unmarked(h, attribute) for h in htmls], wanted)
        assert share >= least
        if marked > 5:
            assert all(g == w for g, w in zip(got, wanted) if len(w.split()) > 2000)


def test_main_text_where_no_page_has_a_mark(pages):
    """The trees still tell the most of the article from menus, footers and adverts."""
    htmls, wanted = [unmarked(h, "") for h in pages[0]], pages[1]
    _, got = exact(extraction.train(htmls[:60]), htmls, wanted)
    words = lambda texts: sum(len(t.split()) for t in texts)
    assert words(got) > 0.6 * words(wanted)
    outside = [set(" ".join(t for t in Page(h).text if t).split()) - set(w.split()) for h, w in zip(htmls, wanted)]
    assert sum(len(set(g.split()) & o) for g, o in zip(got, outside)) < 0.2 * sum(map(len, outside))


def test_renamed_pages_keep_their_texts(pages):
    rnd = random.Random(2)
    for html in pages[0]:
        assert [t for t in Page(extraction.renamed(html, rnd)).text if t] == [t for t in Page(html).text if t]
        assert not extraction.MARK.search(extraction.renamed(html, rnd))


def test_main_text_of_a_very_long_page(spark):
    rnd = random.Random(1)
    parts = [" ".join(["alpha", "beta", "of", "the"] * 12) + "." for _ in range(4000)]
    table = spark.createDataFrame([(i, "u", raw_page(rnd, article(rnd))) for i in range(60)] + [(99, "u", raw_page(rnd, parts))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(table).collect()}
    assert got[99] == " ".join(parts)


def test_main_text_on_other_layouts():
    rnd = random.Random(9)
    model = extraction.train([raw_page(rnd, article(rnd)) for _ in range(80)])
    right = extra = missed = 0
    for _ in range(150):
        page = Page(extraction.layout([escape(p) for p in article(rnd)], ["menu other words here"], rnd))
        want = [t for t, y in zip(page.text, extraction.labelled(page)) if t and y]
        got = kept_text(page, model.score(features([page])[0])).split()
        words = " ".join(want).split()
        both = sum(min(got.count(w), words.count(w)) for w in set(words))
        right, extra, missed = right + both, extra + len(got) - both, missed + len(words) - both
    assert right / (right + extra) > 0.93 and right / (right + missed) > 0.93


def test_boosting_learns_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(int)
    model = Boosted(x[:3000], y[:3000], np.ones(3000))
    assert (((model.score(x[3000:]) > 0) == y[3000:]).mean()) > 0.95
    assert (Boosted(x[:50], np.ones(50, int), np.ones(50)).score(x[:5]) > 0).all()


def test_pipeline_against_brute_force(spark, tmp_path):
    from test_llm_near import brute_components, brute_repeats

    rows = make_docs(5, 200)[:-2]
    rnd = random.Random(1)
    for i in range(30):  # near copies and shared passages
        d, t, lang, source = rows[rnd.randrange(150)]
        w = t.split()
        rows.append((300 + i, " ".join(w[:10] + ["zz"] + w[11:]), lang, source))
    for i in range(20):
        rows.append((400 + i, " ".join([*rows[i][1].split()[5:45], *rows[150 + i][1].split()[::-1]]), *rows[i][2:]))
    table = spark.createDataFrame([(*r, len(r[1] or ""), "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, repeats string, _row int").repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")

    kept = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = Scratch(spark, "t").keep(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        kept[name] = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    sound = [(d, t) for d, t, *_ in rows if t and len(t.split()) >= 50 and "%%%" not in t and not t.startswith("la la")]
    assert kept["quality_rules"] == sorted(sound)
    firsts = {d for d, _, c in brute_components(sound) if d == c}
    assert kept["ngram_jaccard_join"] == sorted(r for r in sound if r[0] in firsts)
    assert kept["substring_dedup"] == sorted((d, t) for d, _, _, t in brute_repeats(kept["ngram_jaccard_join"]))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == firsts
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_pipeline_keeps_one_of_each_group(spark):
    """Repeated rows, near copies that share an id, one text under many ids, null ids and texts without words."""
    rnd = random.Random(8)
    say = lambda: " ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 99)) for _ in range(80))
    t, u, v = say(), say(), say()
    rows = [(9, t), (9, t), (9, t + " more"), (1, u), (1, u), (2, u), (3, u), (3, u + " extra"), (None, u), (None, v), (None, v + " end"), (5, None), (5, None), (6, " ")]
    docs = spark.createDataFrame([(*r, "en", "a", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string").repartition(4)
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert got.dtypes == docs.dtypes
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted((d or -1) for d, _ in kept) == [-1, 1, 5, 5, 6, 9]
    assert {(1, u), (5, None), (6, " ")} <= set(kept) and dict(kept)[9] in (t, t + " more") and dict(kept)[None] in (v, v + " end")


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").collect() == []


def test_rows_of_one_key_are_told_apart(spark, monkeypatch):
    """A key that two different rows share fails the run where it could mix their words."""
    from relvalue.llm import substrings

    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage + " x"), (2, "y " + passage), (3, "z z " + passage)], "doc_id long, text string")
    assert substrings.remove_repeats(docs).where("repeats.n_removed > 0").count() == 2
    real = substrings.F.xxhash64
    monkeypatch.setattr(substrings.F, "xxhash64", lambda *c: F.lit(7).cast("long") if c == ("doc_id", "text") else real(*c))
    with pytest.raises(Exception, match="share the key"):
        substrings.remove_repeats(docs).collect()
