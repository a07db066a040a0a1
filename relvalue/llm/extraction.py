"""Main text of web pages: boosted trees over block nodes, decoded along the tree.

The model is trained here. Labels come from pages of the corpus that mark their article
themselves (an ``article`` or ``main`` element); so that it doesn't lean on those elements alone, the
articles and the furniture of the sampled pages are also set into other layouts: other elements
and attribute words, side columns, notices, forms, reader comments, before, after and inside.
"""

from __future__ import annotations

import heapq
import random
import re
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvalue.llm.arrow import column, portions
from relvalue.llm.boosting import Boosted
from relvalue.llm.dom import KINDS, TAG_ID, Page, features, kept_text

#: The model is trained on at most so many pages that mark their article, those with the smallest hash of their id, and so many layouts of each.
SAMPLE_PAGES = 240
LAYOUTS = 3
#: And so many copies of each whose article is in an element without a meaning.
RENAMED = 3
#: Of few pages more copies are made, up to the second number of each, so that there are about as many as the first.
COPIES = (720, 24)
#: Where no page of a table marks its article, texts of so many words stand in for paragraphs, and so many layouts are made of each page.
LONG_TEXT, UNMARKED_LAYOUTS = 12, 6
CONTENT_TAGS = {TAG_ID["article"], TAG_ID["main"]}
FURNITURE_TAGS = {TAG_ID[t] for t in ("nav", "aside", "footer", "form")}
CONTENT_KIND = 1 << list(KINDS).index("content")
LABEL = re.compile(r"data-y=(\d)")
MARK_TAG = re.compile(r"<(/?)(?:article|main)(?=[\s/>])(?:(?<!/)\s[^<>]*(?=>))?", re.I)
MARK = re.compile(r"<(?:article|main)[\s/>]", re.I)


def marked(page: Page) -> np.ndarray:
    """1 for nodes in or above the article a page marks itself, 0 for others; all 0 where it marks none."""
    n = len(page.tag)
    inside, out = [0] * n, np.zeros(n, np.int64)
    for i in range(1, n):
        kind = page.kind[i]
        inside[i] = 1 if page.tag[i] in CONTENT_TAGS else inside[page.parent[i]]
        if page.tag[i] in FURNITURE_TAGS or kind & ~CONTENT_KIND and not kind & CONTENT_KIND:
            inside[i] = 0
        out[i] = inside[i]
    return _above(page, out)


def labelled(page: Page) -> np.ndarray:
    """The labels that a made layout carries in its attributes."""
    out = np.zeros(len(page.tag), np.int64)
    for i in range(1, len(page.tag)):
        m = LABEL.search(page.marks[i])
        out[i] = int(m[1]) if m else out[page.parent[i]]
    return _above(page, out)


def _above(page: Page, out: np.ndarray) -> np.ndarray:
    """A node is kept if any text below it is."""
    keep = np.where(np.array([bool(t) for t in page.text]), out, 0)
    for i in range(len(out) - 1, 0, -1):
        keep[page.parent[i]] |= keep[i]
    return keep


def layout(paragraphs: list[str], furniture: list[str], rnd: random.Random) -> str:
    """A page with these paragraphs as its article, in a layout of chance; attributes carry the labels."""
    words = " ".join(furniture).split() or ["more"]
    some = lambda low, high: " ".join(rnd.choice(words) for _ in range(rnd.randint(low, high)))

    def attribute(kind: str) -> str:
        shown = rnd.choice(KINDS[kind].split())
        shape = rnd.choice(["class=\"{0}\"", "class=\"{0} box\"", "id=\"{0}\"", "class=\"{0}-inner wrap\"", "id=\"{0}-1\"", "class=\"c{1}\"", ""])
        return shape.format(shown, rnd.randint(1, 99))

    def block(kind: str, *tags: str) -> str:
        tag = rnd.choice(tags)
        links = "".join(f'<li><a href="/{i}">{escape(some(1, 3))}</a></li>' for i in range(rnd.randint(2, 8)))
        prose = "".join(f"<p>{escape(some(5, 40))}.</p>" for _ in range(rnd.randint(1, 3)))
        body = {
            "menu": f"<ul>{links}</ul>", "header": f"<a href=\"/\">{escape(some(1, 3))}</a>" + (f"<ul>{links}</ul>" if rnd.random() < 0.5 else f"<p>{escape(some(2, 8))}</p>"),
            "footer": rnd.choice(["&copy; ", ""]) + escape(some(4, 15)) + rnd.choice(["", f"<ul>{links}</ul>"]), "side": rnd.choice([f"<h3>{escape(some(1, 3))}</h3><ul>{links}</ul>", prose]),
            "advert": rnd.choice([escape(some(4, 25)), f"<p>{escape(some(4, 25))}</p>"]), "notice": f"<p>{escape(some(6, 30))}</p>" + rnd.choice(["", f"<a href=\"#\">{escape(some(1, 2))}</a>"]),
            "form": f"<label>{escape(some(1, 4))}</label><input name=\"q\">" + rnd.choice(["", f"<p>{escape(some(3, 12))}</p>"]),
            "comment": f"<h3>{escape(some(1, 2))}</h3>" + "".join(f"<{t} {attribute('comment')}><b>{escape(some(1, 2))}</b><p>{escape(some(5, 60))}.</p></{t}>" for t in rnd.choices(["div", "li", "article", "section"], k=rnd.randint(1, 5))),
            "share": f"<ul>{links}</ul>" if rnd.random() < 0.7 else escape(some(2, 8)),
        }[kind]
        return f"<{tag} data-y=0 {attribute(kind)}>{body}</{tag}>"

    made = {
        "menu": lambda: block("menu", "nav", "nav", "div", "ul"), "header": lambda: block("header", "header", "header", "div"), "footer": lambda: block("footer", "footer", "footer", "div"),
        "side": lambda: block("side", "aside", "aside", "div", "section"), "advert": lambda: block("advert", "div", "div", "aside", "section"), "notice": lambda: block("notice", "div", "div", "section", "p", "aside"),
        "form": lambda: block("form", "form", "form", "div"), "comment": lambda: block("comment", "section", "div", "div", "ol"), "share": lambda: block("share", "div", "div", "aside", "section"),
    }
    pick = lambda kinds, p: "".join(made[k]() for k in kinds if rnd.random() < p)

    tag = rnd.choice(["article", "article", "main", "div", "div", "section", "td"])
    parts = []
    for i, text in enumerate(paragraphs):
        shape = rnd.choice(["p"] * 8 + ["div", "li", "blockquote", "h2"]) if i else rnd.choice(["h1", "h1", "p"])
        inline = text if rnd.random() < 0.8 else f"<b>{text}</b><br>"
        parts.append({"li": f"<ul><li>{inline}</li></ul>"}.get(shape, f"<{shape}>{inline}</{shape}>"))
        if rnd.random() < 0.06:
            parts.append(made[rnd.choice(["advert", "share", "notice", "form", "side"])]())
    if rnd.random() < 0.25:
        parts.append(made[rnd.choice(["comment", "share", "form", "footer"])]())
    if rnd.random() < 0.15:
        parts.insert(0, f"<header data-y=1>{parts.pop(0)}</header>")
    article = f"<{tag} data-y=1 {attribute('content') if rnd.random() < 0.7 else ''}>{''.join(parts)}</{tag}>"
    if tag == "td":
        article = f"<table><tr>{'<td data-y=0>' + made['menu']() + '</td>' if rnd.random() < 0.5 else ''}{article}</tr></table>"
    for _ in range(rnd.randint(0, 3)):
        inside = rnd.random()
        more = made[rnd.choice(["side", "comment", "advert", "share"])]() if inside < 0.4 else ""
        article = f"<{rnd.choice(['div', 'div', 'section', 'main'])} {attribute('content') if rnd.random() < 0.4 else ''}>{article}{more}</div>"
    body = pick(["notice", "header", "menu", "advert", "form"], 0.5) + article + pick(["share", "side", "advert", "comment", "form", "notice", "footer"], 0.5)
    return f"<html><body data-y=0>{body}</body></html>"


def renamed(html: str, rnd: random.Random) -> str:
    """The same page with its marking elements as plain ones, and attributes of chance or none in place of theirs."""
    tag = rnd.choice(["div", "div", "div", "section", "td"][:4])
    attribute = rnd.choice(["", "", f' class="x{rnd.randint(1, 99)}"', ' class="content"', f' id="c{rnd.randint(1, 99)}"', ' class="post"'])
    return MARK_TAG.sub(lambda m: f"</{tag}" if m[1] else f"<{tag}{attribute}", html)


def train(htmls: list[str], seed: int = 1) -> Boosted | None:
    """A model from pages that mark their article, copies without the mark and other layouts of them.

    Without such pages, from made layouts of the pages' texts alone; None if these have no text either.
    """
    rnd = random.Random(seed)
    pages, labels = [], []
    found = [(html, page, y) for html in htmls if (y := marked(page := Page(html))).any()]
    copies = max(RENAMED, min(COPIES[1], COPIES[0] // max(1, len(found))))
    for html, page, y in found:
        pages.append(page)
        labels.append(y)
        article = [escape(t, quote=False) for t, keep in zip(page.text, y) if t and keep]
        furniture = [t for t, keep in zip(page.text, y) if t and not keep]
        for _ in range(copies):
            same = Page(renamed(html, rnd))
            if [bool(t) for t in same.text] == [bool(t) for t in page.text]:
                pages.append(same)
                labels.append(y)
        for _ in range(LAYOUTS):
            if article:
                many = article[: rnd.choice([1, 2, 3, 6, 12, len(article), len(article)])]
                made = Page(layout(many, furniture + many[-1:], rnd))
                pages.append(made)
                labels.append(labelled(made))
    if not found:
        for html in htmls:
            texts = [t for t in Page(html).text if t]
            long = [escape(t, quote=False) for t in texts if len(t.split()) >= LONG_TEXT]
            for _ in range(UNMARKED_LAYOUTS if long else 0):
                some = long[: rnd.choice([1, 2, 3, 6, 12, len(long), len(long)])]
                made = Page(layout(some, [t for t in texts if len(t.split()) < LONG_TEXT] + some[-1:], rnd))
                pages.append(made)
                labels.append(labelled(made))
    if not pages:
        return None
    x, starts = features(pages)
    y = np.concatenate(labels)
    weight = np.concatenate([np.full(b - a, 30 / (b - a) ** 0.5) for a, b in zip(starts, starts[1:])])
    return Boosted(x, y, weight / weight.mean())


def first_marked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows (_hash, page_id, html) those that mark their article and may be among the ``most`` with the smallest hash; no others are parsed."""
    best: list[int] = []  # the smallest hashes so far, negative, as a heap
    for batch in portions(batches, "html", 2 << 20):
        keep = []
        for key, html in zip(column(batch, "_hash").to_pylist(), column(batch, "html").to_pylist()):
            keep.append((len(best) < most or key < -best[0]) and bool(MARK.search(html)) and bool(marked(Page(html)).any()))
            if keep[-1]:
                (heapq.heappush if len(best) < most else heapq.heapreplace)(best, -key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def sample(pages: DataFrame, most: int = SAMPLE_PAGES, mark: bool = True) -> DataFrame:
    """page_id and html of the ``most`` pages of smallest hash among all that mark their article, or among all pages without ``mark``."""
    rows = pages.select(F.xxhash64("page_id").alias("_hash"), "page_id", "html").where("html is not null")
    found = rows.mapInArrow(lambda batches: first_marked(batches, most), rows.schema) if most > 0 and mark else rows
    return found.orderBy("_hash", "page_id").limit(most).select("page_id", "html")


def extract(pages: DataFrame, model: Boosted | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text for each row of ``pages`` (page_id, url, html; other columns are ignored).

    Without a ``model`` one is trained on a sample of those ``pages`` that mark their article (at most ``sample_pages``). White
    space inside a block becomes one space, blocks are joined by one space in page order. A null or
    empty html, or a page without an article, gives the empty text; null ids and repeated rows each keep
    their row. If no page of the table marks its article, the model learns from made layouts of as many pages' texts; only if there
    is no longer text in these is all text outside scripts and the like kept.
    """
    if model is None:
        taken = [r["html"] for r in sample(pages, sample_pages).toLocalIterator()]
        model = train(taken or [r["html"] for r in sample(pages, sample_pages, mark=False).toLocalIterator()])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "html", 2 << 20):
            found = [Page(x or "") for x in column(batch, "html").to_pylist()]
            if shared.value is None:
                texts = [" ".join(t for t in p.text if t) for p in found]
            else:
                x, starts = features(found)
                score = shared.value.score(x)
                texts = [kept_text(p, score[a:b]) for p, a, b in zip(found, starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
