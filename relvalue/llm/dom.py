"""A light block tree of an HTML page, and features of its nodes."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: Fixed values of HTML.
BLOCKS = ("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th "
          "blockquote pre figure figcaption details summary address center hgroup dialog menu").split()  # fmt: skip
BREAKS = {"br", "hr"}
#: No text of a page's own: left out with all they hold. What RAW ones hold is no markup and goes up to their end tag; where others have no end tag, they end at the next block border.
RAW = "script style title textarea".split()
SILENT = set("noscript template select button svg iframe object canvas head".split())
#: Silent elements that may hold one of their own name, and those that the end tag of a block around them can't end.
NESTING, CLOSED_OFF = {"template", "svg", "object", "canvas"}, {"template", "object"}
#: Blocks whose end tag may be left out, so it ends nothing else.
LOOSE = {"p", "li", "dt", "dd", "thead", "tbody", "tfoot", "tr", "td", "th"}
#: What the start of a block ends, if it is open.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "body": set(), "html": set()}
FENCES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "menu"}
#: What words in class, id and role tell, by kind.
KINDS = {
    "content": "article content post entry story body main text blog page prose richtext markdown articlebody hentry",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toc topbar pagination pager",
    "header": "header masthead banner top branding logo",
    "footer": "footer foot bottom copyright legal colophon contentinfo",
    "side": "sidebar side aside rail widget complementary secondary",
    "advert": "ad ads advert advertisement sponsor sponsored promo banner promoted adsense dfp",
    "notice": "cookie cookies consent notice alert popup modal gdpr disclaimer overlay toast announcement",
    "form": "form login signup subscribe newsletter search contact register",
    "comment": "comment comments discussion reply replies disqus respond reader feedback",
    "share": "share social related recommended follow tags meta more trending popular similar",
}
KIND_OF: dict[str, int] = {}
for _i, _words in enumerate(KINDS.values()):
    for _word in _words.split():
        KIND_OF[_word] = KIND_OF.get(_word, 0) | 1 << _i

TAG_ID = {t: i for i, t in enumerate(["#text", *BLOCKS])}
_ATTRIBUTES = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_ATTRIBUTES}(?:(?<=/)>|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"""
    rf"""|</(?P<close>[a-z][a-z0-9:-]*)[^>]*>|<(?P<open>[a-z][a-z0-9:-]*)(?P<attributes>(?=[\s/>]){_ATTRIBUTES})>|<[!?/][^>]*>|(?P<text>[^<]+|<)""",
    re.I | re.S,
)
NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def kinds(attributes: str) -> int:
    """The kinds that words in class, id, role and itemprop hint at, as bits."""
    found = 0
    for values in NAMED.findall(attributes):
        for word in WORD.findall(" ".join(values)):
            found |= KIND_OF.get(word.lower(), 0)
    return found


def silent_ends(tokens: list[re.Match]) -> dict[int, int]:
    """For the start tag of each silent element its end tag, by places in ``tokens``; elements that lack theirs aren't listed.

    An end tag is lacking where a block around the element ends first, where one that can't hold its
    like starts again, and, for head, where a block starts.
    """
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []  # open silent elements, and blocks
    opened: dict[str, int] = {}

    def cut(depth: int) -> None:
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    for at, m in enumerate(tokens):
        if m["open"]:
            name = m["open"].lower()
            if name in TAG_ID and stack and stack[-1][0] == "head":
                cut(len(stack) - 1)
            if (name in SILENT or name in TAG_ID and name not in LOOSE) and not m["attributes"].endswith("/"):
                if name in SILENT and name not in NESTING and opened.get(name):
                    depth = max(i for i, x in enumerate(stack) if x[0] == name)
                    if not any(x in CLOSED_OFF for x, _ in stack[depth:]):
                        cut(depth)
                stack.append((name, at))
                opened[name] = opened.get(name, 0) + 1
        elif m["close"] and opened.get(name := m["close"].lower()):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name in SILENT:
                        found[stack[depth][1]] = at
                    cut(depth)
                    break
                if stack[depth][0] in CLOSED_OFF and name not in CLOSED_OFF and name != "body":
                    break
    return found


class Page:
    """Nodes in page order: block elements, and the runs of text between block borders."""

    def __init__(self, html: str):
        self.tag, self.parent, self.kind, self.text, self.linked, self.marks = [0], [-1], [0], [""], [0], [""]
        self.tag[0] = TAG_ID["html"]
        stack: list[tuple[str, int]] = [("html", 0)]
        run: list[str] = []
        state = [0, 0]  # open links, linked characters in the run

        def border() -> None:
            if run:
                text = " ".join(unescape("".join(run)).split())
                if text:
                    self._node(0, stack[-1][1], 0, text, state[1])
                run.clear()
                state[1] = 0

        tokens = list(TOKEN.finditer(html))
        ends = silent_ends(tokens) if any(m["open"] and m["open"].lower() in SILENT for m in tokens) else {}
        skip, silent = -1, ""  # the end tag of a silent element, and the one that lacks it
        for at, m in enumerate(tokens):
            if at <= skip:
                continue
            what = m.lastgroup
            if silent:
                name = (m["open"] or m["close"] or "").lower()
                if name in TAG_ID or name in BREAKS or silent == "head" and what == "text" and m["text"].strip():
                    silent = ""
                elif name not in SILENT or not m["open"]:
                    if name == "a":
                        state[0] = 1 if m["open"] else 0
                    continue
            if what == "text":
                run.append(m["text"])
                if state[0]:
                    state[1] += len(m["text"])
            elif what == "attributes" or m["open"]:
                name = m["open"].lower()
                if name in SILENT:
                    if not m["attributes"].endswith("/"):
                        skip = ends.get(at, -1)
                        if at not in ends:
                            silent = name
                        elif silent == name and name not in NESTING:
                            silent = ""
                elif name == "a":
                    state[0] = 1
                elif name in BREAKS:
                    border()
                elif name in TAG_ID:
                    border()
                    if name in ("html", "body") and any(t == name for t, _ in stack):
                        continue
                    over = ENDS.get(name, {"p"})
                    depth = len(stack) - 1
                    while depth > 0 and stack[depth][0] not in FENCES:
                        if stack[depth][0] in over:
                            del stack[depth:]
                        depth -= 1
                        depth = min(depth, len(stack) - 1)
                    node = self._node(TAG_ID[name], stack[-1][1], kinds(m["attributes"]) if m["attributes"] else 0, "", 0, m["attributes"] or "")
                    if not (m["attributes"] or "").endswith("/"):
                        stack.append((name, node))
            elif m["close"]:
                name = m["close"].lower()
                if name == "a":
                    state[0] = 0
                elif name in TAG_ID:
                    border()
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] == name:
                            del stack[depth:]
                            break
        border()

    def _node(self, tag: int, parent: int, kind: int, text: str, linked: int, marks: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.kind.append(kind)
        self.text.append(text)
        self.linked.append(linked)
        self.marks.append(marks)
        return len(self.tag) - 1


GROUPS = ["#text", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table thead tbody tfoot tr td th", "blockquote pre figure"]
GROUP_OF = np.full(len(TAG_ID), len(GROUPS))
for _i, _tags in enumerate(GROUPS):
    for _tag in _tags.split():
        GROUP_OF[TAG_ID[_tag]] = _i


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each node of all pages, and where each page's rows start."""
    rows: list[tuple] = []
    starts = [0]
    for page in pages:
        n = len(page.tag)
        words = [t.count(" ") + 1 if t else 0 for t in page.text]
        chars = [len(t) for t in page.text]
        stops = [t.count(".") + t.count("!") + t.count("?") + t.count("。") for t in page.text]
        commas = [t.count(",") + t.count("，") for t in page.text]
        linked, blocks, tags = list(page.linked), [1 if t else 0 for t in page.text], [1] * n
        children = [0] * n
        own = [0] * n
        depth, above = [0] * n, [0] * n
        mask = [page.kind[i] | 1 << 16 + int(GROUP_OF[page.tag[i]]) for i in range(n)]
        order, before, so_far = [0] * n, [0] * n, 0
        for i in range(1, n):
            p = page.parent[i]
            depth[i], above[i], order[i] = depth[p] + 1, above[p] | mask[p], children[p]
            children[p] += 1
            before[i] = so_far
            so_far += words[i]
            if page.tag[i] == 0:
                own[p] += words[i]
        for i in range(n - 1, 0, -1):
            p = page.parent[i]
            words[p] += words[i]
            chars[p] += chars[i]
            stops[p] += stops[i]
            commas[p] += commas[i]
            linked[p] += linked[i]
            blocks[p] += blocks[i]
            tags[p] += tags[i]
        last = [-1] * n
        left, right = [0] * n, [0] * n
        for i in range(1, n):
            p = page.parent[i]
            if last[p] >= 0:
                left[i], right[last[p]] = words[last[p]], words[i]
            last[p] = i
        for i in range(n):
            p = max(page.parent[i], 0)
            rows.append((words[i], chars[i], stops[i], commas[i], linked[i], blocks[i], tags[i], children[i], own[i], depth[i], order[i], children[p], words[p], left[i], right[i], before[i], max(so_far, 1), above[i], mask[i], n))
        starts.append(len(rows))
    a = np.array(rows, dtype=np.int64).reshape(-1, 20)
    words, chars, stops, commas, linked, blocks, tags, children, own, depth, order, siblings, parent_words, left, right, before, total, above, mask, n = a.T.astype(np.float32)
    some = np.maximum(words, 1)
    columns = [
        np.log1p(words), chars / some, stops / some, commas / some, linked / np.maximum(chars, 1), np.log1p(blocks), words / np.maximum(blocks, 1), words / tags, np.log1p(children), own / some,
        depth, order, siblings, order / np.maximum(siblings, 1), words / np.maximum(parent_words, 1), np.log1p(left), np.log1p(right), before / total, words / total, (total - before - words) / total, np.log1p(total),
    ]
    masks, aboves = a[:, 18], a[:, 17]
    bits = [*range(len(KINDS)), *range(16, 17 + len(GROUPS))]
    columns += [(masks >> b & 1).astype(np.float32) for b in bits] + [(aboves >> b & 1).astype(np.float32) for b in bits]
    return np.stack(columns, axis=1).astype(np.float32), np.array(starts)


def kept_text(page: Page, score: np.ndarray) -> str:
    """The text of the best consistent choice: a node that goes takes all below it along.

    A node's gain is its log odds, weighted by the words it holds itself; a node stays if its own gain
    and the best of what is below it come to more than nothing.
    """
    n = len(page.tag)
    gain = [0.0] * n
    for i in range(n):
        text = page.text[i]
        gain[i] = float(score[i]) * (1 + len(text) ** 0.5 if text else 1.0)
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    stays, out = [gain[0] > 0] + [False] * (n - 1), []
    for i in range(1, n):
        if gain[i] > 0 and stays[page.parent[i]]:
            stays[i] = True
            if page.text[i]:
                out.append(page.text[i])
    return " ".join(out)
