"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its text blocks. Each block's features are its ancestors' tags and class words and the
shape of its text; the field scores blocks and neighbouring labels (main text or not) and Viterbi decodes the page.
Training pages are made here: articles and page furniture in many layouts, each block with its label.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true|\shidden(?:\s|=|$)", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    """One leaf block: its text with white space in runs of one, its own tag, its ancestors' names and the text's share in links."""

    text: str
    tag: str
    names: frozenset[str]
    linked: float


@dataclass
class _Open:
    tag: str
    names: list[str] = field(default_factory=list)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order. Unclosed, crossed and cut-off tags are read as browsers do, nearly."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            tag = next((o.tag for o in reversed(stack) if o.tag in BLOCK), "body")
            out.append(Block(text, tag, frozenset(n for o in stack for n in o.names), min(1.0, linked / max(1, len(text)))))
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if any(o.tag == "a" for o in stack):
            linked += len(text)

    page = page or ""
    at = 0
    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if not m[4]:
            break  # the page ends inside a tag
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            same = {"p"} if tag not in ("li", "td", "th", "tr", "dt", "dd", "option") else {"p", tag}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in VOID:
            continue
        names = [f"a:{tag}"]
        if m[3]:
            for groups in NAMES.findall(m[3]):
                names += [f"c:{w}" for w in WORDS.findall("".join(groups).lower())]
            if HIDDEN.search(m[3]):
                names.append("hidden")
        stack.append(_Open(tag, names))
    if m is None:
        take(re.sub(r"</?\Z", "", page[at:]))
    flush()
    return out


def features(seq: list[Block]) -> list[list[str]]:
    """Names of each block's features: own tag, ancestors, and the shape of its text."""
    out = []
    for i, b in enumerate(seq):
        n, t = len(b.text), b.text
        f = ["bias", f"t:{b.tag}", *b.names]
        f.append(f"len:{min(8, n.bit_length())}")
        f.append(f"link:{int(b.linked * 3.99)}")
        f.append("stop" if t[-1] in ".!?…。\"'”»)" else "open")
        f.append(f"stops:{min(3, sum(t.count(x) for x in '.!?'))}")
        if "©" in t or "·" in t:
            f.append("sign")
        if sum(c.isdigit() for c in t) * 3 > n:
            f.append("digits")
        f.append("first" if i == 0 else "last" if i == len(seq) - 1 else "inner")
        out.append(f)
    return out


class Field:
    """Two labels: 1 is main text. Weights: a pair for each feature name, a 2 x 2 table of neighbours."""

    def __init__(self) -> None:
        self.weight: dict[str, np.ndarray] = {}
        self.next = np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.15, decay: float = 1e-3, seed: int = 0) -> None:
        """Stochastic ascent of the conditional log likelihood; expectations by forward-backward."""
        names = sorted({n for f, _ in pages for x in f for n in x})
        at = {n: i for i, n in enumerate(names)}
        w, g2 = np.zeros((len(names), 2)), np.full((len(names), 2), 1e-2)
        t2 = np.full((2, 2), 1e-2)
        r = random.Random(seed)
        ready = [([np.array([at[n] for n in x]) for x in f], np.array(y)) for f, y in pages if f]
        for _ in range(rounds):
            r.shuffle(ready)
            for rows, y in ready:
                e = np.array([w[x].sum(axis=0) for x in rows])
                node, edge = self._marginals(e)
                gap = -node
                gap[np.arange(len(y)), y] += 1
                grad = np.zeros_like(w)
                for x, d in zip(rows, gap):
                    grad[x] += d
                used = np.unique(np.concatenate(rows))
                step = grad[used] - decay * w[used]
                g2[used] += step**2
                w[used] += rate * step / np.sqrt(g2[used])
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                step = seen - edge - decay * self.next
                t2 += step**2
                self.next = self.next + rate * step / np.sqrt(t2)
        self.weight = {n: w[i] for n, i in at.items()}

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(e)
        a, b = e.copy(), np.zeros_like(e)
        for i in range(1, n):
            a[i] += np.logaddexp(a[i - 1, 0] + self.next[0], a[i - 1, 1] + self.next[1])
        for i in range(n - 2, -1, -1):
            v = e[i + 1] + b[i + 1]
            b[i] = np.logaddexp(self.next[:, 0] + v[0], self.next[:, 1] + v[1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        node = np.exp(a + b - z)
        edge = np.exp(a[:-1, :, None] + self.next[None] + (e + b)[1:, None, :] - z).sum(axis=0)
        return node, edge

    def decode(self, seq: list[Block]) -> list[int]:
        """The labels of the likeliest sequence (Viterbi); a feature not seen in training weighs nothing."""
        if not seq:
            return []
        (n00, n01), (n10, n11) = self.next.tolist()
        get = self.weight.get
        s0 = s1 = 0.0
        back: list[tuple[int, int]] = []
        for i, f in enumerate(features(seq)):
            e0 = e1 = 0.0
            for name in f:
                if (w := get(name)) is not None:
                    e0 += w[0]
                    e1 += w[1]
            if i == 0:
                s0, s1 = e0, e1
                continue
            a, b = s0 + n00, s1 + n10
            c, d = s0 + n01, s1 + n11
            back.append((int(b > a), int(d > c)))
            s0, s1 = e0 + max(a, b), e1 + max(c, d)
        label = int(s1 > s0)
        out = [label]
        for x in reversed(back):
            label = x[label]
            out.append(label)
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        seq = blocks(page)
        return "\n".join(b.text for b, y in zip(seq, self.decode(seq)) if y)


def sample_page(r: random.Random) -> tuple[str, list[int]]:
    """A page in a layout of its own and the label of each of its blocks."""
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in "a e i o u an er on".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))

    def prose() -> str:
        kind = r.random()
        if kind < 0.15:
            return some(1, 3).capitalize() + "."
        if kind < 0.25:
            return " | ".join(word() for _ in range(r.randint(3, 20)))
        if kind < 0.32:
            return " ".join(w.upper() + "!!" for w in some(3, 30).split())
        if kind < 0.4:
            return some(3, 40).capitalize()
        return " ".join(some(3, 14).capitalize() + "." for _ in range(r.randint(1, 9)))

    out: list[str] = []
    labels: list[int] = []

    def put(tag: str, text: str, label: int, link: bool = False, close: bool = True) -> None:
        body = f'<a href="/{word()}">{text}</a>' if link else text
        if label and r.random() < 0.05:
            body = f"{body} <math><mi>{word()}</mi> = <mn>2</mn></math>" if r.random() < 0.5 else f"<object>{body}</object>"
        elif label and r.random() < 0.2:
            body = f"<b>{body}" + ("</b>" if r.random() < 0.5 else "<br>")
        out.append(f"<{tag}>{body}" + (f"</{tag.split()[0]}>" if close else ""))
        labels.append(label)

    def hidden(label: int) -> None:
        how = r.choice([' style="display:none"', " style='display: none'", " hidden", ' aria-hidden="true"', ' style="visibility:hidden"'])
        tag = r.choice(["p", "div", "p", "section"])
        put(f"{tag}{how}", prose(), label)

    def furniture(kind: str) -> None:
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        names = {
            "nav": ["nav", "menu", "navbar", "breadcrumb", "navigation", "toc", "pagination", "menue", "navegacion", "navi"], "header": ["header", "top", "masthead", "banner", "site-header"], "footer": ["footer", "bottom", "copyright", "site-footer", "colophon", "fusszeile", "pied", "pie", "impressum"],
            "aside": ["sidebar", "side", "related", "widget", "recommended", "newsletter", "share", "social", "tags", "promo", "seitenleiste", "lateral"], "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "werbung", "anzeige", "publicite", "publicidad", "pub"],
            "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "subscribe", "overlay", "hinweis", "avis", "aviso"], "comments": ["comments", "comment", "comment-list", "disqus", "replies", "discussion", "responses", "reader-comments", "kommentare", "kommentar", "commentaires", "comentarios", "commenti"],
            "form": ["form", "search", "login", "signup", "newsletter", "contact"],
        }[kind]
        tag = plain if plain and r.random() < 0.6 else r.choice(["div", "section"] if kind in ("comments", "notice") else ["div"])
        name = f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if tag == "div" or tag == "section" or r.random() < 0.4 else ""
        out.append(f"<{tag}{name}>")
        if kind == "nav":
            out.append("<ul>")
            for _ in range(r.randint(2, 7)):
                put("li", some(1, 3), 0, link=True)
            out.append("</ul>")
        elif kind == "comments":
            for _ in range(r.randint(1, 4)):
                if r.random() < 0.5:
                    put("h4", some(1, 2), 0)
                put(r.choice(["p", "li", "div"]), prose(), 0)
        elif kind == "form":
            put("label", some(1, 3), 0)
            out[-1] = out[-1].replace("<label>", "<div>").replace("</label>", "</div>") + '<input type="text">'
            if r.random() < 0.3:
                out.append("<select>")
                for _ in range(r.randint(2, 4)):
                    put("option", some(1, 2), 0, close=r.random() < 0.7)
                out.append("</select>")
            if r.random() < 0.5:
                put("button", some(1, 2), 0)
        else:
            for _ in range(r.randint(1, 3)):
                text = ("&copy; " + some(1, 4)) if kind == "footer" and r.random() < 0.6 else prose() if r.random() < 0.6 else some(1, 8)
                put(r.choice(["p", "div", "span", "li"]) if r.random() < 0.7 else "h3", text, 0, link=r.random() < 0.25)
                if out[-1].startswith("<span"):
                    out[-1] = out[-1].replace("<span>", "<p>").replace("</span>", "</p>")
        out.append(f"</{tag}>")

    for kind in r.sample(["nav", "header", "notice", "ad", "form"], r.randint(0, 4)):
        furniture(kind)
    if r.random() < 0.2:
        hidden(0)
    tag, name = r.choice([("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' class="article-body"'), ("div", ' id="main"'), ("div", ' class="post-content entry"'), ("section", ' class="story text"'), ("div", ""), ("div", ' class="artikel"'), ("div", ' class="contenu"'), ("div", ' class="contenido"'), ("div", ' class="beitrag inhalt"')])
    out.append(f"<{tag}{name}>")
    put(r.choice(["h1", "h1", "h1", "h2"]), some(3, 10).capitalize(), 1)
    for i in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.06:
            put(r.choice(["h2", "h3"]), some(2, 7).capitalize(), 1)
        elif kind < 0.1:
            out.append("<ul>")
            for _ in range(r.randint(2, 4)):
                put("li", prose(), 1)
            out.append("</ul>")
        elif kind < 0.14:
            put("blockquote", prose(), 1)
        else:
            put("p", prose(), 1, close=r.random() < 0.8)
        if r.random() < 0.05:
            furniture(r.choice(["ad", "aside", "notice", "form"]))
        if r.random() < 0.04:
            hidden(0)
    out.append(f"</{tag}>")
    for kind in r.sample(["comments", "aside", "footer", "ad", "nav", "notice"], r.randint(0, 4)):
        furniture(kind)
    return "<html><head><title>x</title></head><body>" + "".join(out) + "</body></html>", labels


def train(n_pages: int = 500, seed: int = 11) -> Field:
    """The field fitted on n_pages generated pages."""
    r = random.Random(seed)
    pages = []
    while len(pages) < n_pages:
        page, labels = sample_page(r)
        seq = blocks(page)
        if len(seq) == len(labels):
            pages.append((features(seq), labels))
    f = Field()
    f.fit(pages, seed=seed)
    return f


def extract(pages: DataFrame, field_: Field, column: str = "html") -> DataFrame:
    """pages with text, the blocks labelled main in page order joined by line feeds, and n_chars, its code points.

    A null or empty page gives an empty text; a page cut off anywhere is read as far as it goes. Only the content of
    scripts, styles, templates, frames, text areas and titles is skipped unread, and to the page's end where it never
    closes; every other element's blocks are labelled. Rows are independent; columns of pages with these names are
    replaced.
    """

    @F.pandas_udf("string")
    def main(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([field_.main_text(p) for p in b], dtype=object)

    return pages.withColumn("text", main(column)).withColumn("n_chars", F.length("text").cast("long"))
