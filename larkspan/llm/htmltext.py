"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is the text between two block boundaries (tags of block elements, line breaks, rows and cells), with its open
ancestors. Its features are the ancestors' tags, the words of their classes, ids and roles, and facts about its text: length,
share of link text, marks at its end, notice words. The chain has two labels, main text and the rest; it is trained by
gradient ascent on the conditional likelihood of labelled pages (forward-backward), and decoded by Viterbi.

The labelled pages are PAGES pages that `labelled_page` lays out in many ways (seeded): content in article, main or
classed divs among menus, headers, sidebars, notices, adverts, forms, comments and footers, every block with its label.
Pages may be given instead.

Pages are read once, by a scanner that never goes back: a tag ends at the first '>' outside closed quotes (from the first tag
on that would not end so, at the first '>'). The cost of a block doesn't grow with its depth, since of its ancestors only
features that the model knows are held, each once.

Defined results: null and empty html have the text ''; an unclosed script, style or comment runs to the end; a '<' that
opens no tag is text; scripts, styles, templates, comments, titles and form fields never give blocks; the text of math, svg
and object elements belongs to the block around them; character references are decoded (those of no character become
U+FFFD), white space (Unicode) inside a block becomes one space; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._common import table

PAGES, STEPS, SEED = 400, 200, 5
#: elements whose content is no text of the page, up to their end tag
RAW = frozenset("script style noscript template textarea iframe title select annotation annotation-xml".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
FOREIGN = frozenset({"math", "svg"})  # all tags inside them are inline
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr link meta base object math svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = re.compile(r"(?<![\w-])(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SMALL = re.compile(r"[a-z]+")
ZEROS, LARGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")  # longer than any character's number
NOTICE = re.compile(r"(?i)\b(cookies?|subscribe|newsletter|sign up|log in|advertisement|sponsored|all rights reserved|privacy policy|terms of use|share this|repl(?:y|ies)|comments?)\b")
#: an open p or list item ends where one of these begins
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


def decoded(text: str) -> str:
    if "&" not in text:
        return text
    return entities.unescape(LARGE.sub("\ufffd", ZEROS.sub("&#", text)))


class Scanner:
    """Pieces of markup in order: ("text", text), ("open" or "shut", tag, attributes). Linear in the length of the page."""

    def __init__(self, page: str):
        self.page = page
        self.none: set[str] = set()  # strings that don't come again
        self.quotes = True

    def after(self, what: str, at: int) -> int:
        """The end of the next occurrence of what, or -1."""
        if what in self.none:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.none.add(what)
            return -1
        return i + len(what)

    def tag_end(self, at: int) -> int:
        """The end of the tag whose attributes begin at `at`, or -1."""
        if not self.quotes:
            return self.after(">", at)
        page, i = self.page, at
        while True:
            end = self.after(">", i)
            if end < 0:
                break
            places = [(x, q) for q in "\"'" if (x := page.find(q, i, end)) >= 0]
            if not places:
                return end
            x, q = min(places)
            i = self.after(q, x + 1)
            if i < 0:  # never closed: no more than a character
                return end
        self.quotes = False
        return self.after(">", at)

    def __iter__(self) -> Iterator[tuple]:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            i = page.find("<", at)
            if i < 0:
                yield "text", page[at:], ""
                return
            if i > at:
                yield "text", page[at:i], ""
            at = i
            if page.startswith("<!--", i) or page.startswith("<![CDATA[", i):
                at = self.after("-->" if page[i + 2] == "-" else "]]>", i + 4)
                at = n if at < 0 else at
                continue
            if page[i + 1 : i + 2] in ("!", "?"):
                at = self.after(">", i)
                if at > 0:
                    continue
                at = i
            m = NAME.match(page, i + 1)
            end = self.tag_end(m.end()) if m else -1
            if end < 0:
                yield "text", "<", ""
                at = i + 1
                continue
            at = end
            tag = m.group(1).lower()
            shut = page[i + 1] == "/"
            if tag in RAW and not shut:
                close = RAW_END[tag].search(page, at)
                at = self.after(">", close.end()) if close else n
                at = n if at < 0 else at
                yield "raw", tag, ""
                continue
            yield "shut" if shut else "open", tag, page[m.end() : end - 1]


class Ancestors:
    """Open elements, and how many of them have each feature. With known, only those features are held."""

    def __init__(self, known=None):
        self.known = known
        self.stack: list[tuple[str, list[str]]] = []
        self.tags: Counter = Counter()
        self.held: Counter = Counter()

    def push(self, tag: str, words: list[str]) -> None:
        own = ["t:" + tag, *["c:" + w for w in words]]
        if self.known is not None:
            own = [f for f in own if f in self.known]
        self.stack.append((tag, own))
        self.tags[tag] += 1
        self.held.update(own)

    def pop(self) -> None:
        tag, own = self.stack.pop()
        self.tags[tag] -= 1
        for f in own:
            self.held[f] -= 1
            if not self.held[f]:
                del self.held[f]

    def close(self, tag: str) -> None:
        while self.tags[tag]:
            last = self.stack[-1][0]
            self.pop()
            if last == tag:
                return


def leaf_blocks(page: str | None, known=None) -> list[tuple[str, list[str]]]:
    """(text, features) of the leaf blocks in page order. known: the features that a model knows; others are left out."""
    out: list[tuple[str, list[str]]] = []
    open_ = Ancestors(known)
    parts: list[str] = []
    link, linked, inside = False, 0, ""

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(decoded("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, features(text, open_, linked)))
        linked = 0

    for what, tag, attributes in Scanner(page or ""):
        if what == "text":
            parts.append(tag)
            if link:
                linked += len(tag.strip())
            continue
        if what == "raw":
            if not inside:
                close()
            continue
        if inside:
            if what == "shut" and tag == inside:
                inside = ""
            continue
        if tag in INLINE:
            if tag == "a":
                link = what == "open"
            elif tag in FOREIGN and what == "open" and not attributes.rstrip().endswith("/"):
                inside = tag
            continue
        close()
        if what == "shut":
            open_.close(tag)
            continue
        if tag in VOID:
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else None)
        while ends and open_.stack and open_.stack[-1][0] in ends:
            open_.pop()
        words: list[str] = []
        if attributes:
            words = list(dict.fromkeys(w for x in NAMED.findall(attributes) for w in SMALL.findall("".join(x).lower())))
            if HIDDEN.search(attributes):
                words.append("*hidden")
        open_.push(tag, words)
    close()
    return out


def features(text: str, open_: Ancestors, linked: int) -> list[str]:
    out = set(open_.held)
    out.add("p:" + (open_.stack[-1][0] if open_.stack else ""))
    n = text.count(" ") + 1
    out.add("n:" + ("1" if n < 2 else "4" if n < 5 else "12" if n < 13 else "40" if n < 41 else "more"))
    share = linked / len(text)
    out.add("l:" + ("0" if share < 0.1 else "half" if share < 0.6 else "all"))
    out.add("e:" + ("stop" if text[-1] in ".!?" else "other"))
    if "©" in text:
        out.add("x:copyright")
    if NOTICE.search(text):
        out.add("x:notice")
    return list(out)


class Chain:
    """A two-label linear-chain conditional random field. weights: of label 1 against label 0, by feature."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.start, self.turn = np.zeros(2), np.zeros((2, 2))

    def fit(self, pages: list[list[tuple[list[str], int]]], steps: int = STEPS, rate: float = 0.3, ridge: float = 1e-3) -> Chain:
        """pages: for each block its features and label."""
        pages = [p for p in pages if p]
        names = sorted({f for p in pages for x, _ in p for f in x})
        number = {f: i for i, f in enumerate(names)}
        long, many = max(map(len, pages)), len(pages)
        block, feature = [], []
        gold, here = np.zeros((many, long), np.int64), np.zeros((many, long), bool)
        for i, p in enumerate(pages):
            for j, (x, y) in enumerate(p):
                gold[i, j], here[i, j] = y, True
                block += [i * long + j] * len(x)
                feature += [number[f] for f in x]
        block, feature = np.array(block), np.array(feature)
        theta = np.zeros(len(names) + 6)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        pairs = here[:, 1:]
        for step in range(1, steps + 1):
            w, start, turn = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
            one = np.bincount(block, w[feature], many * long).reshape(many, long)
            score = np.stack([np.zeros_like(one), one], 2)
            f, b = np.zeros((many, long, 2)), np.zeros((many, long, 2))
            f[:, 0] = start + score[:, 0]
            for t in range(1, long):
                new = np.logaddexp.reduce(f[:, t - 1, :, None] + turn, 1) + score[:, t]
                f[:, t] = np.where(here[:, t, None], new, f[:, t - 1])
            for t in range(long - 2, -1, -1):
                new = np.logaddexp.reduce(turn + (score[:, t + 1] + b[:, t + 1])[:, None, :], 2)
                b[:, t] = np.where(here[:, t + 1, None], new, b[:, t + 1])
            z = np.logaddexp.reduce(f[:, -1], 1)
            p = np.exp(f + b - z[:, None, None])
            edge = np.exp(f[:, :-1, :, None] + turn + (score[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
            seen = np.zeros((2, 2))
            np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
            rest = ((gold - p[:, :, 1]) * here).reshape(-1)
            grad = np.concatenate([np.bincount(feature, rest[block], len(names)), np.eye(2)[gold[:, 0]].sum(0) - p[:, 0].sum(0), (seen - edge.sum((0, 1))).reshape(-1)]) / many - ridge * theta
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        self.weights = dict(zip(names, theta[:-6].tolist()))
        self.start, self.turn = theta[-6:-4].copy(), theta[-4:].reshape(2, 2).copy()
        return self

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        if not blocks:
            return []
        get = self.weights.get
        (a, b), ((aa, ab), (ba, bb)) = self.start.tolist(), self.turn.tolist()
        back: list[tuple[int, int]] = []
        for i, x in enumerate(blocks):
            one = sum([get(f, 0.0) for f in x])
            if i:
                from_a, from_b = (0, a + aa) if a + aa >= b + ba else (1, b + ba), (0, a + ab) if a + ab >= b + bb else (1, b + bb)
                back.append((from_a[0], from_b[0]))
                a, b = from_a[1], from_b[1] + one
            else:
                b += one
        label = int(b > a)
        out = [label]
        for x in reversed(back):
            label = x[label]
            out.append(label)
        return out[::-1]


def labelled_page(r: random.Random) -> list[tuple[str, int]]:
    """A page as pieces of markup, each with 1 if its text is main text."""
    word = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", ".", ",", "", "?"])
    out: list[tuple[str, int]] = []
    add = lambda s, y=0: out.append((s, y))

    def boxed(names: list[str], inner) -> None:
        tag = r.choice(["div", "div", "section", "aside", "ul"])
        name = r.choice(names)
        add(f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice([name, name, name + "-" + word(), "site-" + name])}">')
        inner()
        add(f"</{tag}>")

    def menu() -> None:
        def items() -> None:
            for _ in range(r.randint(2, 7)):
                add(f'<li><a href="/{word()}">{word()}</a></li>')

        if r.random() < 0.7:
            add(r.choice(["<nav><ul>", '<nav class="menu"><ul>', "<nav>"])), items(), add("</nav>")
        else:
            boxed(["menu", "nav", "navigation", "navbar", "breadcrumb", "toolbar", "tabs"], items)

    plain = lambda lo, hi: lambda: [add(f"<p>{say(lo, hi)}</p>" if r.random() < 0.5 else say(lo, hi)) for _ in range(r.randint(1, 3))]
    advert = lambda: boxed(["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"], plain(3, 15))
    notice = lambda: boxed(["cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "gdpr", "banner", "message"], lambda: [add(f"<p>{say(4, 25)}</p>"), add("<button>OK</button>")])
    side = lambda: (add(r.choice(["<aside>", '<aside class="sidebar">'])), plain(2, 30)(), add("</aside>")) if r.random() < 0.6 else boxed(["sidebar", "side", "related", "recommended", "widget", "widgets", "popular", "trending", "tags", "share", "social"], plain(2, 30))

    def form() -> None:
        add(r.choice(["<form>", '<form action="/s">', '<form class="search">'])), add(f"<label>{word()}</label><input name=q>"), add(f"<p>{say(2, 9)}</p>"), add("<button>Go</button></form>")

    def comments() -> None:
        def each() -> None:
            for _ in range(r.randint(1, 5)):
                add(f'<{r.choice(["div", "li", "p", "article"])} class="{r.choice(["comment", "reply", "comment-body"])}">'), add(f"<b>{word()}</b>"), add(f"<p>{say(3, 40)}</p>"), add("</div>")

        boxed(["comments", "comment", "comment-list", "discussion", "replies", "responses", "disqus"], each)

    def footer() -> None:
        add(r.choice(["<footer>", '<footer class="foot">', '<div class="footer">', '<div id="footer">']))
        add(f"&copy; {word()}.example.com &middot; {say(3, 20)}" if r.random() < 0.7 else f"<p>{say(3, 20)}</p>")
        add(r.choice(["</footer>", "</div>"]) if r.random() < 0.8 else "")

    def article() -> None:
        shell = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        name = r.choice(["content", "post", "entry", "article", "story", "main", "text", "body", "post-content", "article-body", "entry-content"])
        add(f"<{shell}>" if shell in ("article", "main") and r.random() < 0.7 else f'<{shell} {r.choice(["class", "id"])}="{name}">')
        if r.random() < 0.2:  # a short note and no more
            if r.random() < 0.4:
                add(f"<h1>{say(1, 8)}</h1>", 1)
            add(f"<p>{say(1, 12)}</p>" if r.random() < 0.8 else f"<div>{say(1, 12)}</div>", 1)
            add(f"</{shell}>")
            return
        if r.random() < 0.8:
            add(f"<h1>{say(1, 12)}</h1>", 1)
        if r.random() < 0.4:
            add(f"<p>{say(1, 10)}<br>{say(1, 20)}</p>", 1)
        if r.random() < 0.1:
            add("<div hidden>" if r.random() < 0.5 else '<div style="display:none">'), add(f"<p>{say(2, 20)}</p>"), add("</div>")
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.72:
                add(f"<p>{say(1, 90)}</p>" if r.random() < 0.8 else f"<p>{say(1, 60)}", 1)
            elif x < 0.78:
                add(f"<h{r.randint(2, 4)}>{say(1, 8)}</h2>", 1)
            elif x < 0.83:
                add("<ul>"), [add(f"<li>{say(1, 20)}</li>", 1) for _ in range(r.randint(1, 5))], add("</ul>")
            elif x < 0.86:
                add(f"<blockquote><p>{say(3, 40)}</p></blockquote>", 1)
            elif x < 0.88:
                add("<table>"), [add(f"<tr><td>{say(1, 5)}</td></tr>", 1) for _ in range(r.randint(1, 4))], add("</table>")
            elif x < 0.90:
                add(f"<pre>{say(2, 30)}</pre>", 1)
            elif x < 0.92:
                add(f'<p>{say(1, 20)} <a href="/x">{word()}</a> {say(1, 20)}</p>', 1)
            elif x < 0.94:
                advert()
            elif x < 0.955:
                side()
            elif x < 0.965:
                form()
            elif x < 0.975:
                notice()
            elif x < 0.985:
                add("<header>"), add(f"<p>{say(1, 9)}</p>"), add("</header>")
            else:
                add("<footer>"), add(f"<p>{say(1, 12)}</p>"), add("</footer>")
        if r.random() < 0.12:
            comments()
        add(f"</{shell}>")

    add("<!DOCTYPE html><html><head><title>x</title></head><body>")
    alone = r.random() < 0.1  # a page with nothing but its article
    if not alone and r.random() < 0.4:
        add(r.choice(["<header>", '<div class="header">', '<div id="masthead">'])), add(f"<p>{say(1, 9)}</p>"), menu(), add(r.choice(["</header>", "</div>"]))
    for extra, share in ((menu, 0.7), (advert, 0.4), (notice, 0.3), (side, 0.2), (form, 0.15)):
        if not alone and r.random() < share:
            extra()
    article()
    for extra, share in ((comments, 0.35), (side, 0.3), (advert, 0.25), (form, 0.2), (notice, 0.15), (menu, 0.15), (footer, 0.9)):
        if not alone and r.random() < share:
            extra()
    return out


def labelled_blocks(pieces: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Features and labels of a labelled page's leaf blocks. A text's label is marked inside it, then taken off."""
    marked = "".join(re.sub(r"(>|^)([^<>]*[^<>\s][^<>]*)(?=<|$)", lambda m: m.group(1) + f"\ue000{y}" + m.group(2), s) for s, y in pieces)
    plain = leaf_blocks("".join(s for s, _ in pieces))
    return [(x, int("\ue0001" in text)) for (text, _), (_, x) in zip(leaf_blocks(marked), plain)]


def trained(pages: int = PAGES, seed: int = SEED, steps: int = STEPS) -> Chain:
    r = random.Random(seed)
    return Chain().fit([labelled_blocks(labelled_page(r)) for _ in range(pages)], steps)


def main_text(chain: Chain, page: str | None) -> str:
    blocks = leaf_blocks(page, chain.weights)
    return "\n".join([text for (text, _), y in zip(blocks, chain.decode([x for _, x in blocks])) if y])


def extract(pages: DataFrame, chain: Chain | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            texts = [main_text(chain, x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
