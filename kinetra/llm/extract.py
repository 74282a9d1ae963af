"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of their DOM.

A leaf block is a run of text between two block-level tags. Its features are the tags, classes and ids of its ancestors
and what its text is like (length, share of links, punctuation). A chain over the page's blocks is decoded by Viterbi:
blocks labelled as article are the text. The field is trained by gradient ascent on the likelihood of labelled pages:
a bounded sample of the pages, labelled by their own semantic markup, each also in layouts that say the same
by other tags and class names and that have sidebars, notices, adverts, forms and reader comments put in.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import slices, texts

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SIGN = re.compile(r"[>\"']")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
# Fixed values of HTML: elements without content, elements whose content is no text, elements within a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript iframe svg math canvas object textarea select".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol table dl div section article aside main nav header footer form body blockquote td th".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Path(NamedTuple):
    """What a block is within: a feature for each tag and each class or id word, the innermost two block tags."""

    names: frozenset[str]
    inner: str
    outer: str


TOP = Path(frozenset(), "", "")


class Block:
    __slots__ = ("label", "links", "path", "text")

    def __init__(self, text: str, path: Path, links: int, label: int):
        self.text, self.path, self.links, self.label = text, path, links, label


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(from, until, slash, tag, attributes) of each piece of markup in order; no tag for comments and declarations.

    A tag ends at the first > outside of quotes. One that never ends counts up to the next <. Each quote opens a value
    for at most one failing tag, and what does not come again is not searched for again: time is in proportion to the page.
    """
    at, n, dead, last, sign = 0, len(page), set(), page.rfind(">"), None
    gone = {'"': n + 1, "'": n + 1}  # from here on the quote does not come again
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", "", ""
            at = end
            continue
        name = NAME.match(page, at + 1)
        if not name and page[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        if at > last:  # nothing ends any more
            end = page.find("<", at + 1)
            end = n if end < 0 else end
            yield at, end, "", "", ""
            at = end
            continue
        if not name:
            end = page.find(">", at) + 1
            yield at, end, "", "", ""
            at = end
            continue
        where, opened, end = name.end(), [], -1
        while True:
            if sign is None or sign.start() < where:
                sign = SIGN.search(page, where)
            if sign is None or sign.start() in dead:
                break
            if sign[0] == ">":
                end = sign.end()
                break
            opened.append(sign.start())
            close = -1 if sign.end() >= gone[sign[0]] else page.find(sign[0], sign.end())
            if close < 0:
                gone[sign[0]] = min(gone[sign[0]], sign.end())
                break
            where = close + 1
        if end > 0:
            yield at, end, name[1], name[2].lower(), page[name.end() : end - 1]
        else:
            dead.update(opened)
            end = page.find("<", at + 1)
            end = n if end < 0 else end
            yield at, end, "", "", ""
        at = end


class Stack:
    """Open elements, with what closing needs counted: by tag, by tag within the innermost block and the innermost scope."""

    def __init__(self, known: dict | None):
        self.known = known  # features that matter; others are not carried, so that depth costs nothing
        self.tags: list[str] = []
        self.paths: list[Path] = [TOP]
        self.marks: list[int] = [0]
        self.open: Counter[str] = Counter()
        self.lines, self.scopes = [Counter()], [Counter()]

    def push(self, tag: str, attributes: str) -> None:
        path = self.paths[-1]
        names = {f"t={tag}"}
        if attributes:
            names |= {f"c={t}" for a in NAMES.finditer(attributes) for t in TOKEN.findall((a[1] or a[2] or a[3] or "").lower())}
        if self.known is not None:
            names = {x for x in names if x in self.known}
        names = path.names if names <= path.names else path.names | names
        solid = tag not in INLINE
        self.paths.append(Path(names, tag, path.inner) if solid else path._replace(names=names))
        self.marks.append(0 if "data-off" in attributes else 1 if "data-main" in attributes else self.marks[-1])
        self.tags.append(tag)
        self.open[tag] += 1
        if solid:
            self.lines.append(Counter())
        else:
            self.lines[-1][tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())
        else:
            self.scopes[-1][tag] += 1

    def pop_to(self, tags: set[str]) -> None:
        """Close elements up to the innermost of these tags."""
        found = False
        while not found and self.tags:
            tag = self.tags.pop()
            self.paths.pop()
            self.marks.pop()
            self.open[tag] -= 1
            if tag in INLINE:
                self.lines[-1][tag] -= 1
            else:
                self.lines.pop()
            if tag in SCOPES:
                self.scopes.pop()
            else:
                self.scopes[-1][tag] -= 1
            found = tag in tags

    def close(self, tag: str) -> None:
        """An end tag: passed over where nothing is open by that name; one within a line reaches no further than its block."""
        if (self.lines[-1] if tag in INLINE else self.open)[tag] > 0:
            self.pop_to({tag})

    def make_room(self, tag: str) -> None:
        """A block ends the paragraph, and an item its sibling, that is open in the same scope."""
        ends = CLOSES.get(tag, set()) | {"p"}
        held = ends - SCOPES
        if any(self.scopes[-1][t] > 0 for t in held):
            self.pop_to(held)
        elif len(self.scopes) > 1 and (ends & SCOPES) and self.tags and self.tags[-1] in ends:
            self.pop_to(ends & SCOPES)


def blocks(page: str, known: dict | None = None) -> list[Block]:
    """The page's leaf blocks in order. Marks data-main and data-off, which only training pages have, give labels."""
    out: list[Block] = []
    stack = Stack(known)
    parts: list[str] = []
    links, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack.paths[-1], links, stack.marks[-1]))
            parts, links = [], 0

    def take(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if stack.open["a"] > 0:
                links += len(text)

    for begin, end, slash, tag, attributes in markup(page):
        if begin < at:  # within what an element without text holds
            continue
        take(page[at:begin])
        at = end
        if not tag:
            continue
        empty = attributes.rstrip().endswith("/")
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if slash:
            stack.close(tag)
        elif tag in RAW:
            if not empty:
                found = RAW_END[tag].search(page, at)
                at = found.end() if found else n
        elif tag not in VOID and not empty:
            if tag not in INLINE:
                stack.make_room(tag)
            stack.push(tag, attributes)
    take(page[at:])
    flush()
    return out


def path_features(path: Path) -> list[str]:
    """Features of the ancestors: each tag, each class or id word, the innermost block tag and its parent."""
    return sorted(path.names | {f"in={path.inner}", f"up={path.outer}/{path.inner}"})


def text_features(block: Block) -> list[str]:
    n = len(block.text)
    share = block.links / max(n, 1)
    return ["bias", f"len={min(n.bit_length(), 9)}", f"links={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}", f"stop={block.text[-1] in '.!?:'}", f"mark={block.text[0] in '©|'}"]


class Field:
    """Weights of label 1 against label 0 by feature, and the chain's start and moves between labels."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.start, self.moves = np.zeros(2), np.zeros((2, 2))
        self.paths: dict[Path, float] = {}

    def emission(self, block: Block) -> float:
        held = self.paths.get(block.path)
        if held is None:
            held = sum(self.weights.get(f, 0.0) for f in path_features(block.path))
            if len(self.paths) < 50_000:
                self.paths[block.path] = held
        return held + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        no, yes = self.start[0], self.start[1] + self.emission(page[0])
        back = []
        for block in page[1:]:
            e = self.emission(block)
            from_no, from_yes = no + m00 >= yes + m10, no + m01 > yes + m11
            back.append((0 if from_no else 1, 0 if from_yes else 1))
            no, yes = max(no + m00, yes + m10), max(no + m01, yes + m11) + e
        label = int(yes > no)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 15, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """Adam on the penalised log likelihood: expected minus observed counts by the forward-backward algorithm."""
        names = sorted({f for page, _ in pages for fs in page for f in fs})
        ids = {f: i for i, f in enumerate(names)}
        data = [([np.array([ids[f] for f in fs]) for fs in page], np.array(labels)) for page, labels in pages if page]
        w = np.zeros(len(names) + 6)  # then start and moves
        m, v, step = np.zeros_like(w), np.zeros_like(w), 0
        rng = np.random.default_rng(13)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // 32)):
                grad = decay * w * len(part)
                start, moves = w[-6:-4], w[-4:].reshape(2, 2)
                for k in part.tolist():
                    page, labels = data[k]
                    e = np.zeros((len(page), 2))
                    e[:, 1] = [w[f].sum() for f in page]
                    ahead = np.empty_like(e)
                    ahead[0] = start + e[0]
                    for i in range(1, len(page)):
                        ahead[i] = e[i] + np.logaddexp(ahead[i - 1, 0] + moves[0], ahead[i - 1, 1] + moves[1])
                    behind = np.zeros_like(e)
                    for i in range(len(page) - 2, -1, -1):
                        behind[i] = np.logaddexp(moves[:, 0] + e[i + 1, 0] + behind[i + 1, 0], moves[:, 1] + e[i + 1, 1] + behind[i + 1, 1])
                    z = np.logaddexp(*ahead[-1])
                    p = np.exp(ahead + behind - z)
                    for f, d in zip(page, (p[:, 1] - labels).tolist(), strict=True):
                        grad[f] += d
                    grad[-6:-4] += p[0] - np.eye(2)[labels[0]]
                    if len(page) > 1:
                        pair = np.exp(ahead[:-1, :, None] + moves + (e + behind)[1:, None, :] - z).sum(axis=0)
                        seen = np.bincount(labels[:-1] * 2 + labels[1:], minlength=4).reshape(2, 2)
                        grad[-4:] += (pair - seen).ravel()
                grad /= len(part)
                step += 1
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = dict(zip(names, w[:-6].tolist(), strict=True))
        self.start, self.moves = w[-6:-4].copy(), w[-4:].reshape(2, 2).copy()
        return self


# Other names that layouts give to the parts of a page (fixed values).
MAIN = ['article', 'main', 'div class="post-content"', 'div class="article-body"', 'div id="content"', 'div class="entry-content"', 'section class="story"', 'div role="main"', 'div class="main-text"']
MENU = ['nav', 'div class="menu"', 'ul class="navbar"', 'div id="navigation"', 'header', 'div id="header"', 'div class="breadcrumbs"', 'div class="site-header top-bar"']
FOOT = ['footer', 'div id="footer"', 'div class="site-footer"', 'div class="copyright legal"', 'section class="bottom footer-links"']
AD = ['div class="ad"', 'div class="advert"', 'div class="ads banner"', 'aside class="sponsored"', 'div class="promo"', 'div id="advertisement"']
OTHER = [
    'aside', 'aside class="sidebar"', 'div class="sidebar"', 'div id="sidebar"', 'div class="related widget"', 'section class="related-posts"',
    'div class="cookie-notice"', 'div class="cookie consent banner"', 'div class="notice alert"', 'div role="alert"', 'div class="newsletter subscribe signup"', 'div class="popup modal"',
    'form', 'form class="search-form"', 'form class="login contact"',
    'section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments reader-comments"', 'div class="discussion responses replies"', 'div class="share social"', 'div class="author bio meta byline"',
]


def layouts(page: str, seed: int, more: int = 4) -> list[str]:
    """A page with an article in it, marked: as it is, and in `more` other layouts. No article, no pages."""
    found = re.search(MARKED, page)
    if not found:
        return []
    end = page.lower().rfind(f"</{found[1].lower()}>")
    end = end if end > 0 else len(page)
    before, body, after = page[: found.start()], page[found.end() : end], page[end:].partition(">")[2]
    rng = np.random.default_rng(seed)
    paragraphs = re.findall(r"<p>([^<]{20,})", body) or ["text."]
    out = [f"{before}<{found[1]} data-main>{body}</{found[1]}>{after}"]

    def pick(names: list[str]) -> tuple[str, str]:
        name = names[int(rng.integers(len(names)))]
        return name, name.split(" ")[0]

    def extra() -> str:
        name, tag = pick(OTHER)
        inner = "".join(f"<p>{paragraphs[int(rng.integers(len(paragraphs)))][: int(rng.integers(20, 400))]}</p>" for _ in range(int(rng.integers(1, 4))))
        if rng.random() < 0.3:
            inner = "<h3>" + paragraphs[0][:20] + "</h3>" + inner
        if rng.random() < 0.4:
            inner = "".join(f'<li><a href="#">{w}</a></li>' for w in paragraphs[0].split()[:5])
        elif "comment" in name and rng.random() < 0.7:
            inner = f'<div class="comment">{inner}</div>'
        elif tag == "form":
            inner = f"<label>{paragraphs[0][:12]}</label><input><button>{paragraphs[0][:8]}</button>" + (inner if rng.random() < 0.3 else "")
        return f"<{name} data-off>{inner}</{tag}>"

    for _ in range(more):
        main, main_tag = pick(MAIN)
        head, tail, inside = before, after, body
        for old, names in (("nav", MENU), ("footer", FOOT)):
            name, tag = pick(names)
            head, tail = (re.sub(rf"<{old}\b", f"<{name}", x).replace(f"</{old}>", f"</{tag}>") for x in (head, tail))
        name, tag = pick(AD)
        head = re.sub(r'<div class="ad">(.*?)</div>', lambda m, name=name, tag=tag: f"<{name}>{m[1]}</{tag}>", head, flags=re.S)
        for _ in range(int(rng.integers(0, 3))):
            head += extra()
        tail = "".join(extra() for _ in range(int(rng.integers(0, 4)))) + tail
        if rng.random() < 0.5:
            cut = inside.rfind("<p>") if rng.random() < 0.5 else len(inside)
            cut = len(inside) if cut < 0 else cut
            inside = inside[:cut] + extra() + inside[cut:]
        if rng.random() < 0.3:
            inside = inside.replace("<p>", "<h2>Part</h2><p>", 1) if rng.random() < 0.5 else inside.replace("<p>", "<blockquote><p>", 1).replace("</p>", "</p></blockquote>", 1)
        if rng.random() < 0.3:
            inside += f"<ul><li>{paragraphs[-1][:80]}</li><li>{paragraphs[0][:60]}</li></ul>"
        out.append(f"{head}<{main} data-main>{inside}</{main_tag}>{tail}")
    return out


#: What training looks for in a page: an article marked as such.
MARKED = r"(?i)<(article|main)\b[^>]*>"


def training_pages(pages: DataFrame, most: int) -> DataFrame:
    """text of about `most` different pages at most, by hash, among those that mark an article; repeats count once."""
    marked = pages.select(F.col("html").cast("string").alias("text")).where(F.col("text").rlike(MARKED))
    total = marked.select(F.xxhash64("text").alias("h")).distinct().count()
    share = min(1_000_000, int(1_000_000 * most / max(total, 1)) + 1)
    return marked.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).distinct()


def train(pages: DataFrame, most: int = 200) -> Field:
    """A field from about `most` pages at most that mark an article, by hash of the page, in five layouts each."""
    sample = training_pages(pages, most)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            rows = []
            for t in texts(batch):
                for k, page in enumerate(layouts(t.decode("utf-8", "ignore"), zlib.crc32(t))):
                    found = blocks(page)
                    if found:
                        rows.append((zlib.crc32(t), k, [path_features(b.path) + text_features(b) for b in found], [b.label for b in found]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.list_(pa.int32())))], names=["page", "layout", "features", "labels"])

    rows = sample.mapInArrow(label, "page bigint, layout int, features array<array<string>>, labels array<int>").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return Field().fit([(r[2], r[3]) for r in rows]) if rows else Field()


def extract(pages: DataFrame, most: int = 200) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    Whole pages are read. A null or empty html, or a page without an article, gives an empty text. Broken markup is
    read on, in time in proportion to the page: what is open stays open, what is closed without being open is passed
    over, a tag that never ends is dropped up to the next one. Labels that tie are 0. A null page_id or url is kept;
    repeated rows are done each. A table in which no page names its article by tag gives empty texts, having taught
    nothing. An empty table gives no rows.
    """
    held = pages.sparkSession.sparkContext.broadcast(train(pages, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = held.value
        for batch in slices(batches, 4 << 20):
            out = []
            for t in texts(batch):
                found = blocks(t.decode("utf-8", "ignore"), field.weights)
                out.append("\n".join(b.text for b, label in zip(found, field.decode(found), strict=True) if label))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
