"""Main text of web pages: the contiguous run of a page with the greatest sum of word and tag scores."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that rarely hold main text; a prior, which labelled pages may overrule.
DOUBTED = frozenset("head header nav footer aside form button select svg template dialog menu canvas object video audio math".split())
#: Words in class, id or role names that elements of this kind often have; a prior like the above.
DOUBTED_NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice notices alert cookie cookies consent banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion popup modal overlay form search newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond disqus discussion pagination pager widget toolbar copyright legal complementary contentinfo hidden skip".split())
#: Words that make a name tell how a page is laid out, not what an element holds (with-sidebar, menu-closed).
LAYOUT = frozenset("with without has have no not is layout page closed open opened collapsed expanded enabled disabled fixed sticky theme".split())
#: Elements inside a line of text; any other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; without an end tag they reach to the end of the page.
RAW = frozenset("script style noscript textarea iframe".split())
#: Elements that mark nothing by their tag, only by their names.
PLAIN = INLINE | VOID | frozenset("html body article main div section p center ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hgroup fieldset legend label".split())
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_EMPTY = re.compile("<!--+>")
_EDGE = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
#: Names of elements with readers' comments.
COMMENTS = frozenset("comment comments reply replies respond disqus discussion".split())
#: Without labelled pages.
DEFAULT = {"word": 0.5, "link": 0.2, "tag": -0.5}
#: A tag that no labelled page has: nothing speaks against it.
UNSEEN = -0.1
#: An element whose features say that its words are main text less often than this is set apart.
APART = 0.1


@dataclass
class Page:
    """The page as parallel lists: kind ('text', 'open', 'close'), name of the tag or of the element that text stands in,
    the text or the tag's attributes, and the place of an opening tag's end tag (-1: it has none)."""

    kind: list[str] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    end: list[int] = field(default_factory=list)

    def add(self, kind: str, name: str, text: str = "") -> None:
        self.kind.append(kind)
        self.name.append(name)
        self.text.append(text)
        self.end.append(-1)


def read(page: str) -> Page:
    """One pass from left to right; time grows with the page's length, whatever is left open in it."""
    out = Page()
    low = page.lower()
    if len(low) != len(page):  # some letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
    last = {q: page.rfind(q) for q in "\"'"}
    gone: set[str] = set()  # raw elements without any end tag from here on
    opened: dict[str, list[int]] = {}
    block: list[str] = []
    links, i, size = 0, 0, len(page)
    while i < size:
        at = page.find("<", i)
        at = size if at < 0 else at
        if at > i:
            out.add("text", "a" if links else (block[-1] if block else ""), page[i:at])
        if at == size:
            break
        if page.startswith("<!--", at):
            empty = _EMPTY.match(page, at)
            close = page.find("-->", at + 4)
            i = empty.end() if empty else size if close < 0 else close + 3
            continue
        m = _TAG.match(page, at + 1)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?"):
                close = page.find(">", at)
                i = size if close < 0 else close + 1
            else:
                out.add("text", "a" if links else (block[-1] if block else ""), "<")
                i = at + 1
            continue
        stop = m.end()
        while (e := _EDGE.search(page, stop)) and e[0] != ">":
            stop = page.find(e[0], e.start() + 1) + 1 if e.start() < last[e[0]] else e.start() + 1
        tag, closing = m[2].lower(), bool(m[1])
        attributes = page[m.end() : e.start() if e else size]
        i = e.end() if e else size
        if closing:
            own = opened.get(tag)
            if own:
                out.end[own.pop()] = len(out.kind)
            if tag not in INLINE and tag in block:
                while block.pop() != tag:
                    pass
            links = 0 if tag == "a" else links
            out.add("close", tag)
            continue
        if tag in RAW:
            if tag not in gone:
                close = low.find(f"</{tag}", i)
                if close < 0:
                    gone.add(tag)
                else:
                    after = page.find(">", close)
                    i = size if after < 0 else after + 1
                    continue
            i = size
            continue
        out.add("open", tag, attributes)
        if tag in VOID or attributes.endswith("/"):
            out.end[-1] = len(out.kind) - 1
            continue
        if tag == "a":
            links = 1
        elif tag not in INLINE:
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and block and block[-1] == tag:
                block.pop()  # its end tag may be left out
            block.append(tag)
            links = 0
            if len(block) > 500:
                del block[:250]
        opened.setdefault(tag, []).append(len(out.kind) - 1)
    return out


def features(tag: str, attributes: str) -> list[str]:
    """What an element shows of itself: its tag, if that says anything, and the words of its names."""
    out = [] if tag in PLAIN else [f"<{tag}>"]
    if attributes and tag not in ("html", "body", "article", "main"):
        for m in _NAMES.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").lower().split():
                parts = _PARTS.findall(token)
                if not LAYOUT.intersection(parts):
                    out.extend(parts)
    return out


@dataclass
class Scores:
    """Learned: words by element, tags, and the features' shares of elements that hold main text."""

    words: dict[str, float]
    tags: dict[str, float]
    kept: dict[str, float]

    def word(self, name: str) -> float:
        return self.words.get(name, DEFAULT["link" if name == "a" else "word"])

    def tag(self, name: str) -> float:
        return self.tags.get(name, UNSEEN if self.tags else DEFAULT["tag"])

    def share(self, feature: str) -> float:
        doubted = feature[1:-1] in DOUBTED if feature[0] == "<" else feature in DOUBTED_NAMES
        return self.kept.get(feature, 0.02 if doubted else 0.5)


def _prose(page: Page, i: int) -> bool:
    """Whether the element reads as running text: paragraphs of 20 words and more on the whole, few of them links, nothing to fill in."""
    words = links = paragraphs = 0
    for k in range(i + 1, page.end[i]):
        if page.kind[k] == "text":
            n = len(page.text[k].split())
            words, links = words + n, links + n * (page.name[k] == "a")
        elif page.kind[k] == "open":
            paragraphs += page.name[k] == "p"
            if page.name[k] in ("form", "input", "button", "select", "nav"):
                return False
    return words >= 40 and 5 * links < words and 0 < 20 * paragraphs <= words


def apart(page: Page, scores: Scores) -> list[bool]:
    """Which tokens lie in an element that is set apart: one with a feature of little main text, if it is closed and
    holds no article or main element. A form with over half of the page's words is the page's frame, not a form. A
    section within an article is a chapter, whatever its name says, if it reads as one and is none of comments."""
    n = len(page.kind)
    holds, words = [0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        holds[i + 1] = holds[i] + (page.kind[i] == "open" and page.name[i] in ("article", "main"))
        words[i + 1] = words[i] + (len(page.text[i].split()) if page.kind[i] == "text" else 0)
    out, until, depth = [False] * n, -1, 0
    for i in range(n):
        if page.name[i] == "article" and page.kind[i] != "text":
            depth = max(0, depth + (1 if page.kind[i] == "open" else -1))
        if i <= until:
            out[i] = True
        elif page.kind[i] == "open" and page.end[i] > i and holds[page.end[i]] == holds[i]:
            own = features(page.name[i], page.text[i])
            if not any(scores.share(f) < APART for f in own):
                continue
            frame = page.name[i] == "form" and 2 * (words[page.end[i]] - words[i]) > words[n]
            chapter = page.name[i] == "section" and depth and not COMMENTS.intersection(own) and _prose(page, i)
            if not frame and not chapter:
                out[i], until = True, page.end[i]
    return out


def count(html: str | None) -> Counter:
    """What one labelled page teaches, as counts by (kind, name): its main text is what stands in an article element.

    'kept' and 'seen' count elements by their features: an element that holds main text or stands in it is kept; one
    that holds none, and whose parent does, is seen and not kept; what stands deeper in such an element says nothing.
    Nor does an article tell whether a doubted element inside it, a notice or comments, is main text.
    Words and tags in elements that the prior sets apart are left out, as extract() charges nothing for them.
    """
    out: Counter = Counter()
    if not html:
        return out
    page = read(html)
    n = len(page.kind)
    inside, depth = [False] * n, 0
    for i in range(n):
        if page.name[i] == "article" and page.kind[i] != "text":
            depth = max(0, depth + (1 if page.kind[i] == "open" else -1))
            inside[i] = True
        else:
            inside[i] = depth > 0
    if not any(inside):
        return out
    main = [0] * (n + 1)
    for i in range(n):
        main[i + 1] = main[i] + inside[i]
    until, prior = -1, Scores({}, {}, {})
    for i in range(n):
        if i <= until or page.kind[i] != "open" or page.end[i] <= i:
            continue
        holds = main[page.end[i]] > main[i]
        if not holds:
            until = page.end[i]
        for f in set(features(page.name[i], page.text[i])):
            if not inside[i] or prior.share(f) > APART:
                out["seen", f] += 1
                out["kept", f] += holds
    away = apart(page, prior)
    for i in range(n):
        if away[i]:
            continue
        if page.kind[i] == "text":
            words = len(page.text[i].split())
            out["words", page.name[i]] += words
            out["main", page.name[i]] += words * inside[i]
        else:
            out["tags", page.name[i]] += 1
            out["inner", page.name[i]] += inside[i]
    return out


def learn(counts: Counter, smooth: float = 2.0) -> Scores:
    """A word scores the share of main text among the words of its kind of element, which is positive; a tag is always
    negative, the more the seldomer it stands in main text. A feature's share starts from its prior, worth ten elements."""
    words = {k: round((counts["main", k] + smooth) / (n + 2 * smooth), 4) for (kind, k), n in counts.items() if kind == "words"}
    tags = {k: round(-0.1 + min(0.0, math.log((counts["inner", k] + smooth) / (n + 2 * smooth))), 4) for (kind, k), n in counts.items() if kind == "tags"}
    prior = Scores({}, {}, {})
    kept = {k: round((counts["kept", k] + 10 * prior.share(k)) / (n + 10), 4) for (kind, k), n in counts.items() if kind == "seen"}
    return Scores(words, tags, kept)


def best_run(values: list[float]) -> tuple[int, int]:
    """The contiguous run of the greatest positive sum, the first of equals; (0, 0) if no sum is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(html: str | None, scores: Scores) -> str:
    """The text of the best-scoring contiguous run; words of elements set apart score nothing and are left out."""
    if not html:
        return ""
    page = read(html)
    away = apart(page, scores)
    values = []
    for kind, name, text, off in zip(page.kind, page.name, page.text, away, strict=True):
        values.append(0.0 if off else len(text.split()) * scores.word(name) if kind == "text" else scores.tag(name))
    out = []
    for i in range(*best_run(values)):
        if page.kind[i] == "text":
            if not away[i]:
                out.append(html_lib.unescape(page.text[i]))
        elif page.name[i] not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def learn_scores(pages: DataFrame, max_pages: int = 2000) -> Scores:
    """Scores learned from about ``max_pages`` pages, those of the smallest hashes of their ids, among them the labelled ones.

    Pages are counted first and chosen by id; they are read and counted whole in tasks, and only sums are collected.
    """
    parts = 1_000_000
    share = min(parts, 1 + parts * max_pages // max(1, pages.count()))
    chosen = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(parts)) < share).where(F.col("html").contains("<article")).select("html")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch["html"]:
                total.update(count(html))
        yield pd.DataFrame([(kind, name, n) for (kind, name), n in total.items()], columns=["kind", "name", "n"])

    rows = chosen.mapInPandas(counted, "kind string, name string, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")).collect()
    return learn(Counter({(r["kind"], r["name"]): r["n"] for r in rows}))


def extract_pages(pages: DataFrame, scores: Scores | None = None) -> DataFrame:
    """page_id, url and the main text of every row; a null or empty page, or one without main text, gives ''.

    Repeated rows stay; other columns are ignored; an empty table gives no row. A page is read whole, in time that
    grows with its length.
    """
    scores = learn_scores(pages) if scores is None else scores

    @F.pandas_udf("string")
    def main_text(page: pd.Series) -> pd.Series:
        return pd.Series([extract(x, scores) for x in page], dtype=object)

    return pages.select("page_id", "url", main_text("html").alias("text"))
