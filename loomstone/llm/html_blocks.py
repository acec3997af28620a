"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at its block tags.  Each block gets its word
count and link density, those of the blocks before and after it, and flags read
from the elements around it: whether an element of furniture (by tag, by name)
lies between it and its article, whether it lies in an article, whether it is a
heading, whether it stands under a heading that announces further reading.  A small decision tree, grown here from the labelled blocks of
``SAMPLES``, keeps or drops each block; kept blocks are joined in page order.
Pages are independent, so the work is one pass without a shuffle.

A name counts by its head: ``post-header`` is a header, ``sidebar-layout-main``
a main part, ``comments-list`` comments, since ``list`` only holds them.  The
outermost article or main part clears what only wraps a layout (a form around a
page, a header or widget that holds it); comments, asides, footers, menus, adverts
and the like are never cleared, so articles inside them are theirs.  An article's
own class and id are read for comments, teasers and adverts only, since content
systems write an article's topics there.  A list of links in an article is text
unless its heading announces further reading.

Defined results: a null or empty page, and a page without a kept block, give an
empty text, an empty table an empty table; unclosed or unmatched tags end where
an enclosing tag ends; an unfinished tag at the end of a page is markup; pages of
any length are read whole, one at a time; repeated pages give equal texts; columns
beside the source are carried on, like-named ones are replaced.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomstone.llm.columns import append

#: Tags that begin a block, tags that hold no text, and tags, roles and names of page furniture.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
UNREAD_TAGS = frozenset("script style noscript template svg math iframe object embed canvas audio video map textarea select option button title head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar toolbar comment comments commentlist reply replies disqus discussion respond share sharing social related recommended trending pagination pager "
    "login search copyright disclaimer teaser teasers".split()
)
#: What only wraps a layout and is cleared by an article inside it; what an article's own names may say; words of headings that announce further reading.
WRAPPER_TAGS = frozenset("header form dialog fieldset".split())
WRAPPER_ROLES = frozenset("banner search form dialog".split())
WRAPPER_NAMES = frozenset("header masthead banner topbar toolbar widget widgets search overlay modal".split())
ARTICLE_NAMES = frozenset("comment comments reply replies teaser teasers ad adv advert advertisement sponsored promo promotion related recommended trending widget".split())
FURTHER_WORDS = frozenset("related recommended more popular trending latest share follow navigation menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of names that only say that something is held, and parts that say what a layout has.
HOLDERS = frozenset("area bar block body box button buttons card col column container content form group holder inner item items left link links list outer panel right row section slot text title unit wrap wrapper".split())
LAYOUTS = frozenset("has with no without hide show".split())
#: First parts of the names that content systems give an article for its topics.
TOPICS = LAYOUTS | frozenset("category tag topic type status format".split())
ARTICLE_TAGS = frozenset(("article", "main"))

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "tagged", "named", "article", "heading", "further")
#: Which of them are the counts and densities of the block and its neighbours.
DENSITIES = 6

#: The labelled blocks: {+40} is a block part of 40 words of main text, {-3@} one of 3 linked words that aren't, {+30/4} has 4 of its words linked.
SAMPLES = (
    # articles in an element of their own
    "<nav><ul><li>{-1@}</li><li>{-2@}</li><li>{-1@}</li></ul></nav><div class=ad>{-9}</div><article><h1>{+8}</h1><p>{+60}</p><p>{+45/3}</p><p>{+1}</p><p>{+120}</p></article><footer>{-12}</footer>",
    "<header>{-4@}</header><main><h1>{+5}</h1><p>{+3}</p><h2>{+2}</h2><p>{+30/9}</p><ul><li>{+4}</li><li>{+6}</li><li>{+2/1}</li></ul><p>{+9}</p></main><aside><h3>{-2}</h3><p>{-40}</p></aside>",
    "<div class=masthead>{-3@}</div><article><header><p>{-6}</p></header><h1>{+11}</h1><p>{+25}</p><ul><li>{+2@}</li><li>{+3@}</li><li>{+2@}</li><li>{+4@}</li></ul><p>{+70}</p><p>{+14/10}</p><p>{+50}</p></article>",
    "<article><p>{+2}</p><div class=share-bar><p>{-1@}</p><p>{-1@}</p></div><p>{+18}</p><section class=user-comments><h3>{-1}</h3><p>{-25}</p><p>{-60}</p><p>{-12}</p></section></article><p>{-3@}</p>",
    "<main><p>{+26}</p><div class=newsletter-signup><p>{-20}</p></div><p>{+7}</p><form><p>{-2}</p></form><p>{+90/8}</p><p>{+5/5}</p><p>{+33}</p><h2>{+1}</h2><ul><li>{+3@}</li><li>{+2@}</li><li>{+5@}</li></ul></main>",
    "<article><h1>{+4}</h1><p>{+1}</p><p>{+2}</p><p>{+1}</p><p>{+6}</p><h2>{+3}</h2><p>{+15}</p><p>{+8/2}</p></article><div class=related><p>{-8@}</p><p>{-7@}</p></div>",
    "<article><h1>{+6}</h1><p>{+64}</p><h2>keep More about the matter</h2><p>{+40}</p><p>{+30/3}</p><h2>drop Latest</h2><ul><li>{-3@}</li></ul></article><aside><article><h2>{-5}</h2><p>{-30}</p></article></aside>",
    "<main><article><p>{+22}</p><p>{+2@}</p><section class=comments><h2>{-2}</h2><article class=comment><p>{-30}</p></article><article><p>{-9}</p></article></section></article><article class=teaser><h3>{-6}</h3><p>{-18}</p></article></main>",
    "<div class=post-header><article><h1>{+6}</h1><p>{+80}</p><p>{+35}</p><div class=ad-slot><p>{-15}</p></div><p>{+20}</p></article></div><div id=footer><p>{-10}</p><p>{-30}</p></div>",
    "<article><h1>{+7}</h1><p>{+200}</p><h3>drop Related stories</h3><ol><li>{-6@}</li><li>{-5@}</li></ol><h3>{+4}</h3><p>{+3}</p></article><section class=comments><p>{-80}</p><p>{-70}</p></section>",
    "<article><h1>{+5}</h1><p>{+150}</p><p>{+4/4}</p><p>{+60}</p><p>{+2/2}</p><p>{+24}</p><p>{+130}</p><h4>drop More</h4><ul><li>{-2@}</li><li>{-1@}</li><li>{-3@}</li></ul></article><p>{-2@}</p>",
    "<article><h1>{+6}</h1><p>{+50}</p><h2>{+6}</h2><ul><li>{+2@}</li><li>{+1@}</li></ul><p>{+6}</p><ol><li>{+4@}</li><li>{+8@}</li></ol><p>{+5}</p><ul><li>{+6@}</li></ul><h3>{+2}</h3><ul><li>{+3@}</li></ul><p>{+1}</p><p>{+9@}</p></article>",
    "<main><h2>keep More about the matter</h2><p>{+1}</p><p>{+3}</p><p>{+2}</p><p>{+4}</p><p>{+6}</p><p>{+40}</p><p>{+5/1}</p><h4>keep More</h4><p>{+2}</p><p>{+7}</p><h3>drop Popular now</h3><p>{-4@}</p><h3>drop Follow us</h3><p>{-1@}</p></main>",
    "<article><p>{+2}</p></article>",
    "<article><p>{+1}</p><p>{+4}</p></article>",
    "<nav>{-2@}</nav><main><h2>{+3}</h2><p>{+3}</p><p>{+1}</p></main>",
    "<article><ul><li>{+4@}</li></ul><p>{+2}</p><ul><li>{+3@}</li></ul><p>{+1}</p><p>{+3}</p></article><p>{-1@}</p>",
    "<article><p>{+2/1}</p><p>{+1}</p></article><ul><li>{-2@}</li></ul>",
    "<main><h3>keep More words</h3><p>{+1}</p><p>{+3}</p></main>",
    # pages without such an element
    "<div><a href=x>{-1@}</a> {-1@} {-1@}</div><div id=content><h1>{+6}</h1><p>{+55}</p><p>{+80/4}</p><p>{+16}</p><p>{+70}</p></div><div>{-3@}</div><div>{-2@}</div>",
    "<ul><li>{-1@}</li><li>{-1@}</li><li>{-2@}</li></ul><p>{-5}</p><ul><li>{-3@}</li></ul><h2>{+4}</h2><p>{+90}</p><p>{+8}</p><p>{+40}</p><p>{+22}</p><div class=copyright>{-7}</div>",
    "<div class=menu>{-3@}</div><div class=page-wrapper><p>{+35/7}</p><p>{+20}</p><p>{+25}</p></div><div class=sidebar-inner><p>{-30}</p><p>{-12}</p></div><p>{-4@}</p><p>{-3}</p>",
    "<p>{-2@}</p><p>{-4}</p><p>{-3@}</p><div class=story><p>{+45}</p><p>{+30/3}</p><p>{+18}</p><p>{+60}</p></div><p>{-12/7}</p><p>{-8/8}</p><p>{-25/20}</p>",
    "<div class=cookie-notice><p>{-40}</p></div><div><p>{-4}</p><p>{-2}</p><p>{-3}</p></div><div><h1>{+9}</h1><p>{+150}</p><p>{+6}</p><p>{+38}</p></div><div class=comment-list><p>{-50}</p><p>{-2}</p></div>",
    "<p>{-1@}</p><p>{+110}</p><p>{-1@}</p><p>{-2@}</p><p>{+95}</p><p>{-3@}</p><p>{+140/6}</p><p>{-4@}</p><p>{-1}</p>",
    "<div class=menu><p>{-1@}</p></div><div class=post><h1>{+5}</h1><p>{+30}</p><p>{+9}</p><p>{+2}</p><p>{+45}</p><p>{+14}</p><p>{+1}</p><p>{+12}</p><p>{+60}</p><p>{+2}</p></div><div>{-2@}</div>",
    "<p>{-2@}</p><p>{-1@}</p><h1>{+4}</h1><p>{+25}</p><h2>{+2}</h2><p>{+33}</p><p>{+8}</p><h2>{+1}</h2><p>{+50/4}</p><p>{+7}</p><p>{-3@}</p><p>{-2}</p>",
    "<p>{-3}</p><p>{-5/5}</p><p>{+28}</p><p>{+13}</p><p>{+44}</p><p>{-5/5}</p><p>{-3/3}</p><p>{-6}</p><p>{-2/2}</p><table><tr><td>{-1}</td><td>{-2}</td></tr></table>",
)


#: Inside an article a label doesn't depend on the neighbours, so its blocks stand in the table again, beside those of so many blocks further on.
TURNS = (1, 2, 3, 5, 8, 13)


def sample_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``SAMPLES``, and of those of articles again among other neighbours."""

    def part(m: re.Match) -> str:
        words, linked = int(m[2]), int(m[2]) if m[4] else int(m[3] or 0)
        text = [("keep" if m[1] == "+" else "drop")] + ["word"] * (words - 1)
        return " ".join(text[: words - linked]) + (f" <a>{' '.join(text[words - linked :])}</a>" if linked else "")

    x, y = [], []
    for page in SAMPLES:
        found = blocks(re.sub(r"\{([+-])(\d+)(?:/(\d+))?(@)?\}", part, page))
        x += rows(found)
        y += [text.startswith("keep") for text, *_ in found]
    x, y = np.array(x, float), np.array(y, float)
    inside = (x[:, FEATURES.index("article")] > 0) & (x[:, FEATURES.index("further")] == 0)
    again = []
    for turn in TURNS:
        moved = x[inside].copy()
        moved[:, 2:DENSITIES] = np.roll(moved[:, 2:DENSITIES], turn, axis=0)
        again.append(moved)
    return np.vstack([x, *again]), np.concatenate([y, *[y[inside]] * len(TURNS)])


@dataclass(frozen=True)
class Node:
    """A split (feature at most ``cut``: left) or, without children, a decision."""

    keep: bool
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def decide(self, row) -> bool:
        node = self
        while node.left is not None:
            node = node.left if row[node.feature] <= node.cut else node.right
        return node.keep


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A decision tree by the largest drop of Gini impurity; ties go to the first feature and the smallest cut."""
    keep = bool(y.mean() >= 0.5)
    if not depth or y.min() == y.max():
        return Node(keep)
    best = (0.0, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            side = x[:, f] <= cut
            gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[side], y[~side]))
            gain = len(y) * 2 * y.mean() * (1 - y.mean()) - gini
            if gain > best[0] + 1e-12:
                best = (gain, f, float(cut))
    if best[1] < 0:
        return Node(keep)
    side = x[:, best[1]] <= best[2]
    return Node(keep, best[1], best[2], grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1))


@functools.cache
def trained() -> Node:
    return grow(*sample_blocks())


_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "title", "template")}
_NAME_PART = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def name_head(name: str, silent: frozenset[str] = LAYOUTS) -> str:
    """What a class or id says: its last part that says more than that something is held; nothing if its first part is ``silent``."""
    parts = [p.lower() for p in _NAME_PART.split(name) if p]
    if not parts or parts[0] in silent:
        return ""
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    return parts[-1]


def _evidence(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(tagged, named, wrapper): what an element says by its tag, role or hiding, by its class or id, and whether an article clears that."""
    tagged, named = tag in FURNITURE_TAGS, False
    wrapper = tag in WRAPPER_TAGS
    if not attributes or tag in ("html", "body", "main"):
        return tagged, False, wrapper
    said = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            known, silent = (ARTICLE_NAMES, TOPICS) if tag == "article" else (FURNITURE_NAMES, LAYOUTS)
            heads = [h for h in (name_head(part, silent) for part in value.split()) if h in known]
            named = named or bool(heads)
            said += [h in WRAPPER_NAMES for h in heads]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            tagged = True
            said.append(False)
        elif name == "role" and value.lower() in FURNITURE_ROLES:
            tagged = True
            said.append(value.lower() in WRAPPER_ROLES)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            tagged = True
            said.append(False)
    if tag in FURNITURE_TAGS:
        said.append(tag in WRAPPER_TAGS)
    return tagged, named, bool(said) and all(said)


@dataclass(frozen=True)
class Element:
    """An open element and what holds for all that it encloses."""

    tag: str
    tagged: bool = False
    named: bool = False
    article: bool = False
    unread: bool = False
    wrapped: bool = False  # all that is said of it, an article inside may clear


_OUTSIDE = Element("")


def announces(words: list[str]) -> bool:
    """Whether a heading of these words announces further reading."""
    return len(words) < 7 and any(w.strip(":.!?").lower() in FURTHER_WORDS for w in words)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool, bool]]:
    """(text, words, link words, tagged, named, article, heading, further) of every flat block that holds a word."""
    out: list[tuple[str, int, int, bool, bool, bool, bool, bool]] = []
    stack: list[Element] = []
    text: list[str] = []
    linked: list[str] = []
    link = heading = False
    breaks = 0
    further, level = False, 0  # under such a heading, and how deep the element is that holds it

    def flush() -> None:
        nonlocal breaks, further, level
        breaks = 0
        words = html.unescape("".join(text)).split()
        if words:
            e = stack[-1] if stack else _OUTSIDE
            if heading:
                further, level = announces(words), sum(x.tag not in HEADINGS for x in stack)
            elif len(stack) < level:
                further = False
            out.append((" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), e.tagged, e.named, e.article, heading, further))
        text.clear()
        linked.clear()

    def add(piece: str) -> None:
        nonlocal breaks
        if piece and not (stack and stack[-1].unread):
            if not piece.isspace():
                breaks = 0
            text.append(piece)
            if link:
                linked.append(piece)

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not close and tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCK_TAGS:
                flush()
            continue
        tagged, named, wrapper = (False, False, False) if close else _evidence(tag, attributes)
        if tag == "a":
            link = not close
        elif tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                text.append(" ")
        elif tag in BLOCK_TAGS or tag in UNREAD_TAGS or tagged or named or (close and any(tag == e.tag for e in stack)):
            if tag in BLOCK_TAGS:
                flush()
                heading = not close and tag in HEADINGS
            if tag in VOID_TAGS or tag == "p" and not tagged and not named and not close:
                while tag == "p" and stack and stack[-1].tag == "p":
                    stack.pop()
                continue
            if close:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            elif not attributes.endswith("/"):
                if tag in ("p", "li") and stack and stack[-1].tag == tag:  # these end the like element before them
                    stack.pop()
                up = stack[-1] if stack else _OUTSIDE
                clears = tag in ARTICLE_TAGS and not up.article and up.wrapped
                before = Element("", article=up.article, unread=up.unread) if clears else up
                wrapped = wrapper and (clears or not (up.tagged or up.named) or up.wrapped) if tagged or named else before.wrapped
                stack.append(Element(tag, before.tagged or tagged, before.named or named, before.article or tag in ARTICLE_TAGS, before.unread or tag in UNREAD_TAGS, wrapped))
    flush()
    return out


def rows(found: list[tuple[str, int, int, bool, bool, bool, bool, bool]]) -> list[tuple[float, ...]]:
    """The features of each block, in the order of ``FEATURES``."""
    density = [(n, k / n) for _, n, k, *_ in found]
    none = (0, 0.0)
    return [(*density[i], *(density[i - 1] if i else none), *(density[i + 1] if i + 1 < len(found) else none), *found[i][3:]) for i in range(len(found))]


def main_text(page: str | None) -> str:
    """The kept blocks of one page, one to a line."""
    found, tree = blocks(page or ""), trained()
    return "\n".join(block[0] for block, row in zip(found, rows(found), strict=True) if tree.decide(row))


def extract(pages: DataFrame, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Append ``text`` and ``n_chars`` to every page."""

    def make(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(x) for x in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    return append(pages, source, (T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())), make, keep)
