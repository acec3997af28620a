"""Main text of pages whose every block is labelled, and of the given pages by a plain second extractor."""

import random
from html.parser import HTMLParser

import pytest

from loomstone.llm import html_blocks

STORY = "<h1>Title of it</h1><p>" + "plain words of the story here " * 4 + "</p>"
TOLD = "Title of it\n" + ("plain words of the story here " * 4).strip()


@pytest.mark.parametrize(
    "page",
    [
        f'<article>{STORY}</article><section class="comments"><article class="comment"><p>nice post indeed my dear friend</p></article></section>',
        f'<article>{STORY}<section class="comments"><article><p>nice post indeed my dear friend</p></article></section></article>',
        f'<article>{STORY}<article class="comment even depth-1"><p>nice post indeed my dear friend</p></article></article>',
        f"<article>{STORY}</article><aside><article><h2>Teaser</h2><p>read this other story of ours today</p></article></aside>",
        f"<article>{STORY}<aside><article><p>read this other story of ours today</p></article></aside></article>",
        f"<main>{STORY}<article class=teaser><p>read this other story of ours today</p></article></main>",
        f"<main>{STORY}</main><footer><article><p>all about us and our address here</p></article></footer>",
        f'<form action="/"><header><main>{STORY}<form><article><p>your message to us goes in here</p></article></form></main></header></form>',
        f'<div class="elementor-widget"><article id="post-7" class="hentry tag-advertising category-comments">{STORY}</article></div>',
        f"<div hidden><article><p>nothing to be seen in this one here</p></article></div><main>{STORY}</main>",
    ],
)
def test_only_the_story(page):
    assert html_blocks.main_text(page) == TOLD


def labelled(rng):
    """(page, its main text): a random page whose every block says by its words whether it is main text."""
    n = [0]
    told = []

    def text(keep, k=None):
        n[0] += 1
        words = [f"{'keep' if keep else 'drop'}{n[0]}", *(rng.choice(["some", "word", "and", "bread&amp;", "caf&eacute;"]) for _ in range((k or rng.randint(1, 40)) - 1))]
        if keep:
            told.append(" ".join(words).replace("&amp;", "&").replace("&eacute;", "é"))
        return rng.choice([" ", "\n", "  "]).join(words)

    links = lambda keep: "<ul>" + "".join(f"<li><a href=/x>{text(keep, rng.randint(1, 5))}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul>"

    def furniture(depth=0):
        inner = lambda: furniture(depth + 1) if depth < 2 and rng.random() < 0.3 else rng.choice([f"<p>{text(False)}</p>", links(False), f"<article><p>{text(False)}</p></article>", f"<h3>{text(False, 3)}</h3>"])
        tag, names = rng.choice([("nav", ""), ("aside", ""), ("footer", ""), ("div", ' class="user-comments"'), ("section", " id=comments"), ("div", ' class="x ad-slot"'), ("div", " role=navigation"), ("ul", ' class="share-links"'), ("div", ' class="cookie-notice"'), ("div", ' style="display:none"'), ("div", ' class="related"'), ("article", ' class="comment"')])
        return f"<{tag}{names}>{''.join(inner() for _ in range(rng.randint(1, 3)))}</{tag}>"

    def story(depth=0):
        kind = rng.random()
        if kind < 0.2:
            return furniture()
        if kind < 0.3:
            return f"<h2>{text(True, 4)}</h2>{links(True)}"
        if kind < 0.4 and depth < 2:
            return f"<section>{''.join(story(depth + 1) for _ in range(3))}</section>"
        if kind < 0.5:
            return f"<table><tr><td>{text(True, 1)}</td><td>{text(True, 2)}</td></tr></table>"
        if kind < 0.6:
            return f"<script>drop('<p>')</script><!-- drop <p>x</p> --><blockquote>{text(True)}</blockquote><form><p>{text(False)}</p></form>"
        return f"<p>{text(True)}</p>"

    around = [furniture() for _ in range(rng.randint(0, 3))]
    wrap = rng.choice(["", "form", "header", "div class='page-widget'"])
    tag = rng.choice(["article", "main", "article class='post'"])
    body = f"<{tag}>{''.join(story() for _ in range(rng.randint(1, 9)))}</{tag.split()[0]}>"
    page = "".join(around) + (f"<{wrap}>{body}</{wrap.split()[0]}>" if wrap else body) + "".join(furniture() for _ in range(rng.randint(0, 3)))
    return f"<html><head><title>drop</title></head><body>{page}</body></html>", "\n".join(told)


def test_labelled_pages():
    rng = random.Random(11)
    for _ in range(400):
        page, told = labelled(rng)
        assert html_blocks.main_text(page) == told, page


class Plain(HTMLParser):
    """The text of the article's blocks, by Python's own parser: nothing of menus, asides, adverts, comments, forms and footers."""

    BLOCKS = html_blocks.BLOCK_TAGS

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.lines = [], [], []

    def flush(self):
        words = "".join(self.text).split()
        self.text = []
        if words:
            self.lines.append(" ".join(words))

    def handle_starttag(self, tag, attributes):
        a = dict(attributes)
        if tag in self.BLOCKS:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag not in html_blocks.VOID_TAGS and tag != "p":
            names = f"{a.get('class') or ''} {a.get('id') or ''}".split()
            self.open.append((tag, tag in ("nav", "aside", "footer", "form", "script", "style") or any(x in ("ad", "comments", "sidebar", "menu", "related") for x in names)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open):
            self.text.append(data)


def test_given_pages_by_a_second_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.flush()
        assert html_blocks.main_text(r.html) == "\n".join(plain.lines), r.page_id


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "<article><p>a b</p></article>", "t", 9, True)], "page_id long, html string, text string, n_chars int, further boolean")
    assert html_blocks.extract(rows.where("false")).collect() == []
    r = html_blocks.extract(rows).collect()[0]
    assert (r.page_id, r.further, r.text, r.n_chars) == (1, True, "a b", 3)
