"""Names in class and id drop what they name, and never the page's text."""

import pytest

from trackloom.llm.htmltext import extract

LONG = "Words of the article that run on for a while, with commas, and end at last."


@pytest.mark.parametrize("name", ["content with-sidebar", "layout has-sidebar", "no-comments", "post-header-wrap", "main-widget", "tags-page", "sidebar", "widget"])
@pytest.mark.parametrize("inner", ["<article><p>{0}</p><p>{0}</p></article>", "<p>{0}</p><p>{0}</p>"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_text_stays_whatever_its_name(name, inner, attribute):
    page = f"<body><div class='ad'><p>Buy now.</p></div><div {attribute}='{name}'>{inner.format(LONG)}</div><footer>us</footer></body>"
    assert extract(page) == f"{LONG}\n\n{LONG}"


def test_named_parts_beside_the_text_go():
    page = f"<body><div class='content with-sidebar'><p>{LONG}</p><p>{LONG}</p><div class='box sidebar'><p>Side {LONG}</p></div></div></body>"
    assert extract(page) == f"{LONG}\n\n{LONG}"


KEPT = ["<div class='elementor-widget-container'>{0}</div>", "<div data-id='menu-3'>{0}</div>", "<div data-role='navigation' data-hidden='x'>{0}</div>", "<div title='a hidden gem'>{0}</div>", "<div class='legal-news'>{0}</div>",
        "<div class='post-sharing-economy'>{0}</div>", "<div id='notice-board'>{0}</div>", "<div class='entry-header-content'>{0}</div>", "<div id='share-prices'>{0}</div>", "<div data-style='display:none' id=x>{0}</div>"]


@pytest.mark.parametrize("shape", KEPT)
def test_values_and_parts_of_names_drop_nothing(shape):
    text = "Words of the article that run on for a while, with commas, and end at last."
    more = "<p>The rest of it stands beside, and is longer than the part in question, by some words or other.</p>"
    assert extract(f"<body><div>{shape.format(f'<p>{text}</p>')}{more}</div><div class='ad'>Buy now.</div></body>").startswith(text)


def test_repeated_attributes_and_odd_ones():
    text = "Words of the article that run on for a while, with commas, and end at last."
    assert extract(f"<div class='story' class='ad'><p>{text}</p></div>") == text
    assert extract(f"<div hidden><p>{text}</p></div><div = 'x' id><p>{text}</p></div>") == text


def text_of_article(page):
    """By the standard library's parser: all text of the article element, block by block."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        blocks, inside, skip = [], 0, 0

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside += 1
            if tag in ("script", "style"):
                self.skip += 1
            if tag == "br" and self.blocks:
                self.blocks[-1] += " "
            if tag in ("article", "p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "blockquote", "section", "pre", "figure"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside -= 1
            if tag in ("script", "style"):
                self.skip -= 1
            if tag in ("article", "p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "blockquote", "section", "pre", "figure"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.blocks = self.blocks or [""]
                self.blocks[-1] += data

    reader = Reader(convert_charrefs=True)
    reader.blocks = []
    reader.feed(page)
    reader.close()
    return "\n\n".join(t for b in reader.blocks if (t := " ".join(b.split())))


def test_pages_against_another_parser():
    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist() if x and "<article" in x]
    same, found, all_words = 0, 0, 0
    for page in pages:
        want, got = text_of_article(page), extract(page)
        same += got == want
        words = set(want.split())
        found, all_words = found + len(words & set(got.split())), all_words + len(words)
    assert len(pages) >= 200 and found >= 0.99 * all_words and same >= 0.9 * len(pages)
