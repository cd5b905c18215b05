"""What an element's attributes leave out, and what they must not."""

from cutloom.llm import html_extract

WORDS = "Plain words of an article that goes on for a while, so that they are its core. " * 3


def text(attributes):
    return html_extract.main_text(f"<body><div {attributes}><p>{WORDS}</p><p>{WORDS}</p></div></body>")


def test_values_are_not_names():
    for attributes in ('style="overflow:hidden"', 'title="The hidden valley"', "title='x role=banner'", 'data-hidden="false"', 'data-id="comments"', 'class="side-by-side"', 'class="has-sidebar"', 'class="search-results"', "href=a/hidden", 'x = "class=ad"'):
        assert WORDS.strip() in text(attributes), attributes


def test_names_leave_out():
    """Beside an article; alone on a page, only what is hidden goes, for a hint lowers a density and removes nothing."""
    for attributes in ("hidden", 'x="a" HIDDEN', "hidden=hidden", "aria-hidden = 'true'", 'role="banner"', 'class="ad"', "class='box ad-top'", "id=comments", 'class="x side"', "class=footerSite", 'title="a"id="nav"'):
        page = f"<body><div><p>{WORDS}</p><p>{WORDS}</p><div {attributes}>Short words</div><p>{WORDS}</p></div><div {attributes}><p>{WORDS}</p></div></body>"
        assert html_extract.main_text(page) == "\n\n".join([WORDS.strip()] * 3), attributes
        assert (text(attributes) == "") == ("hidden" in attributes.lower().replace("aria-hidden", "")), attributes
