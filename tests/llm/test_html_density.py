"""Composite density against its definition, hints that mislead, and what density decides."""

import math
import random

import pytest

from cutloom.llm import html_extract as H

PARAGRAPH = "<p>Paragraph number {} has a good number of words in it, so that it counts as text of the page.</p>"
BODY = "<h1>Title here</h1>" + "".join(PARAGRAPH.format(i) for i in range(6))
WANT = "\n\n".join(["Title here"] + [PARAGRAPH.format(i)[3:-4] for i in range(6)])


@pytest.mark.parametrize("start, end", [
    ('<div class="content no-sidebar">', "</div>"), ('<div class="post ad-free">', "</div>"), ('<div class="entry-content side-by-side">', "</div>"),
    ('<div class="article comment-enabled">', "</div>"), ("<form>", "</form>"), ('<div id="search"><div class="menu">', "</div></div>"), ("<footer>", "</footer>"),
])
def test_hints_do_not_remove_an_article(start, end):
    page = f"<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav>{start}{BODY}{end}<footer>&copy; all rights reserved by us</footer></body></html>"
    assert H.main_text(page) == WANT


def test_density_alone_finds_the_article():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Place {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"<body><div>{links}</div><div><div>{BODY}</div></div><div>{links}</div></body>"
    assert H.main_text(page) == WANT


def test_short_text_between_paragraphs_stays():
    page = f"<body><div>{BODY}<p>Is.</p>{BODY}<p>End.</p></div></body>"
    assert H.main_text(page) == f"{WANT}\n\nIs.\n\n{WANT}\n\nEnd."


def test_without_density_everything_stays(monkeypatch):
    page = f"<body><nav><a href=x>Home</a></nav><article>{BODY}<div class=ad>Buy this</div></article><footer>us</footer></body>"
    assert H.main_text(page) == WANT

    def off(order):
        H.measure(order)
        return order[0][0], 0.0

    monkeypatch.setattr(H, "core_of", off)
    assert H.main_text(page) == f"Home\n\n{WANT}\n\nBuy this\n\nus"


def twin(root):
    """Densities and sums straight from the definition, element by element."""

    def walk(node, link, weight):
        """(weighted characters, those in links, weighted tags, link tags, characters) of a subtree, its own hint left out."""
        link = link or node.tag == "a"
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        found = [weight * own, weight * own * link, weight * (node.tag != "br"), weight * (node.tag == "a"), own]
        for x in node.items:
            if not isinstance(x, str):
                found = [a + b for a, b in zip(found, walk(x, link, weight * x.hint), strict=True)]
        return found

    def density(c, lc, t, lt, share):
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        ratio = max(c, 1) / max(lc, 1) * max(t, 1) / max(lt, 1)
        return c / max(t, 1) * (math.log(ratio) / math.log(base) if base > 1 + 1e-9 else math.log(ratio + 1))

    def inside(node):
        while node is not None and node.tag != "a":
            node = node.parent
        return node is not None

    def factor(node):
        return min(node.hint, factor(node.parent) if node.parent is not None else 1)

    c, lc, *_ = walk(root, False, 1.0)
    share, out = lc / max(c, 1), {}
    for node, _ in H._in_order(root):
        *four, written = walk(node, node.parent is not None and inside(node.parent), 1.0)
        out[node] = factor(node) * four[0] / max(written, 1) * density(*four, share)
    return out


def test_densities_equal_their_definition():
    rng = random.Random(4)
    tags = ["div", "p", "a", "b", "ul", "li", "nav", "article", 'div class="ad"', "section", "br"]
    for _ in range(200):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags).split()[0]}>", "some words here ", "x", "A longer run of text that is not in a link. "]) for _ in range(rng.randint(1, 60)))
        root = H.tree(page)
        order = H._in_order(root)
        H.measure(order)
        want = twin(root)
        for node, _ in order:
            assert node.density == pytest.approx(want[node], rel=1e-9, abs=1e-12)
        top = max((n for n, _ in order), key=lambda n: n.sum)
        core, low = H.core_of(order)
        assert core is top and low <= core.density and core.factor == 1
