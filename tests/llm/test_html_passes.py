"""Second pass of HTML extraction against a plain search, linear cost, pages without a decided block."""

import random
import time

import pytest

from lectern.llm import html_text
from lectern.llm.html_text import Block


def plainly(found, labels):
    """The nearest decided block of the same box, sought from every block on its own."""
    only = not any(labels) and not any(b.inside and x is None for b, x in zip(found, labels, strict=True))
    out = []
    for i, b in enumerate(found):
        if labels[i] is not None:
            out.append(labels[i])
            continue
        near = [(abs(j - i), (j < i) == b.heading, labels[j]) for j, o in enumerate(found) if labels[j] is not None and o.box == b.box and not o.boiler]
        out.append(True if only else min(near)[2] if near else b.inside)
    return out


def test_second_pass_equals_a_plain_search():
    rng = random.Random(9)
    prose = "the ferry of the town and the river was in that for it as with be by on not he his but at are this have from"
    for _ in range(400):
        found = []
        for _ in range(rng.randrange(1, 25)):
            text = rng.choice([prose, "short words", "Xyl Qop Brn " * 9, "menu"])
            linked = len(text) if rng.random() < 0.2 else 0
            found.append(Block(text, linked, rng.random() < 0.2, rng.random() < 0.3, rng.randrange(3), rng.random() < 0.3))
        html_text.decide(found)
        got = [b.good for b in found]
        labels = []
        for b in found:  # the first pass alone, on a page of its own with a decided block of another box
            one = Block(b.text, b.linked, b.boiler, b.inside, 1, b.heading)
            other = Block(prose, 0, False, False, 2, False)
            html_text.decide([one, other])
            first = one.good
            undecided = not b.boiler and b.linked <= html_text.LINKED * len(b.text) and b.text != prose and not (len(b.text) >= html_text.LONG)
            labels.append(None if undecided else first)
        assert got == plainly(found, labels)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><h1>Title</h1><p>Hello world, this is short.</p><p>Second short one.</p></body>", "Title Hello world, this is short. Second short one."),
        ('<nav><a href="/">Home</a></nav><p><a href="/x">Start here</a></p><p>Only this.</p><footer>Imprint</footer>', "Only this."),
        ("<article><p>A short one.</p><div class='content-related'><p>Other stories</p></div><div class='post-share'>Tell friends</div></article>", "A short one."),
        ("<article><div class='article-header'><h1>Head</h1></div><p>Words.</p><div class='entry-footer newsletter'>Sign up</div></article>", "Head Words."),
        ("<p>one</p><svg><text>no</text></svg><p>two</p><video><p>three</p>", "one two three"),
        ("<p>one</p><!-- left open <p>two</p>", "one"),
        ("<SCRIPT>x</script ><p>one</p><style>never closed <p>two</p>", "one"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<p>a b</p>" * 40_000, "<video>" * 40_000 + "<p>x</p>", "<svg><p>y</p>" * 20_000, "<!--" * 20_000])
def test_long_pages_cost_in_proportion(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 5
