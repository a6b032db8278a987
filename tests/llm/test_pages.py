"""Extraction from whole pages, broken ones among them, against texts written by hand."""

import itertools
import time

import numpy as np
import pytest

from platen.llm import html_text
from platen.llm.pages_labelled import labelled_pages

T = "<html><head><title>T</title></head><body>"
L = "The council met on Tuesday to talk about the river and the new market hall near it. It decided nothing."

#: What a page is about, the page, its text.
PAGES = [
    ("no end of the head", "<html><head><title>T</title><meta charset=utf-8><body><nav><a href=/>Home</a></nav><article><h1>One</h1><p>" + L + "</p></article><footer>&copy; x</footer>", "One\n" + L),
    ("neither head nor body", "<title>T</title><nav><a href=/>Home</a></nav><article><h1>One</h1><p>" + L + "</article>", "One\n" + L),
    ("a drawing without end", T + "<article><h1>One</h1><svg><path d=x><p>" + L + "</p><p>Two two.</p></article>", "One\n" + L + "\nTwo two."),
    ("a formula without end", T + "<article><h1>One</h1><math><mi>x<p>" + L + "</p></article>", "One\nx\n" + L),
    ("a whole page in noscript without end", T + "<noscript><article><h1>One</h1><p>" + L + "</p></article>", "One\n" + L),
    ("noscript with and without end", T + "<noscript><p>Enable scripts</p></noscript><article><h1>One</h1><noscript><p>" + L + "</p></article>", "One\n" + L),
    ("buttons and choices in an article", T + "<article><h1>One</h1><p>" + L + " <button>Share</button></p><select><option>a<option>b</select><p>Two two.</p></article>", "One\n" + L + "\nTwo two."),
    ("a button without end", T + "<article><h1>One</h1><p>" + L + "</p><button>Share<p>Two two.</p></article>", "One\n" + L + "\nTwo two."),
    ("asides and comments in an article", T + "<article><h1>One</h1><p>" + L + "</p><aside><h3>Also</h3><p>" + L + "</p></aside><p>Two two.</p><div class=comments><p>I think that this is right and good.</p><p>" + L + "</p></div></article>", "One\n" + L + "\nTwo two."),
    ("no article element", T + "<div class=header>Site</div><div class=sidebar><h3>More</h3><p>" + L + "</p></div><div class=post><h1>One</h1><p>" + L + "</p></div><div class=footer>c</div>", "One\n" + L),
    ("names in parts", T + "<div id=sidebar-left><p>" + L + "</p></div><div><h1>One</h1><p>" + L + "</p><p>" + L + "</p></div><div id=comments-area><p>" + L + "</p></div>", "One\n" + L + "\n" + L),
    ("a form around everything", T + "<form id=aspnetForm><div class=content><h1>One</h1><p>" + L + "</p></div></form>", "One\n" + L),
    ("a form in an article", T + "<article><h1>One</h1><p>" + L + "</p><form><p>Write to us and we will answer.</p><input></form></article>", "One\n" + L),
    ("cells and rows without ends", T + "<article><h1>One</h1><table><tr><td>aa bb<td>cc dd<tr><td>ee ff</table><p>" + L + "</article>", "One\naa bb\ncc dd\nee ff\n" + L),
    ("comments as articles", T + "<article><h1>One</h1><p>" + L + "</p></article><section class=comments><article><h4>Bob</h4><p>" + L + "</p></article></section>", "One\n" + L),
    ("a name that tells nothing", T + "<div class=has-sidebar><article><h1>One</h1><p>" + L + "</p></article><aside>" + L + "</aside></div>", "One\n" + L),
    ("a notice", T + "<div class='cookie-notice'>We use cookies to make this site work. Read more in our privacy terms.</div><main><h1>One</h1><p>" + L + "</p></main>", "One\n" + L),
    ("a title without end", "<html><head><title>T<body><article><h1>One</h1><p>" + L + "</p></article>", "One\n" + L),
    ("an article and a footer only", "<body><article><p>" + L + "</p><p>Two two.</p></article><footer>(c) me</footer>", L + "\nTwo two."),
    ("three paragraphs and a footer", "<body><article><p>" + L + "</p><p>Two two.</p><p>" + L + "</p></article><footer>(c) me</footer>", L + "\nTwo two.\n" + L),
    ("one paragraph", "<p>" + L + "</p>", L),
    ("plain text", L, L),
    ("two paragraphs alone", "<body><article><p>" + L + "</p><p>Two two.</p></article>", L + "\nTwo two."),
    ("one paragraph in a body", T + "<p>" + L + "</p></body></html>", L),
    ("main with nothing around", T + "<main><p>" + L + "</p></main>", L),
    ("a dialog behind", T + "<article><p>" + L + "</p><p>" + L + "</p></article><dialog open><p>We use cookies on this site.</p></dialog>", L + "\n" + L),
    ("a dialog within", T + "<article><h1>One</h1><p>" + L + "</p><dialog open><p>We use cookies on this site.</p></dialog><p>Two two.</p></article>", "One\n" + L + "\nTwo two."),
    ("a notice within", T + "<article><h1>One</h1><p>" + L + "</p><p class=notice>Please turn off your blocker.</p><p>Two two.</p></article>", "One\n" + L + "\nTwo two."),
    ("contents within", T + "<article><h1>One</h1><div class=toc><ul><li><a href=#a>First part</a></li><li><a href=#b>Second part</a></li></ul></div><p>" + L + "</p></article>", "One\n" + L),
    ("readers' remarks by another name", T + "<article><h1>One</h1><p>" + L + "</p></article><div class=user-feedback><ul><li>I think so, too.</li><li>" + L + "</li></ul></div>", "One\n" + L),
    ("remarks as articles, no header", T + "<article><p>" + L + "</p></article><section id=reader-comments><article><p>" + L + "</p></article></section>", L),
    ("a comment that nothing ends", T + "<article><p>" + L + "</p><!-- <p>Two two.</p></article>", L + "\nTwo two."),
    ("a page that breaks off in a tag", T + "<article><p>" + L + "</p><p>Two < two.</p><div class='x", L + "\nTwo < two."),
    ("no names at all", T + "<h1>One</h1><p>" + L + "</p><p>" + L + "</p>", "One\n" + L + "\n" + L),
]


@pytest.fixture(scope="module")
def field():
    return html_text.fitted()


@pytest.mark.parametrize(("page", "text"), [p[1:] for p in PAGES], ids=[p[0] for p in PAGES])
def test_text_of_a_page(field, page, text):
    assert "\n".join(html_text.main_blocks(page, field)) == text


@pytest.mark.parametrize("piece", ["<div>x", "<!--", "<script", "<script>", "<b>x", "<p><b>x", "<textarea>", "<svg><g>", "<hr></i>", "<li><ul>", "<select><option>", "<a href=x", "</span>x", "<head><body>"])
def test_broken_pages_take_time_in_proportion(field, piece):
    def seconds(size):
        page = piece * (size // len(piece))
        began = time.process_time()
        html_text.main_blocks(page, field)
        return time.process_time() - began

    seconds(50_000)
    small, large = seconds(200_000), seconds(1_600_000)
    assert large < 40 and large < 20 * max(small, 0.1)  # eight times the page


def test_weights_are_kept():
    assert html_text.fitted() is html_text.fitted()


def test_long_blocks_are_read_whole(field):
    long = " ".join([L] * 40)
    page = T + "<article><h1>One</h1><p>" + long + "</p><div class=advert>" + long + "</div></article>"
    assert "\n".join(html_text.main_blocks(page, field)) == "One\n" + long


def test_training_climbs_to_the_top_by_enumeration():
    """At the end of training no weight's slope of the penalised likelihood, taken over all labellings, is left."""
    pages = [p for p in labelled_pages(60, seed=3) if len(html_text.leaves(p)) <= 9][:4]
    assert len(pages) >= 3
    field = html_text.train(pages, rounds=3000)
    data = [(html_text.features(b), [int(any(m for _, _, m in x.path)) for x in b]) for b in map(html_text.leaves, pages)]

    def value(weights, steps):
        total = -0.5 * (sum(w * w for w in weights.values()) + sum(s * s for row in steps for s in row))
        for rows, truth in data:
            score = lambda y, rows=rows: sum(steps[a][b] for a, b in zip(y, y[1:], strict=False)) + sum(sum(weights[f] for f in row) for row, v in zip(rows, y, strict=True) if v)
            every = [score(y) for y in itertools.product((0, 1), repeat=len(rows))]
            total += score(truth) - np.logaddexp.reduce(every)
        return total

    def slope(change):
        up, down = (value(*change(e)) for e in (1e-4, -1e-4))
        return (up - down) / 2e-4

    for f in sorted(field.weights)[::9]:
        assert abs(slope(lambda e, f=f: (field.weights | {f: field.weights[f] + e}, field.steps))) < 1e-2
    for a, b in itertools.product((0, 1), repeat=2):
        assert abs(slope(lambda e, a=a, b=b: (field.weights, [[s + e * ((i, j) == (a, b)) for j, s in enumerate(row)] for i, row in enumerate(field.steps)]))) < 1e-2
