"""Main text: time on hard pages, and what stays in an article."""

import time

import pytest

from jetforge.llm import extract

HARD = {"cells": "<td>word ", "inline in cells": "<td><b>word ", "articles": "<article>w ", "wrapped": "<div class=ad><main>w ", "closing tags of nothing": "<div></x>",
        "terms": "<dt>a<dd>b ", "quotation marks": "<a '\"x ", "one quotation mark": "<b '", "headers": "<article><header><p>x ", "angles": "<<", "inline": "<i><b>x "}


@pytest.mark.parametrize("name", sorted(HARD))
def test_time_follows_length(name):
    def seconds(n):
        start = time.perf_counter()
        extract.main_text(HARD[name] * (n // len(HARD[name])), {})
        return time.perf_counter() - start

    small, large = seconds(100_000), seconds(1_000_000)
    assert large < 60 and large < 40 * small + 2


WORDS = " ".join(["word"] * 30)


@pytest.mark.parametrize("part, text", [
    ("<header><h1>The title</h1><p>By A</p></header>", "The title\nBy A"),
    ("<h2 class='section-header'>Methods</h2>", "Methods"),
    ("<p class='share-price'>It rose</p>", "It rose"),
    ("<div class='related-work'><p>Others did</p></div>", "Others did"),
    ("<figure><img src=x><figcaption>What it shows</figcaption></figure>", "What it shows"),
    ("<ul>" + "<li>item</li>" * 60 + "</ul>", "\n".join(["item"] * 60)),
    ("<table>" + "<tr><td>a</td><td>b</td></tr>" * 60 + "</table>", "\n".join(["a", "b"] * 60)),
    ("<table>" + "<tr><td>a<td>b" * 3 + "</table>", "\n".join(["a", "b"] * 3)),
    ("<dl><dt>term<dd>what it is<dt>next<dd>more</dl>", "term\nwhat it is\nnext\nmore"),
    ("<p title='never closed>still here</p>", None),
    ("<header><nav>away</nav></header>", ""),
    ("<div class='related-posts'>Read more</div><div class='share buttons'>Share</div><aside>No</aside><p class='advert'>Buy</p><footer>Tags</footer>", ""),
    ("<section id='comments'><p>a reader says</p></section>", ""),
])
def test_article_stays_whole(part, text):
    page = f"<body><nav>Home</nav><article><p>{WORDS}</p>{part}<p>{WORDS}</p></article><footer>{WORDS}</footer></body>"
    got = extract.main_text(page, {})
    if text is None:
        assert "still here" in got
    else:
        assert got == "\n".join(x for x in (WORDS, text, WORDS) if x)


def test_list_in_a_text_without_an_article_element():
    page = f"<body><div><p>{WORDS}</p><ul>{'<li>item</li>' * 60}</ul><p>{WORDS}</p></div></body>"
    assert extract.main_text(page, {}) == "\n".join([WORDS, *["item"] * 60, WORDS])
