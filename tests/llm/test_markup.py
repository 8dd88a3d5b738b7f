"""Tags and attributes against a slow tokeniser, character by character; stray quotes and names inside articles."""

import random

import pytest

from platewright.llm import html_extract


def attributes_by_hand(s, i):
    """Attributes from place i on and the place behind the tag's end, None if it never ends."""
    out, n = [], len(s)
    while True:
        while i < n and (s[i].isspace() or s[i] == "/"):
            i += 1
        if i >= n:
            return None
        if s[i] == ">":
            return out, i + 1
        start = i
        if s[i] == "=":
            i += 1
        while i < n and not s[i].isspace() and s[i] not in "/>=":
            i += 1
        name, value, j = s[start:i], "", i
        if name == "=":
            continue
        while j < n and s[j].isspace():
            j += 1
        if j < n and s[j] == "=":
            j += 1
            while j < n and s[j].isspace():
                j += 1
            if j < n and s[j] in "\"'" and s.find(s[j], j + 1) >= 0:
                end = s.find(s[j], j + 1)
                value, i = s[j + 1 : end], end + 1
            else:
                k = j
                while k < n and not s[k].isspace() and s[k] != ">":
                    k += 1
                value, i = s[j:k], k
        out.append((name, value))


def tokens_by_hand(s):
    out, i, text = [], 0, ""
    while i < len(s):
        tag = None
        if s.startswith("<!--", i):
            end = s.find("-->", i + 4)
            tag, i = "", len(s) if end < 0 else end + 3
        elif s[i] == "<" and i + 1 < len(s) and s[i + 1] in "!?":
            end = s.find(">", i + 2)
            tag, i = "", len(s) if end < 0 else end + 1
        elif s[i] == "<":
            j = i + 1 + (s[i + 1 : i + 2] == "/")
            if j < len(s) and s[j].isascii() and s[j].isalpha():
                k = j
                while k < len(s) and not s[k].isspace() and s[k] not in "/>":
                    k += 1
                if (found := attributes_by_hand(s, k)) is not None:
                    tag, i = (j > i + 1, s[j:k], found[0]), found[1]
        if tag is None:
            text += s[i]
            i += 1
        elif tag:
            out += [text, tag]
            text = ""
        else:
            out.append(text)
            text = ""
    return [x for x in [*out, text] if x]


def tokens(s):
    out, at = [], 0
    while m := html_extract.MARKUP.search(s, at):
        out.append(s[at : m.start()])
        at = m.end()
        if m["tag"]:
            out.append((bool(m["close"]), m["tag"], [(k, a or b or c) for k, a, b, c in html_extract.ATTRIBUTE.findall(m["rest"])]))
    return [x for x in [*out, s[at:]] if x]


def test_markup_against_slow_tokeniser():
    rng = random.Random(5)
    parts = ["<", ">", "/", "=", '"', "'", " ", "\n", "a", "b", "<p", "</p>", "<a href=", "<!--", "-->", "--", "!", "?", "class", "x y", "="]
    for _ in range(20000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 16)))
        assert tokens(s) == tokens_by_hand(s), s


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=Bob's>one</p><p>two</p><p>three isn't", "one\ntwo\nthree isn't"),
        ('<p>first</p><img alt=5" src=x><p>second</p>', "first\nsecond"),
        ('<p>first</p><img alt="5 src=x><p>second</p>', "first\nsecond"),
        ("<p>a &lt; b <b and no end", "a < b <b and no end"),
        ("<article><h1>t</h1><div class=share-price>12 a share</div><p>x</p></article>", "t\n12 a share\nx"),
        ("<article><p>x</p><div class='related-work'>older papers</div><div class='share-buttons'>send</div><div class=comments>me too</div></article>", "x\nolder papers"),
        ("<article><p>x</p><section id='notice-of-award'>won</section><div class='promo-code-history'>codes</div><div class='ad-slot'>buy</div></article>", "x\nwon\ncodes"),
    ],
)
def test_stray_quotes_and_names(page, text):
    assert html_extract.main_text(page, set()) == text


def test_long_page(spark):
    page = "<article>" + "<p class='a'>some words of a long page</p>" * 200_000 + "</article>"
    (r,) = html_extract.extract(spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")).collect()
    assert r.text == "\n".join(["some words of a long page"] * 200_000)
