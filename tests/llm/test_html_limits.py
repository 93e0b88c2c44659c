"""Main text of pages that are broken, deeply nested, or in other languages."""

from __future__ import annotations

import random
import time

import pytest

from farelens.llm.html_text import main_text

ENGLISH = "This is what was said of the house and of the man that had been there for all of the time that was given to him in it."
RUSSIAN = "Это длинный абзац русского текста, который рассказывает о доме и о человеке, который жил в нём много лет назад и помнит его."
CHINESE = "这是一个很长的中文段落，讲述了一个人和他的房子的故事，他在那里住了很多年，现在仍然记得那些日子和所有发生过的事情。"
CODE = "for i in range(10): total[i] = price[i] * count[i] ; print(total[i]) ; log(i) ; check(total, price, count) ; done[i] = 1"
MENU = '<div><a href="x">Меню</a> <a href="y">Home</a></div>'
NOTICE = '<div class="cookie-notice"><p>We use cookies to make the site better for you and for all of the others that are here.</p></div>'


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, CODE, ENGLISH])
def test_every_language_keeps_its_text(text):
    page = f"{MENU}<div><h1>1</h1><p>{text}</p><p>{text} 2</p><p>{text} 3</p></div>{MENU}{NOTICE}"
    assert main_text(page).removeprefix("1 ") == f"{text} {text} 2 {text} 3"
    assert main_text(f"<article><h1>1</h1><p>{text}</p></article>{MENU}{NOTICE}") == f"1 {text}"
    assert main_text(f"<pre>{text}</pre>") == text


def test_a_page_of_short_blocks_keeps_them():
    assert main_text(f"{MENU}<p>One line.</p><p>Two.</p><footer>Three.</footer>") == "One line. Two."


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 330_000,
        "<a '" * 250_000,
        '<a "' * 100_000 + ">" * 1000,
        "<div class=sidebar><p>x</p>" * 10_000,
        "<div class=sidebar>" * 10_000 + "<article>" * 3000,
        "<b>" * 100_000 + "</i>" * 100_000,
        "<" * 1_000_000,
        "<!" * 400_000,
        "&" * 1_000_000,
    ],
)
def test_time_follows_the_length(page):
    main_text(page[: len(page) // 10])
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 5


def test_broken_markup():
    assert main_text(f"<p>{ENGLISH}</p><p>5 < 6 and 7 > 6") .startswith(ENGLISH)
    assert main_text(f'<p title="a > b">{ENGLISH}</p>') == ENGLISH
    assert main_text(f'<p>{ENGLISH}</p><a href="never ended><b>{ENGLISH}</b>').count(ENGLISH) == 2
    assert main_text(f"</x></div></p><p>{ENGLISH}") == ENGLISH
    rng = random.Random(4)
    bits = ["<", ">", "<p>", "</p>", '"', "'", "<div class='menu'>", "</div>", "<!--", "-->", "<![CDATA[", "]]>", "<script>", ENGLISH, "&lt;", "\x00"]
    for _ in range(300):
        assert isinstance(main_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))), str)
