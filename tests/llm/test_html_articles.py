"""Pages on which articles are not the main text, or hold more than it."""

import numpy as np
import pytest

from bytelens.llm.html import LABELLED, classify, grow, main_text

TREE = grow(np.array(LABELLED, float))
TEXT = ["the river rose slowly through the long wet spring and the old mill stood empty for the first time in forty years " * 2 for _ in range(3)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
MAIN = "\n".join(t.strip() for t in TEXT)
CARD = "<article><h3><a href=1>Ten more mills to see</a></h3></article>"


def test_tree_learns_its_table():
    assert [classify(TREE, row[:-1]) for row in LABELLED] == [row[-1] for row in LABELLED]


@pytest.mark.parametrize(
    "page",
    [
        f"<div class=content>{BODY}</div><article class=comment><p>I liked this a lot, thank you</p></article>",
        f"<div class=content>{BODY}</div><aside>{CARD}{CARD}</aside>",
        f"<div class=content>{BODY}</div>{CARD}{CARD}",
        f"<article class='post comments-open has-comments'>{BODY}<ul><li><a href=1>One more</a><li><a href=2>Two more</a><li><a href=3>Three more</a></ul></article>",
    ],
)
def test_articles(page):
    assert main_text(page, TREE) == MAIN


LONG = "story words go on and on here " * 8


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><div class="share-price side">{LONG}</div></article>', LONG.strip()),
        (f'<article><div class="social media history">{LONG}</div></article>', LONG.strip()),
        (f'<article><p>{LONG}</p><div class="share-buttons">Share this on the net</div><div class="cookie-notice">{LONG}</div></article>', LONG.strip()),
        (f'<p>{LONG}<a title="x>link</a></p>', LONG.strip() + " link"),
        (f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article>", LONG.strip()),
    ],
)
def test_names_and_quotes(page, text):
    assert main_text(page, TREE) == text


def test_pages_built_from_parts():
    """Pages of random parts in random shells: whole blocks of the article and nothing else, on 95 of 100 blocks at least."""
    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{k}'>{word(2)}</a></li>" for k in range(n)) + "</ul>"
    right = found = wanted = 0
    for _ in range(150):
        body = [word(int(rng.integers(15, 90))) for _ in range(rng.integers(3, 9))]
        title = word(6)
        around = [
            f"<nav>{links(5)}</nav>", f"<div class='sidebar'><h3>{word(2)}</h3>{links(4)}</div>", f"<footer><p>{word(12)}</p>{links(3)}</footer>",
            f"<div id='cookie-banner'><p>{word(25)}</p><button>ok</button></div>", f"<form><label>{word(2)}</label><input name=q></form>",
            f"<div class='ad-box'>{word(9)}</div>", f"<section id='comments'><p>{word(30)}</p><p>{word(20)}</p></section>", f"<aside>{word(18)}</aside>",
        ]
        rng.shuffle(around)
        cut = int(rng.integers(0, len(around)))
        shell = ("article", "main", "div class='content'")[rng.integers(0, 3)]
        main = f"<{shell}><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"</{shell.split()[0]}>"
        page = f"<html><head><title>t</title><style>p{{}}</style></head><body>{''.join(around[:cut])}{main}{''.join(around[cut:])}<script>var x='<p>no</p>';</script></body></html>"
        got, want = main_text(page, TREE).split("\n"), [title, *body]
        right, found, wanted = right + len(set(got) & set(want)), found + len(got), wanted + len(want)
    precision, recall = right / found, right / wanted
    assert 2 * precision * recall / (precision + recall) >= 0.95, (precision, recall)
