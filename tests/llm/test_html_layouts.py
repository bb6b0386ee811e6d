"""Main text of common theme layouts: wrappers with telling class names stay, parts that are no content go."""

import pytest

from cloakfield.llm.html_extract import main_text

WORDS = "The river rose again in spring, and the people of the town went up the hill to wait.".split()
BODY = [" ".join(WORDS[k:] + WORDS[:k]) + " It was a long week, they said; nobody slept much." for k in range(5)]
P = "".join(f"<p>{x}</p>" for x in BODY)
TEXT = " ".join(BODY)
NAV = '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">All stories</a></li></ul></nav>'
FOOT = '<footer><p>Copyright 2020, the makers. All rights reserved, everywhere.</p></footer>'
SIDE = '<div class="sidebar"><h3>Popular</h3><p>Read our best story, chosen by the staff.</p></div>'
TALK = "".join(f'<div class="comment"><p>Reader {k} says: I do not agree, at all.</p></div>' for k in range(4))
COOKIE = '<div class="cookie-banner"><p>We use cookies, and you may accept them.</p><button>Accept</button></div>'

LAYOUTS = {
    "plain": P,
    "no sidebar": f'{NAV}<div class="content no-sidebar">{P}</div>{FOOT}',
    "has header": f'{NAV}<div id="page" class="has-header site">{P}</div>{FOOT}',
    "search engine": f'<div class="post search-engine">{P}</div>{SIDE}',
    "form around all": f'<form action="/x">{NAV}<div id="content">{P}</div>{FOOT}</form>',
    "form and fieldset": f"<form><fieldset>{P}</fieldset></form>",
    "body class": f'<div class="wrapper sidebar-right"><div class="main-col">{P}</div>{SIDE}</div>{FOOT}',
    "left sidebar": f'<div class="left-sidebar layout">{SIDE}<div class="col">{P}</div></div>',
    "comments open": f'<div class="single comments-open"><div class="text">{P}</div><div class="comments-area">{TALK}</div></div>',
    "article and comments": f"{COOKIE}<article>{P}</article><section id=\"comments\">{TALK * 3}</section>{FOOT}",
    "comments as articles": f'<main><article>{P}</article></main><div id="comments"><article>{TALK}</article></div>',
    "table": f"<table><tr><td class=\"menu\"><a href='/'>Home</a></td><td>{P}</td></tr></table>",
    "old center": f"<center><div>{NAV}</div><div>{P}</div></center>{FOOT}",
    "header around": f'<div class="header-fixed app"><div class="app-body">{P}</div></div>',
    "banner theme": f'<div class="theme banner-small"><section>{P}</section></div>{SIDE}',
    "social page": f'<div id="social-news"><div>{P}</div></div><div class="share"><a href="/s">Share it</a></div>',
    "widget theme": f'<div class="widget-theme"><div class="inner">{P}</div></div>{COOKIE}',
    "notice page": f'<div class="notice-board">{NAV}<div>{P}</div></div>',
    "role": f'<div role="banner"><p>The daily paper, since 1900.</p></div><div role="main">{P}</div><div role="contentinfo"><p>Imprint, terms and more.</p></div>',
    "aside quote": f'<main>{P}<aside><p>Buy now, pay later, be happy.</p></aside></main>',
    "login around": f'<div class="login-page"><div class="t">{P}</div><form class="login"><p>Your name, please.</p></form></div>',
    "modal": f'<div class="modal"><p>Subscribe now, it is free.</p></div><div class="story">{P}</div><div class="newsletter"><p>Our letter, each week.</p></div>',
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    assert main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{LAYOUTS[name]}</body></html>") == TEXT


@pytest.mark.parametrize("head", ['<div class="entry-header"><h1>Title</h1></div>', '<header><h1>Title</h1></header>', "<h1>Title</h1>", '<div class="article-header"><h1>Title</h1></div>'])
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="post">{}</div>', '<div id="main" class="has-sidebar">{}</div>'])
def test_headlines_stay(head, frame):
    page = f"<html><body>{NAV}{frame.format(head + P)}{SIDE}{FOOT}</body></html>"
    assert main_text(page) == "Title " + TEXT


def test_formulas_are_text():
    assert main_text(f"<article><p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds, as it must.</p>{P}</article>") == "Here x=1 holds, as it must. " + TEXT


def test_a_page_of_nothing_but_doubted_parts_keeps_the_largest():
    assert main_text(f'<div class="related"><p>{BODY[0]}</p></div>') == BODY[0]
    assert main_text("") == main_text(None) == main_text("<nav></nav>") == ""


def test_long_and_deep_pages_end():
    import time

    began = time.time()
    assert main_text("<div>x " * 150_000).split() == ["x"] * 150_000
    assert len(main_text("<p>x" * 200_000).split()) == 200_000
    assert time.time() - began < 30
