"""Pages by structure: forms around an article, comments without a telling name, and time that grows with the page alone."""

import time

import pytest

from tidemark.llm.html_text import main_text

ARTICLE = "<h1>A title</h1>" + "<p>A paragraph, with some words, about a thing.</p>" * 12
WANT = "\n".join(["A title"] + ["A paragraph, with some words, about a thing."] * 12)


@pytest.mark.parametrize("tag", ["form", "dialog", "noscript"])
def test_an_article_inside_stays(tag):
    assert main_text(f'<body><{tag} id="aspnetForm"><div class="nav">Home</div><div>{ARTICLE}</div></{tag}></body>') == WANT
    assert main_text(f"<body><div>{ARTICLE}</div><{tag}><p>Your name, your mail, please.</p></{tag}></body>") == WANT


@pytest.mark.parametrize("entry", ['<div class="x{i}"><b>Ann Lee</b><p>{d}</p><p>I think so too, well said.</p></div>', "<li><p>Bo</p><span>{d}</span><p>No, not at all.</p></li>", '<section class="q"><p>Cy, {d}</p><p>Maybe.</p></section>'])
@pytest.mark.parametrize("date", ["3 days ago", "2024-05-0{i}", "May 3, 2024", "vor 2 Stunden", "il y a 3 jours", "12.03.2024"])
def test_comments_without_a_name(entry, date):
    entries = "".join(entry.format(i=i, d=date.format(i=i)) for i in range(1, 6))
    assert main_text(f"<body><div><div>{ARTICLE}</div><div>{entries}</div></div></body>") == WANT


def test_lists_of_an_article_stay():
    """Without dates, with long entries, or as most of the page."""
    plain = "<ul>" + "<li>A point, that counts.</li>" * 5 + "</ul>"
    assert main_text(f"<body><div>{ARTICLE}{plain}</div></body>") == WANT + "\nA point, that counts." * 5
    events = "".join(f'<div class="e"><h3>May {i}, 2024</h3><p>{"What happened, in many words, on that day. " * 9}</p></div>' for i in range(1, 9))
    assert main_text(f"<body><div><p>A chronicle, in short.</p>{events}</div></body>").count("What happened") == 72


@pytest.mark.parametrize("piece", ["<div><p>some text, here ", "<div>", "<ul><li>x", "</b><div>y", "<span><header>t", "<p><i><b>z", "<dl><dt>a<dd>b"])
def test_time_is_linear_in_depth(piece):
    start = time.process_time()
    main_text("<html><body>" + piece * 50_000)
    assert time.process_time() - start < 8
