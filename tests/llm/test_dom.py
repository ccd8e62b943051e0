"""Broken pages keep the text after the break."""

import pytest
from orestrata.llm import dom


def texts(html):
    return [n.text for n in dom.parse(html) if n.tag == "#text"]


@pytest.mark.parametrize("broken", ["<![foo[x]]>", "<![data[>", "<![ >", "<![1[x]]>"])
def test_text_after_a_broken_declaration_stays(broken):
    assert texts(f"<p>a</p>{broken}<p>b</p>") == ["a", "b"]
    assert texts(f"<p>a</p>{broken[:-1]}") == ["a", *texts(f"<p></p>{broken[:-1]}")]


@pytest.mark.parametrize("tag", ["button", "object", "canvas", "svg", "noscript", "iframe"])
def test_an_unclosed_silent_element_ends_with_its_block(tag):
    assert texts(f"<article><div><{tag}>x</div><p>b</p></article>") == ["b"]
    assert texts(f"<div><{tag}><div>x</div><i>y</i></span>z</{tag}>b</div>") == ["b"]
    assert texts(f"<div><{tag}>x<{tag}>y</{tag}>z</{tag}>b</div>") == ["b"]


def test_raw_text_stays_silent():
    assert texts("<div><textarea></div>x</textarea>b</div>") == ["b"]
