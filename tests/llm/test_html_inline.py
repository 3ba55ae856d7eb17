"""Dropped inline elements end at their own end tags, and attributes are told by their names."""

import pytest

from corpuslab.llm import html_text

CASES = [
    ('<body><a class="skip-link" href="#c">Skip</a><article><p>Main text.</p></article></body>', "Main text."),
    ('<body><p>x <span class="notice">n</span> y</p></body>', "x y"),
    ('<body><p>x <span class="notice">n <span>m</span> o</span> y</p><p>z</p></body>', "x y z"),
    ('<body><p>x <span class="notice">n <b>m</b> o</span> <span>y</span></p></body>', "x y"),
    ('<body><a class="skip" href="#c">Skip<a href="/">home</a> rest</body>', "home rest"),
    ('<body><span class="ad">n<div>in</div>o</span>y</body>', "y"),
    ('<body><p>x <span hidden>n</p><p>y</p></body>', "x y"),
    ('<body><p>a <a href="/the-hidden-cost">b</a> c</p><div style="overflow:hidden">d</div></body>', "a b c d"),
    ('<body><div data-id="menu" title="id=menu class=ad hidden">d</div><div data-class="ad">e</div></body>', "d e"),
    ('<body><div HIDDEN>d</div><div aria-hidden=true>e</div><div CLASS=\'ad\'>f</div><div id = menu>g</div>h</body>', "h"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_main_text(html, text):
    assert " ".join(t for t, _ in html_text.parse(html)[0]) == text
