"""Elements without closing tag, and closing tags in capitals, in the main text."""

import pytest

from missive.llm import main_text


def texts(page):
    return [t.strip() for t, _, _ in main_text.blocks(page)]


@pytest.mark.parametrize("name", ["svg", "math", "object", "canvas", "audio", "video", "select", "template", "noscript"])
def test_the_rest_of_the_page_stays(name):
    assert texts(f"<p>first</p><{name} x=1><p>second</p><{name}><p>third</p>") == ["first", "second", "third"]
    assert texts(f"<p>first</p><{name}>gone</{name}><p>third</p>") == ["first", "third"]


def test_elements_that_swallow_the_page():
    for name in main_text.SWALLOWING:
        assert texts(f"<p>first</p><{name}><p>second</p>") == ["first"]


def test_capitals_where_lower_case_is_longer():
    assert texts("<p>İstanbul</p><script>x</SCRIPT><p>after</p>") == ["İstanbul", "after"]
