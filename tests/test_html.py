from verbaloom.operators import html as H

PAGE = """<html><body><div class="mw-parser-output"><p>one</p></div>
<div class="mw-parser-output"><h1>no</h1><p>a <b>b</b>[1]</p><table><tr><td><p>t</p></td></tr></table>
<ul><li>x<p>y</p></li></ul><div class="navbox"><p>n</p></div><script>var t="</p>";</script><p> </p></div></body></html>"""


def test_blocks():
    assert H.blocks(PAGE) == [("p", "a b [1]"), ("li", "x y"), ("p", "y")]
    assert H.blocks("") == [] and H.blocks(None) == []
    assert H.blocks("<p>a<p>b") == [("p", "a b"), ("p", "b")]


def test_markdown():
    html = '<body><h2>T</h2><p>a <a href="/x">l</a> <img src="//i/p" alt="z"><span>s</span></p><ul><li>q</li></ul><table><tr><th>h</th></tr><tr><td>c</td></tr></table></body>'
    text = H.markdown(H.faithful(html, "https://h", "https://h/b/"))
    for part in ("## T", "a [l](https://h/x) ![z](https://i/p)s", "- q", "| h |", "| --- |", "| c |"):
        assert part in text


def test_category_lines():
    html = '<body><link rel="mw:PageProp/Category" href="./C"><link rel="stylesheet" href="s"><p>x</p></body>'
    assert "Category: ./C" in H.markdown(H.faithful(html, "https://h", "https://h/b/"))


def test_deep_markup():
    assert H.blocks("<div>" * 3000 + "<p>x</p>") == [("p", "x")]
    assert "x" in H.markdown(H.parse("<div>" * 3000 + "x"))
