"""HTML to Markdown on fixtures, and tables there and back."""

import random
import re

import pytest

from folioframe.operators import rich_markdown as md


def cells(lines):
    """The cells of a pipe table without its rule."""
    return [[c.strip() for c in line.strip("|").split("|")] for i, line in enumerate(lines) if i != 1]


def test_spanned_tables():
    html = "<table><tr><th rowspan=2>a</th><th colspan='2'>b|c</th></tr><tr><td>d<td>e</tr><tr><td>f</td></tr></table>"
    lines = md.rich_markdown_of(html).split("\n")
    assert lines == ["| a | b c |   |", "|---|-----|---|", "|   | d   | e |", "| f |     |   |"]
    # spans over the edge, nonsense, leading empty rows and a table in a cell
    assert md.rich_markdown_of("<table><tr><td></td></tr><tr><td rowspan=9>x</td><td colspan='no'>y</td></tr></table>").split("\n") == ["| x | y |", "|---|---|"]
    assert md.rich_markdown_of("<table><tr><td>a<table><tr><td>in|ner</td></tr></table></td></tr></table>").split("\n")[0] == "| ain ner |"
    assert md.rich_markdown_of("<table></table><table><tr></tr></table>") == ""


def test_grids_there_and_back():
    rng = random.Random(4)
    for _ in range(60):
        rows, width = rng.randrange(1, 6), rng.randrange(1, 6)
        # a tiling of the grid by cells
        owner, given = {}, [[] for _ in range(rows)]
        for i in range(rows):
            for j in range(width):
                if (i, j) in owner:
                    continue
                down, across = rng.randrange(1, rows - i + 1), 1
                while j + across < width and (i, j + across) not in owner and rng.random() < 0.4:
                    across += 1
                name = f"c{i}{j}"
                for y in range(i, i + down):
                    for x in range(j, j + across):
                        owner[y, x] = name if (y, x) == (i, j) else ""
                given[i].append((name, down, across))
        want = [[owner[i, j] for j in range(width)] for i in range(rows)]
        assert md.grid(given) == want
        html = "<table>" + "".join("<tr>" + "".join(f'<td rowspan="{d}" colspan="{a}">{t}</td>' for t, d, a in row) + "</tr>" for row in given) + "</table>"
        assert cells(md.rich_markdown_of(html).split("\n")) == want


def test_blocks():
    html = """<html><head><title>no</title></head><body><h2>A <em>b</em></h2><p>one<br>two &lt;3 <code>a`b</code> <a href="x y">l [1]</a></p>
      loose <b> bold </b><ul><li>x<ol start=3><li>y</li><li><p>z</p><p>zz</p></li></ol></li><li></li></ul><blockquote><p>q</p><p>r</p></blockquote>
      <pre><code class="language-py">if a:
    ``` b
</code></pre><hr><p><img src="i.png" alt="a*"> <sup>3</sup> <math>x^2</math></p><math display="block"> y </math><script>no</script></body></html>"""
    assert md.rich_markdown_of(html) == "\n".join([
        "## A *b*", "", "one", "two \\<3 ``a`b`` [l \\[1\\]](x%20y)", "", "loose **bold**", "", "- x", "  3. y", "  4. z", "     zz", "- ", "", "> q", ">", "> r", "",
        "````py", "if a:", "    ``` b", "````", "", "---", "", "![a\\*](i.png) <sup>3</sup> $x^2$", "", "$$y$$",
    ])
    assert md.rich_markdown_of(None) == md.rich_markdown_of("") == md.rich_markdown_of("<p> </p>") == ""


def test_escapes_by_context():
    p = lambda t: md.rich_markdown_of(f"<p>{t}</p>")
    assert p("1. not a list") == "1\\. not a list" and p("# no") == "\\# no" and p("- no") == "\\- no" and p("&gt; no") == "\\> no" and p("---") == "\\---"
    assert p("#tag 5.5 a - b") == "#tag 5.5 a - b" and p("a_b _c_ *d* $5") == "a_b \\_c\\_ \\*d\\* \\$5" and p("a\\b `c`") == "a\\\\b \\`c\\`"
    assert md.rich_markdown_of("<pre>* $ _x_</pre>") == "```\n* $ _x_\n```" and md.rich_markdown_of("<math>a_1*b</math>").strip() == "$a_1*b$"


def test_pages_and_margins():
    html = '<div class="page" data-page-id="4" data-printed-page="12" data-page-header="Head -- er" data-page-footer="12"><p>x</p><aside class="marginal-annotation left">15</aside><aside class="marginal-annotation left">a note</aside></div>'
    assert md.rich_markdown_of(html) == "{4}\n---\n<!-- PageHeader: Head - - er -->\n<!-- Page: 12 -->\n\nx\n\n<!-- Line: 15 -->\n\n<!-- Margin:left: a note -->"
    assert md.rich_markdown_of(html, margins="drop").endswith("x") and md.rich_markdown_of(html, margins="plain").endswith("15\n\na note")
    with pytest.raises(ValueError):
        md.rich_markdown_of(html, margins="none")


def test_last_repairs():
    assert md.formatted("see page <sup>12</sup> and word<sup>3)</sup> &lt;sup&gt;4&lt;/sup&gt;\n\n\n\nx") == "see page 12 and word<sup>3</sup> <sup>4</sup>\n\nx"
    assert md.formatted("# Contents\nIllustrationsvii\n## Next\nIllustrationsvii") == "# Contents\nIllustrations vii\n## Next\nIllustrationsvii"
    assert md.formatted("```\n&lt;sup&gt;4&lt;/sup&gt;\n\n\n\n```") == "```\n&lt;sup&gt;4&lt;/sup&gt;\n\n\n\n```"
    text = "1. short\n7. also short\n- 12. a paragraph\n31. alone\n32. counts on\n9. {anchor}"
    assert md.formatted(text, True) == "1. short\n7. also short\n12\\. a paragraph\n31\\. alone\n32\\. counts on\n9. {anchor}"
    assert md.formatted(md.formatted(text, True), True) == md.formatted(text, True)


def test_deep_and_broken_html():
    assert md.rich_markdown_of("<div>" * 300 + "x" + "</div>" * 300) == "x"
    assert md.rich_markdown_of("<div><b>" * 20_000 + "<p>x</p>y").replace("*", "").split() == ["x", "y"]
    assert md.rich_markdown_of("<p>a<p>b</i></p></table><li>c") == "a\n\nb\n\nc"
    assert re.fullmatch(r"- a\n  - b\n- c", md.rich_markdown_of("<ul><li>a<ul><li>b</ul><li>c</ul>"))
