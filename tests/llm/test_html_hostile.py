"""Layout-aware text: visibility rules, pages made to break a parser, and plain pages against a slow reference."""

import random
import re
import time
from html import unescape

import pytest

from tidemark.llm.html_layout import render


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<style>@media print{.x{display:none}}</style><p class=x>a", "a"),
        ("<style>@media screen{.x{display:none}}</style><p class=x>a<p>b", "b"),
        ("<style>.x{display:none} .x{display:block}</style><p class=x>a", "a"),
        ("<style>.x{display:none !important} .x{display:block}</style><p class=x>a<p>b", "b"),
        ("<style>p{display:none} #k{display:block}</style><p id=k>a<p>b", "a"),
        ("<div style='visibility:hidden'>no <span style='visibility:visible'>yes</span> no</div>", "yes"),
        ("<style>/* .x{display:none} */ .y{display:none}</style><p class=x>a<p class=y>b", "a"),
        ("<style>.a .b{display:none}</style><div class=a><i><b class=b>no</b></i></div><p class=b>yes", "yes"),
        ("<style>.a > .b{display:none}</style><div class=a><p><b class=b>yes</b></p><p class=b>no</div>", "yes"),
        ("<style>.a.b{display:none}</style><p class='b a'>no<p class=a>yes", "yes"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>a", "a"),
        ("<p hidden>no<p>yes", "yes"),
        ("<ol start=²><li>x<li value=²>y</ol>", "1. x\n2. y"),
        ("<table><tr><td colspan=²>q<td rowspan=٣>r</table>", "q  r"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
        ("<ul><li><p>a</p><p>b</p></li><li>c</ul>", "- a\n\n  b\n- c"),
        ("<blockquote><p>a</p><ul><li>b</ul></blockquote>c", "    a\n\n    - b\n\nc"),
    ],
)
def test_cases(html, want):
    assert render(html)[0] == want


@pytest.mark.parametrize("tag", ["blockquote", "ul><li", "ol><li", "div", "table><tr><td", "dl><dd", "span"])
def test_depth(tag):
    assert render(f"<{tag}>" * 5000 + "deep")[0].endswith("deep")


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 330_000, '<a href="' * 110_000, "<p class='x" * 90_000, "<!--" * 250_000, "</" * 500_000, "&" * 1_000_000, "<style>" + "a" * 1_000_000, "<style>" + "{" * 500_000,
        "<tr><td colspan=1000>x<td>y" * 35_000, "<style>" + "".join(f".a{i} .b{{display:none}}" for i in range(9000)) + "</style>" + "".join(f"<i class=b id=i{i}>x</i>" for i in range(20_000)),
    ],
    ids=range(10),
)
def test_a_megabyte_made_to_be_slow(html):
    began = time.process_time()
    render(html)
    assert time.process_time() - began < 5  # about 2 s on an idle machine


def test_simple_pages_against_a_slow_reference():
    """Blocks of words, spans, line breaks and hidden parts: what shows is known from how the page was made."""
    rng = random.Random(4)
    for _ in range(200):
        html, lines, gap = "", [], False
        for _ in range(rng.randint(1, 8)):
            words = [rng.choice(["a", "bc", "x &amp; y", "é", "1 &lt; 2"]) for _ in range(rng.randint(1, 6))]
            text = "".join(w + rng.choice([" ", "  \n ", "\t"]) for w in words)
            kind = rng.choice(["p", "div", "hidden", "span"])
            if kind == "hidden":
                html += f"<p style='display: none'>{text}</p>"
                continue
            html += f"<{'div' if kind == 'span' else kind}>{f'<span>{text}</span>' if kind == 'span' else text}</{'div' if kind == 'span' else kind}>"
            if (gap or kind == "p") and lines:
                lines.append("")
            lines.append(" ".join(re.split("[ \t\n]+", unescape(text).strip())))
            gap = kind == "p"
        assert render(html)[0] == "\n".join(lines)


def test_pages_without_tags():
    rng = random.Random(9)
    for _ in range(100):
        text = "".join(rng.choice("ab >é\n\t &;") for _ in range(rng.randint(0, 200)))
        assert render(text)[0] == re.sub("[ \t\n]+", " ", unescape(text)).strip(" ")


def _grid(rows):
    """Where cells stand, by the definition: each takes the first free places of its row, and those below that it spans."""
    taken, placed = set(), []
    for y, row in enumerate(rows):
        x = 0
        for text, down in row:
            while (x, y) in taken:
                x += 1
            taken |= {(x, y + k) for k in range(down)}
            placed.append((y, x, text))
            x += 1
    return placed


@pytest.mark.parametrize("seed", range(40))
def test_random_spans_against_a_grid(seed):
    """Cells that span rows, at rows' ends too: every cell begins where its column does."""
    rng = random.Random(seed)
    rows = [[("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 7))]
    html = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d}>{t}" if d > 1 else f"<td>{t}" for t, d in row) for row in rows) + "</table>"
    placed = _grid(rows)
    width = {}
    for _, x, t in placed:
        width[x] = max(width.get(x, 0), len(t))
    start = [0]
    for x in range(max(width) + 1):
        start.append(start[-1] + width.get(x, 0) + 2)
    want = []
    for y in range(len(rows)):
        line = ""
        for _, x, t in sorted(p for p in placed if p[0] == y):
            line = line.ljust(start[x]) + t
        want.append(line)
    assert render(html)[0].split("\n") == want


def test_a_span_at_a_rows_end_counts_down():
    assert render("<table><tr><td>a<td rowspan=2>b<tr><td>c<tr><td>d<td>e</table>")[0].split("\n") == ["a  b", "c", "d  e"]
    assert render("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</tbody></table>")[0].split("\n") == ["a  b", "c  d"]
