"""Pages: cases by hand, broken pages of a megabyte, random pages against a plain recursive layout."""

import random
import time

from weirlog.llm import html


def test_pages_by_visibility_and_grid():
    cases = {
        "<div style='visibility:hidden'>no<p style='visibility:visible'>yes<b style='visibility:hidden'>no</b></div>": "yes", "<div style='display:none'><p style='display:block;visibility:visible'>no</div>yes": "yes",
        "<div hidden style='display:block'>yes</div>": "yes", "<table><tr><td rowspan=2>aaaa<td>b<tr><td>c</table>": "aaaa  b\n      c", "<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>": "a  b  c\nd     e\nf     g",
        "<table><tr><td colspan=2>a long heading<td>x<tr><td>p<td>q<td>r</table>": "a long heading  x\np  q            r", "<table><tr><td rowspan=2>1<td colspan=2 rowspan=2>22<td>3<tr><td>4<tr><td>5<td>6<td>7<td>8</table>": "1  22    3\n         4\n5  6  7  8",
        "<math><mi>x</mi><mo>=</mo></math>": "x=", "<svg><title>t</title><desc>no</desc><g>no<text>seen</text></g></svg>": "seen", "<dialog>no</dialog><dialog open>yes</dialog>": "yes", "a<br><br>b<br>c": "a\n\nb\nc", "<ol><li value=5>x<li>y</ol>": "5. x\n6. y",
        "<pre>a    b<br>c</pre>": "a    b\nc", "<pre>\nx\n\n\ty  </pre>z": "x\n\n\ty\n\nz", "<ul><li><span><b><i><pre>a\n  b</pre></i></b></span></ul>": "- a\n    b", "a < b <3 </> <!doctype x> <?q> c": "a < b <3 c", "x<!-->y<!--->z<!-- -->!": "xyz!", "<p>a<p": "a", "x<a b='c>d": "xd",
        f"<table><tr><td>{'w' * 300}<td>b<tr><td>c<td>d</table>": f"{'w' * 300}  b\nc{' ' * 299}  d", "<table>loose<tr>more<td>a</table>": "loose\nmore\na", "<p>1<table><tr><td>2<dt>3<dt>4</table>": "1\n\n2\n3\n4",
    }
    for page, want in cases.items():
        assert html.page_text(page)[1] == want, page
    for k in range(8):  # preformatted at any depth
        assert html.page_text(f"<pre>{'<span>' * k}a    b\nc    d{'</span>' * k}</pre>")[1] == "a    b\nc    d"
    assert html.page_text("<table><tr><td>" * 3000 + "deep")[1] == "deep" and html.page_text("<table><tr><td>x<td>y<tr><td>" * 300 + "deep")[1].endswith("deep")


def test_large_broken_pages_take_time_in_proportion():
    for piece in ("<a ", '<a "', '<a b="', "<", "</", "<!", "<!--", "<script>", "<p><table><b><dt>", "<ul><li><p>x", "<td rowspan=9>x", "<td>x", "<table><td>x", "<table><td>x<td>y", "<ul><li>", "<ul><li><table><td>x<td>", "<tr><td colspan=999><td>x", "<pre>x\n", "<b>x</p>", "&", "<p>a<br>", "<h1", "<svg><text>x", "<table><tr><td>a<td colspan=900>b", "<div style='visibility:hidden'>"):
        page, began = piece * (1_000_000 // len(piece)), time.process_time()
        assert len(html.page_text(page)[1]) < 100_000_000 and time.process_time() - began < 30, piece


def nested(rnd, depth, inline=False):
    """A random tree in text, and its lines by plain recursion: (page, kind, lines), kind being inline or the gap around."""
    word = "".join(rnd.choices("abcdefg", k=rnd.randint(1, 6)))
    kind = rnd.choice(["text", "b"] if inline or not depth else ["text", "b", "div", "p", "ul", "ol", "table", "hidden", "pre"])
    if kind in ("text", "b"):
        return (f"  {word} \n" if kind == "text" else f"<b> {word}</b>"), "inline", [word]
    if kind == "hidden":
        return f"<div hidden>{nested(rnd, depth - 1)[0]}</div>", "inline", []
    if kind == "pre":
        return f"<pre>{word}  {word}\n {word}</pre>", 2, [f"{word}  {word}", f" {word}"]
    if kind == "table":
        rows = [[nested(rnd, 0, True) for _ in range(2)] for _ in range(rnd.randint(1, 3))]
        wide = max(len(r[0][2][0]) for r in rows)
        return f"<table>{''.join(f'<tr><td>{a[0]}<td>{b[0]}' for a, b in rows)}</table>", 2, [f"{a[2][0]:{wide}}  {b[2][0]}" for a, b in rows]
    if kind in ("ul", "ol"):
        items, out = [nested(rnd, 0, True) for _ in range(rnd.randint(1, 3))], []
        for k, item in enumerate(items):
            out.append(f"{'- ' if kind == 'ul' else f'{k + 1}. '}{item[2][0]}")
        return f"<{kind}>{''.join(f'<li>{i[0]}' for i in items)}</{kind}>", 2, out
    kids = [nested(rnd, 0 if kind == "p" else depth - 1, kind == "p") for _ in range(rnd.randint(1, 4))]
    own, (lines, before, after) = 1 if kind == "div" else 2, stacked(kids)
    return f"<{kind}>{''.join(k[0] for k in kids)}</{kind}>", (max(own, before), max(own, after)), lines


def stacked(parts):
    """Lines of parts one after the other, and the gaps around: inline ones share a line, others keep the larger gap."""
    out, gap, joined, before = [], 0, False, 0
    for _, kind, lines in parts:
        if kind == "inline":
            if lines and joined:
                out[-1] += " " + lines[0]
            elif lines:
                before = before if out else gap
                out += [""] * (gap == 2 and bool(out)) + lines
                gap, joined = 0, True
            continue
        first, last = kind if isinstance(kind, tuple) else (kind, kind)
        gap, joined = max(gap, first), False
        if lines:
            before = before if out else gap
            out += [""] * (gap == 2 and bool(out)) + lines
            gap = 0
        gap = max(gap, last)
    return out, before if out else gap, gap


def test_random_pages_against_a_plain_layout():
    for seed in range(400):
        rnd = random.Random(seed)
        parts = [nested(rnd, 3) for _ in range(rnd.randint(1, 4))]
        page = "".join(p[0] for p in parts)
        assert html.page_text(page)[1] == "\n".join(stacked(parts)[0]).strip("\n"), page


def test_comments():
    cases = {"<!-- x": "", "a<!-- x": "a", "<!--": "", "a<!--b--!>c": "ac", "a<!--b-->c<!--d--!>e<!--f": "ace", "<!-->a": "a", "<!--->a": "a", "a<!---->b<!----!>c": "abc", "<!-": "", "a<!--x--": "a"}
    for page, want in cases.items():
        assert html.page_text(page)[1] == want, page


def test_lists_and_buttons():
    cases = {
        "<ol reversed><li>x<li>y<li>z</ol>": "3. x\n2. y\n1. z", "<ol reversed start=9><li>x<li value=4>y<li>z</ol>": "9. x\n4. y\n3. z", "<ol type=a start=26><li>x<li>y</ol>": "z. x\naa. y", "<ol type=A><li>x<li type=1>y</ol>": "A. x\n2. y",
        "<ol type=i start=3><li>x<li>y</ol>": "iii. x\niv. y", "<ol type=I start=1994><li>x</ol>": "MCMXCIV. x", "<ol type=i start=0><li>x</ol>": "0. x", "<ol type=q><li>x</ol>": "1. x", "<ol type=a start=-1><li>x</ol>": "-1. x",
        "<dl><dt>a<dd>b<p>c</dl>d": "a\n    b\n\n    c\n\nd", "<ul><li>a<dl><dt>b<dd>c</dl><li>d</ul>": "- a\n\n  b\n      c\n\n- d",
        "<input type=submit value=Go> <input type=text value=no><input type=button value='&lt;x'>": "Go <x", "<p hidden><input type=submit value=Go></p>a": "a", "<b style='visibility:hidden'><input type=reset value=Go></b>a": "a",
    }
    for page, want in cases.items():
        assert html.page_text(page)[1] == want, page


def test_wide_cells():
    """Columns stay aligned beside a long cell, unless the table would become many times its size."""
    lines = html.page_text("<table><tr><td>" + "w" * 201 + "<td>b" + "".join(f"<tr><td>{k}<td>c" for k in range(40)) + "</table>")[1].split("\n")
    assert {x.rstrip()[-1] for x in lines[1:]} == {"c"} and {len(x) for x in lines} == {204}
    page = "<table><tr><td>" + "w" * 1500 + "<td>b" + "".join(f"<tr><td>{k}<td>c" for k in range(9000)) + "</table>"
    assert len(html.page_text(page)[1]) < 10 * len(page)
