"""Tables of HTML pages against a grid laid out by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.sources import readers
from plumbline.sources.html_tables import first_table


def grid(html):
    rows = {}
    for r, c, text in first_table(html):
        assert c not in rows.setdefault(r, {})
        rows[r][c] = text
    return [[row.get(c) for c in range(max(row) + 1)] for _, row in sorted(rows.items())]


@pytest.mark.parametrize("html,want", [
    ("<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table>", [["a", "b"], ["c"]]),
    ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", [["a", "b"], ["c", "d"]]),
    ("<table><td>a<td>b</table>", [["a", "b"]]),
    ("<table><thead><tr><th>h<tbody><tr><td>1<tr><td>2</table>", [["h"], ["1"], ["2"]]),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", [["a", "b"], ["a", "c"]]),
    ("<table><tr><td colspan='2'>a<td>b<tr><td>c<td>d<td>e</table>", [["a", "a", "b"], ["c", "d", "e"]]),
    ("<table><tr><td>a<td rowspan=3>b<tr><td>c<tr><td>d<tr><td>e<td>f</table>", [["a", "b"], ["c", "b"], ["d", "b"], ["e", "f"]]),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d</table>", [["a", "b"], ["a", "c"], ["d"]]),
    ("<table><tr><td rowspan=x colspan=-1>a<td>b</table>", [["a", "b"]]),
    ("<table><tr><td>&amp;&eacute;&#8364;&#x41;&nbsp;x &lt;td&gt;</table>", [["&é€A x <td>"]]),
    ("<table><tr><td>a<br>b <b>c</b><script>var x = '<td>'</script></td></table>", [["a b c"]]),
    ("<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</td></tr></table><table><tr><td>second</table>", [["x   in y", "z"]]),
    ("<table><![foo[x]]><tr><!-- <td>no</td> --><td>a</table>", [["a"]]),
    ("<table><tr><td>a</td><td>cut off <b", [["a", "cut off"]]),
    ("<p>no table</p>", []), ("<table></table>", []), ("", []),
])
def test_grids(html, want):
    assert [[" ".join(v.split(" ")) for v in row] for row in grid(html)] == want


@pytest.mark.parametrize("seed", range(25))
def test_random_spans_fill_the_grid(seed):
    """A grid is cut into rectangles and written down as cells; reading gives the grid back."""
    rng = random.Random(seed)
    n, m = rng.randint(1, 6), rng.randint(1, 6)
    owner = [[None] * m for _ in range(n)]
    rows = []
    for r in range(n):
        cells = []
        for c in range(m):
            if owner[r][c] is not None:
                continue
            width = 1
            while c + width < m and owner[r][c + width] is None and rng.random() < 0.4:
                width += 1
            height = rng.randint(1, n - r)
            name = f"{r}.{c}"
            for y in range(r, r + height):
                for x in range(c, c + width):
                    owner[y][x] = name
            cells.append(f"<td colspan={width} rowspan={height}>{name}" + rng.choice(["", "</td>", "\n"]))
        rows.append("<tr>" + "".join(cells) + rng.choice(["", "</tr>"]))
    assert grid("<table>" + "".join(rows) + "</table>") == owner


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td rowspan=2>", "<th colspan=3>", "<tbody>", "<![", "<!", ">", "<", "x", "&", "<script>", "</script>", "<!--"]), max_size=30))
def test_no_markup_ends_the_job(parts):
    cells = first_table("".join(parts))
    assert len({c[:2] for c in cells}) == len(cells)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>a<td>b</table>"), (2, None), (3, "none"), (None, "<TABLE><TR><TD>c</TABLE>")], "`p.id` long, html string")
    got = [tuple(r) for r in readers.html_table_rows(pages, "p.id", "html").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, "a"), (1, 0, 1, "b"), (None, 0, 0, "c")], key=str)
