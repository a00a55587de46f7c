"""The page reader on regular, sloppy and hostile markup."""

from hypothesis import given, settings, strategies as st

from kickpool.operators import markup


def cells(html, table=0):
    return [
        [c[0] for c in row[5]] for row in markup.page_table_rows(html) if row[0] == table
    ]


def test_omitted_tags():
    html = "<table><tr><td>a<td>b<tr><th>c</table>tail"
    assert cells(html) == [["a", "b"], ["c"]]
    assert all(row[1] is not None for row in markup.page_table_rows(html))


def test_head_rows_have_no_body_ordinal():
    html = "<table><thead><tr><th>h<tbody><tr><td>x</tbody><tfoot><tr><td>f</table>"
    assert [(r[1], r[2]) for r in markup.page_table_rows(html)] == [(None, 0), (0, 1), (None, 2)]


def test_nested_table_counts_for_both():
    html = "<table><tr><td>a<table><thead><tr><td>in</table>b<td>c</table>"
    rows = list(markup.page_table_rows(html))
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [
        (0, 0, 0, True), (0, 1, 1, False), (1, 0, 1, True),
    ]
    assert cells(html) == [["ainb", "in", "c"], ["in"]]


def test_stranded_content_moves_before_the_table():
    html = "<p>x</p><table>lost<tr><td>1</td><b>bold</b></tr> <tr><td>2</table>"
    assert markup.page_text(html).__next__() == ("xlostbold1 2",)
    assert cells(html) == [["1"], ["2"]]


def test_table_in_table_without_cell_starts_anew():
    html = "<table><tr><td>1</td></tr><table><tr><td>2</td></tr></table>"
    assert (cells(html, 0), cells(html, 1)) == ([["1"]], [["2"]])


def test_row_parts_outside_tables_vanish():
    assert list(markup.page_table_rows("<tr><td>x</td></tr>")) == []


def test_entities_spaces_and_attributes():
    html = "<a HREF='/x?a=1&amp;b=2' title=\"a>b\"> A&nbsp;&amp;\n B </a><a>no</a>"
    assert list(markup.page_links(html)) == [(0, "A & B", "/x?a=1&b=2"), (1, "no", "")]


def test_scripts_titles_and_comments():
    html = "<title>a<b>c</title><script>var x='</td><a>';</script><!-- <a> --><!--><a href=z>k"
    assert list(markup.page_links(html)) == [(0, "k", "z")]
    assert next(markup.page_text(html)) == ("a<b>cvar x='</td><a>';k",)


def test_first_link_and_span_of_a_cell():
    html = "<table><tr><td>x <a><i></i><span> N </span><span>m</span> y</a><a>z</a></table>"
    (row,) = markup.page_table_rows(html)
    assert row[5] == [("x N m yz", "N m y", "N", None)]


def test_links_do_not_nest():
    assert [x[1] for x in markup.page_links("<a>1<a>2</a>3</a>")] == ["1", "2"]


def test_cell_markup():
    html = "<table><tr><td><b class='k'>1 &lt; 2</b><br></table>"
    (row,) = markup.page_table_rows(html, cell_html=500)
    assert row[5][0][3] == '<b class="k">1 &lt; 2</b><br>'
    (row,) = markup.page_table_rows(html, cell_html=5)
    assert row[5][0][3] == "<b cl"


def test_deep_nesting():
    html = "<table><tr><td>" * 300 + "x" + "</table>" * 300
    assert len(list(markup.page_tables(html))) == 300


@given(st.text(alphabet="<>/!-?='\"& abtdrh;[]\n", max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text_is_read(html):
    list(markup.page_table_rows("<table>" + html, 50, True))
    list(markup.page_links(html))
    next(markup.page_text(html))


pieces = st.sampled_from(
    ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<tbody>", "<thead>",
     "<a>", "</a>", "<span>", "x", " y ", "<p>", "<td/>", "<caption>", "&amp;"]
)


@given(st.lists(pieces, max_size=40))
@settings(max_examples=400, deadline=None)
def test_rows_cover_their_cells(parts):
    html = "".join(parts)
    for table, _, _, innermost, text, row_cells in markup.page_table_rows(html, 0, True):
        assert table >= 0 and isinstance(innermost, bool)
        assert all(c[0] in text or not c[0] for c in row_cells)


def test_tables_preview():
    html = "<table><tr><td>a</td></tr> <tr><td>b</td></tr></table>"
    assert list(markup.page_tables(html)) == [(0, 2, "a b")]
