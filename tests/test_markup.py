from html import unescape

import pytest
from pyspark.sql import functions as F

from postweave.functions import text as T
from postweave.operators import markup as M


def one(spark, value, column):
    schema = "x string"
    return spark.createDataFrame([(value,)], schema).select(column(F.col("x")).alias("y")).first().y


def details(spark, html):
    row = M.detail_records(spark.createDataFrame([("1", html)], "id string, html string")).first()
    pairs = None if row.details is None else [(p.key, p.value) for p in row.details]
    return pairs, row.status_tags, row.error


@pytest.mark.parametrize(
    "text, wanted",
    [("Job 12 id 436892", "436892"), (" abc\n", "abc"), ("", ""), ("7", "7"), (None, None)],
)
def test_last_number(spark, text, wanted):
    assert one(spark, text, T.last_number) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [("Work/Term :", "work_term_"), ("Level:", "level"), ("  Job Summary: ", "job_summary"), ("A::B/C D", "ab_c_d")],
)
def test_normalize_key(spark, text, wanted):
    assert one(spark, text, T.normalize_key) == wanted


@pytest.mark.parametrize("text", ["  a b  \n", "\x1c\x85x　", "", " \t\r\n", "​kept​"])
def test_strip_is_full(spark, text):
    assert one(spark, text, T.strip) == text.strip()


@pytest.mark.parametrize(
    "text",
    [
        "a &amp; b", "&lt;p&gt;", "&amp;lt;", "&copy;&middot;&quot;", "&#65;&#x42;&#128512;", "&nosuch; & &", "caf&eacute;",
        "&nbsp;", "no entity",
    ],
)
def test_entities(spark, text):
    got = spark.createDataFrame([(text,)], "x string").select(F.expr(T.decode_entities_sql("x")).alias("y")).first().y
    assert got == unescape(text)


@pytest.mark.parametrize(
    "html, wanted",
    [
        (" a\n", "a"),
        ("<b>a</b> <i>b</i>", "a b"),
        ("a<br>b<br/> c", "a\nb\nc"),
        ("a\n\n  b", "a b"),
        ("<script>x</script>y<!-- z -->", "y"),
        ("1 < 2 &amp; 3", "1 < 2 & 3"),
        ("Acme<div>West</div>", "Acme\nWest"),
        ("<div><div>a</div></div> <p>b</p> c<ul><li>d</li><li>e</li></ul>", "a\n\nb\n\nc\nd\ne"),
        ("<i title='a > b'>x</i><b title=\"<div>\">y</b><u title=it's>z</u>", "xyz"),
    ],
)
def test_rendered_text(spark, html, wanted):
    frame = spark.createDataFrame([(html,)], "x string")
    assert frame.select(F.expr(M.rendered_text_sql("x")).alias("y")).first().y == wanted


HEADER = '<div class="dashboard-header--mini">{}</div>'
SECTION = '<div class="tag__key-value-list"><span class="label">{}</span>{}</div>'


@pytest.mark.parametrize(
    "inner, wanted",
    [
        ("", [("job_title", "N/A")]),
        ("<h2> T </h2>", [("job_title", "T")]),
        ('<h2>T</h2><div class="font--14"><span>only</span></div>', [("job_title", "T")]),
        (
            '<h2>T</h2><div class="font--14"><span> O </span><span>D</span><span>x</span></div>',
            [("job_title", "T"), ("organization", "O"), ("division", "D")],
        ),
    ],
)
def test_header(spark, inner, wanted):
    assert details(spark, HEADER.format(inner)) == (wanted, [], None)


def test_no_header(spark):
    assert details(spark, "<p>nothing</p>") == ([], [], None)


def test_unread_page_is_an_error(spark):
    assert details(spark, None) == (None, None, "Empty detail page")


@pytest.mark.parametrize("html", ["", " \n"])
def test_blank_page_is_a_record_without_details(spark, html):
    assert details(spark, html) == ([], [], None)


def test_tags(spark):
    html = '<div class="tag-rail"><span class="tag-label"> a <b>b</b></span><span>x</span><span class="t tag-label">c</span></div>'
    assert details(spark, html)[1] == ["ab", "c"]


def test_repeated_key_keeps_place_and_takes_last_value(spark):
    html = SECTION.format("A:", "<p>1</p>") + SECTION.format("B:", "<p>2</p>") + SECTION.format("A:", "<p>3</p>")
    assert details(spark, html)[0] == [("a", "3"), ("b", "2")]


def test_job_title_section_is_ignored_and_blank_is_not_available(spark):
    html = SECTION.format("Job Title:", "<p>x</p>") + SECTION.format("B:", "<p> </p>") + "<p>\n</p>"
    assert details(spark, html)[0] == [("b", "N/A")]


def test_section_without_label_is_skipped(spark):
    assert details(spark, '<div class="tag__key-value-list"><p>x</p></div>')[0] == []


def test_siblings(spark):
    html = (
        "<section>"
        + SECTION.format("A:", "<p>in<br>side</p><p>second is not read</p>")
        + "<p>one</p>loose<span>no</span><ul><li>x</li><li><b>y</b> z</li></ul><table><tr><td><p>no</p></td></tr></table>"
        + "<div>d<div>e</div><hr><p>f</p></div></section><p>outside</p>"
    )
    assert details(spark, html)[0] == [("a", "in\nside\n\none\n\nx\ny\nz\n\nd\ne\nf")]


def test_block_that_wraps_a_section_is_read_in_both(spark):
    html = (
        "<main>" + SECTION.format("A:", "<p>in</p>") + "<p>first</p><div>text "
        + SECTION.format("B:", "<p>x</p>") + "<p>y</p></div><p>z</p>" + SECTION.format("C:", "<p>c</p>") + "<p>d</p></main>"
    )
    assert details(spark, html)[0] == [
        ("a", "in\n\nfirst\n\ntext\nB:\nx\ny\n\nz"), ("b", "x\n\ny"), ("c", "c\n\nd"),
    ]


@pytest.mark.parametrize(
    "label, inside, wanted",
    [
        ("Level:", "<p><table><tr><td>a</td><td></td><td> b </td></tr></table></p>", "a, , b"),
        ("Level:", "<p>no cells</p>", "N/A"),
        ("Level:", "", "N/A"),
        ("Targeted Degrees and Disciplines:", "<p><ul><li>a</li><li>b <b>c</b></li></ul></p>", "a\nbc"),
        ("Targeted Degrees and Disciplines:", "<p></p>", "N/A"),
        ("Additional Information:", "<p><table><tr><td>a</td><td> </td><td>b</td></tr></table></p>", "a\nb"),
        ("Additional Information:", "<p>text</p>", "N/A"),
        ("Other:", "<p> a <b> b </b></p>", "a\nb"),
    ],
)
def test_first_part(spark, label, inside, wanted):
    key = label.rstrip(":").lower().replace(" ", "_")
    assert details(spark, SECTION.format(label, inside))[0] == [(key, wanted)]


def test_class_must_match_as_a_word(spark):
    html = SECTION.replace("tag__key-value-list", "tag__key-value-list-x").format("A:", "<p>1</p>")
    assert details(spark, html)[0] == []


def rows(spark, body, url="u"):
    html = f"<table><thead><tr class='table__row--body'><td>no</td></tr></thead><tbody>{body}</tbody></table>"
    return M.list_rows(spark.createDataFrame([(url, html)], "url string, html string"))


CELLS = "".join(f"<td>{c}</td>" for c in "cdefgh")


def test_rows_need_body_class_cells_and_link(spark):
    link, plain = "<td><a href='x'>T &amp; U</a> more</td>", "<td>T</td>"
    body = (
        f"<tr class='a table__row--body b'><td>1</td>{link}{CELLS}</tr>"
        f"<tr class='table__row--body2'><td>2</td>{link}{CELLS}</tr>"
        f"<tr class='table__row--body'><td>3</td>{plain}{CELLS}</tr>"
        f"<tr class='table__row--body'><td>4</td>{link}</tr>"
        f"<tr class='table__row--body'><th>Job 1 no. 5</th>{link}<td>unread</td>{CELLS}</tr>"
    )
    got = [(r.id, r.title, r.company, r.deadline) for r in M.list_rows_full(rows(spark, body)).collect()]
    assert got == [("1", "T & U", "c", "h"), ("5", "T & U", "c", "h")]


def test_layout_by_url(spark):
    body = f"<tr class='table__row--body'><th>9</th><td>1</td><td><a>T</a></td>{CELLS}</tr>"
    full = rows(spark, body, "https://x/myAccount/co-op/full/jobs.htm")
    direct = rows(spark, body, "https://x/myAccount/co-op/direct/jobs.htm?p=1")
    got = M.list_rows_dispatch(full.unionByName(direct)).collect()
    assert [(r.id, r.title) for r in got] == [("1", "T")]  # the full layout wants the link in cell 0
    missing = rows(spark, body).withColumn("url", F.lit(None).cast("string"))
    assert M.list_rows_dispatch(missing).count() == 0


def test_tokens_keep_order_and_drop_hidden_text(spark):
    html = "<!DOCTYPE html><p CLASS=x>a<script>var t='</p>'</script><br/>b</P> 1 < 2"
    got = M.html_tokens(spark.createDataFrame([(1, html)], "page_id bigint, html string")).orderBy("pos")
    assert [(r.tag, r.raw) for r in got.collect()] == [
        ("", "<!DOCTYPE html>"), ("p", "<p CLASS=x>"), ("", "a"), ("br", "<br/>"), ("", "b"), ("/p", "</P>"),
        ("", " 1 "), ("", "<"), ("", " 2"),
    ]


def test_tables_in_cells_end_no_row(spark):
    inner = "<table><tbody><tr><td>in</td></tr></tbody></table>"
    link = "<td><a href='x' title='>'>T</a></td>"
    row = f"<tr class='table__row--body'><td>1</td>{link}<td>c{inner}</td><td>{inner}{inner}</td>{CELLS}</tr>"
    got = M.list_rows_full(rows(spark, row + row.replace(">1<", ">2<"))).collect()
    assert [(r.id, r.title, r.company, r.openings) for r in got] == [("1", "T", "c\nin", "c"), ("2", "T", "c\nin", "c")]


def test_rows_in_a_table_for_layout(spark):
    link = "<td><a>T</a></td>"
    body = f"<tr class='table__row--body'><td>1</td>{link}{CELLS}</tr>"
    html = f"<table><tr><td><table><tbody>{body}</tbody></table></td></tr></table>"
    found = M.list_rows_full(M.list_rows(spark.createDataFrame([("u", html)], "url string, html string")))
    assert [r.id for r in found.collect()] == ["1"]


def test_a_tag_with_thousands_of_attributes(spark):
    many = " ".join(f'a{i}="{i} > 0"' for i in range(20_000))
    html = f"<div {many}>x</div><tr {many}>"
    frame = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    assert M.html_tokens(frame).count() == 4
    assert frame.select(F.expr(M.rendered_text_sql("html")).alias("y")).first().y == "x"
    page = spark.createDataFrame([("u", f"<tbody><tr {many} class='table__row--body'><td>1</td></tr></tbody>")], "url string, html string")
    assert [len(r.cells) for r in M.list_rows(page).collect()] == [1]
