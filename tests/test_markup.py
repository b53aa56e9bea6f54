"""Markup: nested blocks, ends that are missing or match nothing, containers, references over the tree."""

from pyspark.sql import functions as F

from lexmill.sources import landing, markup


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "k int, html string")


def blocks(spark, html):
    return [(r.tag, r.text) for r in markup.html_blocks(pages(spark, html), "k").orderBy("ord").collect()]


def test_text_around_nested_blocks_is_kept(spark):
    assert blocks(spark, "<li>a<ul><li>inner</li></ul> tail</li>") == [("li", "a"), ("li", "inner"), ("li", "tail")]
    assert blocks(spark, "<div>bare <b>text</b><p>p</p>rest</div>") == [("div", "bare text"), ("p", "p"), ("div", "rest")]
    assert blocks(spark, "<table><tr><td>c<p>d</p>e<td>f<tr><th>g</table>h") == [("td", "c"), ("p", "d"), ("td", "e"), ("td", "f"), ("th", "g"), ("", "h")]


def test_ends_that_are_missing_or_match_nothing(spark):
    assert blocks(spark, "<ul><li>1<li>2<ul><li>3</ul>4</ul></div>5") == [("li", "1"), ("li", "2"), ("li", "3"), ("li", "4"), ("", "5")]
    assert blocks(spark, "<div><p>a<p>b<div>c</div>d") == [("p", "a"), ("p", "b"), ("div", "c"), ("div", "d")]
    assert blocks(spark, """<DIV class='a>b' title="</div>">x<hr/>y<br>z</DIV ><script>"<p>"</script><!-- <p>no</p> -->w""") == [("div", "x"), ("div", "y z"), ("", "w")]
    assert blocks(spark, None) == blocks(spark, "") == blocks(spark, " <p> </p>") == []


def test_deep_and_long_pages(spark):
    deep = "<div>" * 400 + "core" + "</div>" * 400
    assert blocks(spark, deep) == [("div", "core")]
    many = "".join(f"<p>p{i}" for i in range(3000))
    assert blocks(spark, many) == [("p", f"p{i}") for i in range(3000)]


def test_containers_end_at_their_own_end(spark):
    html = "<div><div class='x'>no</div><div class='content'>a<div>b</div><h2>1 § T</h2>c</div></div><aside>side</aside>"
    rows = pages(spark, html, "<div id=main>m<div>n</div></div>o", "<div class='content'>open", None)
    assert [r[0] for r in rows.select(markup.inner_html(F.col("html"), "class", "content")).collect()] == ["a<div>b</div><h2>1 § T</h2>c", None, "open", None]
    assert [r[0] for r in rows.select(markup.inner_html(F.col("html"), "id", "main")).collect()][1] == "m<div>n</div>"
    assert [r[0] for r in pages(spark, "a<div>b</div>c</div>d<p>e").select(markup.siblings(F.col("html"))).collect()] == ["a<div>b</div>c"]


def test_clauses_do_not_run_into_a_sidebar_or_out_of_their_element(spark):
    html = "<div class='content'><div><h2>1 § One</h2><p>first</p></div><p>apart</p><h2>2 § Two</h2>bare<div>second</div></div><aside>side</aside>"
    rows = landing.chapter_clauses(pages(spark, html), "k", "content", least=1).orderBy("ord").collect()
    assert [(r.section, r.title, r.body) for r in rows] == [("§ 1", "One", "first"), ("§ 2", "Two", "bare second")]


def test_references_of_the_measured_page(spark):
    html = "<li>1 § before</li><li>Act <a href='https://f.x/laki/2019/20190100'>a</a> 2 §</li><li>3 luku 4 § and 5 §</li><li>6 §</li><a href='https://f.x/laki/2001/20010055'>b 7 §</a><li>4 §</li>"
    rows = landing.statute_references(pages(spark, html), "k").orderBy("ord", "section").collect()
    assert [(r.act, r.chapter, r.section) for r in rows] == [("2019/100", 3, 4), ("2019/100", 3, 5), ("2019/100", 3, 6), ("2001/55", 3, 4)]
    assert landing.statute_references(pages(spark, "<li>4 §</li>", None, ""), "k").collect() == []


def test_a_reference_without_a_chapter_goes_if_its_section_came_before(spark):
    html = "<a href='/laki/2001/20010055'>x</a><ul><li>2 luku 3 §</li></ul><ul><li>3 §</li><li>5 §</li></ul><ul><li>4 luku 5 §</li><li>5 §</li></ul>"
    rows = landing.statute_references(pages(spark, html), "k").orderBy("ord", "section").collect()
    assert [(r.chapter, r.section) for r in rows] == [(2, 3), (None, 5), (4, 5)]
