"""Discovery with cycles, sweeps with broken documents, guidance and seeds run twice, pages by key."""

from pyspark.sql import functions as F

from lexmill.operators import lookup, merge, situation
from lexmill.sources import discovery, sweep


def test_links_are_followed_once_and_within_the_bound(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", None), (None, "z"), ("a", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "url string")
    depth = lambda steps: {r.url: r.depth for r in discovery.reached(links, seeds, steps).collect()}
    assert depth(0) == {"a": 0}
    assert depth(2) == {"a": 0, "b": 1, "c": 1, "d": 2}
    found = discovery.reached(links, seeds, 50)
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert discovery.reached(links.limit(0), seeds, 5).count() == 1 and discovery.reached(links, seeds.limit(0), 5).count() == 0


def test_a_site_with_pages_that_did_not_land(spark):
    config = {"marker": "/p/", "domain": "s.x", "catalog_url": "https://s.x/p/0"}
    page = lambda k, html: (k, f"https://s.x/p/{k}", html)
    pages = spark.createDataFrame([page(0, "<a href='/p/1'>1</a><a href='/p/2'>2</a><a href='/d/0.pdf'>d</a>"), page(1, "<a href='/p/0'>up</a>"), (9, "https://s.x/p/1", "<a href='/p/7'>a second landing</a>"), (5, None, "x"), page(6, None)], "page_id int, url string, html string")
    got = sorted((r.url[-1], r.depth, r.landed, r.href) for r in discovery.discover_site(pages, config).collect())
    assert got == [("0", 0, True, "https://s.x/d/0.pdf"), ("1", 1, True, None), ("2", 1, False, None)]
    every = discovery.discover_site(pages, config | {"strategy": "all_pdfs"}).where("href is not null")
    assert [r.href for r in every.collect()] == ["https://s.x/d/0.pdf"]


def test_one_broken_document_costs_only_itself(spark):
    landed = spark.createDataFrame([(1, "12"), (2, "x"), (3, None), (4, "bad 1"), (4, "7")], "k int, body string")
    swept = sweep.sweep(landed, "k", "body", {"bad": F.col("body").startswith("bad"), "never": F.lit(None).cast("boolean")}, {"n": F.expr("try_cast(body as int)")}, ["n"])
    assert sorted((r.k, r.n, r.error) for r in swept.collect() if r.n) == [(1, 12, None), (4, 7, None)]
    good, errors = sweep.split(swept)
    assert sorted((r.k, r.error) for r in errors.collect()) == [(2, "no n"), (3, "nothing landed"), (4, "bad")]
    assert {r.error: r.n for r in sweep.outcome(swept).collect()} == {None: 2, "no n": 1, "nothing landed": 1, "bad": 1}
    assert sweep.to_try_again(landed, "k", "body", good, errors).count() == 0  # nothing has changed
    assert sorted(r.k for r in sweep.to_try_again(landed, "k", "body", good, errors, same=True).collect()) == [2, 3]
    later = spark.createDataFrame([(2, "5"), (3, None), (9, "1")], "k int, body string")
    assert sorted(r.k for r in sweep.to_try_again(later, "k", "body", good, errors).collect()) == [2, 9]


def test_a_guidance_sweep_run_twice(spark):
    kind = "topic string, source string, url string, title string, text string, hash string"
    old = spark.createDataFrame([("a", "s", "u", "t", "old", "h0", "done"), ("z", "s", "u", "t", "old", "h0", "done")], f"{kind}, text_en string")
    pages = spark.createDataFrame([("a", "s", "u1", "t1", "new", "h1"), ("b", "s", "u2", "t2", "new", "h2"), ("c", "s", "u", "t", "  ", "h"), ("nowhere", "s", "u", "t", "x", "h"), (None, "s", "u", "t", "x", "h")], kind)
    topics = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "topic string")
    found = merge.sweep_guidance(old, pages, topics)
    assert sorted((str(r.topic), r.text, r.text_en, r.status) for r in found.collect()) == [("None", "x", None, "unknown_topic"), ("a", "new", None, "updated"), ("b", "new", None, "created"), ("c", "  ", None, "empty"), ("nowhere", "x", None, "unknown_topic"), ("z", "old", "done", "absent")]
    stored = found.where("status not in ('unknown_topic', 'empty')").drop("status")
    again = {r.topic: r.status for r in merge.sweep_guidance(stored, pages, topics).collect() if r.status not in ("unknown_topic", "empty")}
    assert again == {"a": "skipped", "b": "skipped", "z": "absent"}


def test_seeding_twice_changes_nothing(spark):
    sections = spark.createDataFrame([(1, "x", 1, 1), (2, "x", None, 1), (3, "y", 1, 2)], "section_id int, act string, chapter int, section int")
    links = spark.createDataFrame([("t", 1, 5), ("t", 3, 1)], "topic string, section_id int, relevance int")
    seeds = spark.createDataFrame([("t", "x", 1, 1, 9), ("t", "x", None, 1, 2), ("t", "x", None, 1, 3), ("t", "x", 2, 1, 7)], "topic string, act string, chapter int, section int, relevance int")
    got = merge.seed_links(links, seeds, sections)
    assert sorted(map(tuple, got.collect()), key=str) == [("t", 1, 9, "updated"), ("t", 2, 3, "created"), ("t", 3, 1, "kept"), ("t", None, 7, "missing")]
    again = merge.seed_links(got.where("section_id is not null").drop("status"), seeds, sections)
    assert {r.status for r in again.collect()} == {"unchanged", "kept", "missing"}


def test_pages_by_number_and_by_key(spark):
    rows = spark.createDataFrame([(k // 3, k) for k in range(25)], "a int, b int")
    order = [F.col("a"), F.col("b")]
    by_number = [r.b for n in range(4) for r in lookup.page(rows, order, 10, n).collect()]
    assert by_number == [*range(25), 20, 21, 22, 23, 24] and lookup.page(rows.limit(0), order, 10, 3).count() == 0
    last, got = None, []
    while part := lookup.page_after(rows, ["a", "b"], last, 10).collect():
        got += [r.b for r in part]
        last = tuple(part[-1])
    assert got == list(range(25))
    assert "Exchange rangepartitioning" not in lookup.page(rows, order, 10, 1)._jdf.queryExecution().executedPlan().toString()


def test_answers_as_json(spark):
    rows = spark.createDataFrame([(1, None, [("x", None)])], "k int, name string, parts array<struct<a:string,b:int>>")
    assert situation.as_json(rows, "k").first().body == '{"k":1,"name":null,"parts":[{"a":"x","b":null}]}'
