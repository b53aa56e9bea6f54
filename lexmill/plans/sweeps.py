"""Queries: discovery of a site, sweeps with broken documents, guidance and seeds merged, JSON answers, pages by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import lookup, merge, situation
from lexmill.plans.registry import Tables, query
from lexmill.sources import discovery, landing, sweep

#: A site of 211 pages, as far as they have landed: links in cycles, one to a page that is excluded and one to another site;
#: every third page has PDFs, every fourth a link that is told by its text.
SITE_HTML = """concat('<a href="/p/', (page_id * 2 + 1) % 211, '">a</a><a href="/p/', (page_id + 7) % 211, '">b</a><a href="/p/excluded/1">x</a><a href="https://other.example/p/1">o</a>',
case when page_id % 3 = 0 then concat('<a href="/f/', page_id, '.PDF?v=1">One</a><a href="two.pdf">Two</a>') else '' end, case when page_id % 4 = 0 then '<a href="/open">Read the Agreement here</a>' else '' end)"""
SITE = {"marker": "/p/", "domain": "site.example", "catalog_url": "https://site.example/p/0", "excluded": ["excluded"]}
SITE_SQL = """with recursive l as (select page_id as src, unnest([(page_id * 2 + 1) % 211, (page_id + 7) % 211]) as dst from pages where page_id < 211),
r(id, depth) as (select cast(0 as bigint), 0 union select l.dst, r.depth + 1 from r join l on l.src = r.id where l.dst <> 0 and r.depth < 4), f as (select id, min(depth) as depth from r group by id),
g as (select 'https://site.example/p/' || id as url, cast(depth as int) as depth, id in (select page_id from pages) as landed, id from f)"""


def _site(t: Tables) -> DataFrame:
    return t.pages.where("page_id < 211").select("page_id", F.concat(F.lit("https://site.example/p/"), "page_id").alias("url"), F.expr(SITE_HTML).alias("html"))


@query(f"{SITE_SQL} select url, depth, landed, case when landed and id % 3 = 0 then 'https://site.example/f/' || id || '.PDF?v=1' end as href, case when landed and id % 3 = 0 then 'One' end as text from g")
def s09_site(t: Tables) -> DataFrame:
    return discovery.discover_site(_site(t), SITE, 4)


@query(f"{SITE_SQL} select url, depth, landed, case when landed and id % 4 = 0 then 'https://site.example/open' end as href, case when landed and id % 4 = 0 then 'Read the Agreement here' end as text from g")
def s09_site_by_text(t: Tables) -> DataFrame:
    return discovery.discover_site(_site(t), SITE | {"strategy": "by_text", "link_text": "agreement"}, 4)


@query("select page_id, 2 as ord, 'https://www.example.com/f/' || page_id || '.PDF?v=1' as href, 'One' as text from pages where page_id % 3 = 0")
def s09_first_pdf(t: Tables) -> DataFrame:
    html = F.expr("concat('<a href=\"/x\">no</a><a href=\"/pdf\">no</a>', case when page_id % 3 = 0 then concat('<a href=\"/f/', page_id, '.PDF?v=1\">One</a><a href=\"two.pdf\">Two</a>') else '' end)")
    return landing.discover(t.pages.select("page_id", F.lit("https://www.example.com/c").alias("url"), html.alias("html")), {"strategy": "first_pdf"})


@query("select page_id, 1 as ord, 'https://www.example.com/read/' || page_id as href, 'To the AGREEMENT' as text from pages where page_id % 2 = 0")
def s09_by_text(t: Tables) -> DataFrame:
    html = F.expr("concat('<a href=\"/x\">no</a><a href=\"/read/', page_id, '\">', case when page_id % 2 = 0 then 'To the <b>AGREEMENT</b>' else 'agree' end, '</a>')")
    return landing.discover(t.pages.select("page_id", F.lit("https://www.example.com/c").alias("url"), html.alias("html")), {"strategy": "by_text", "link_text": "the agreement"})


#: Landed pages, some of them broken: nothing there, a PDF, no heading, no such day.
SWEPT_HTML = """case page_id % 10 when 0 then null when 1 then '%PDF-1.7' when 2 then '<p>no head</p>' when 3 then '<h1>T</h1><time>2024-02-31</time>' else concat('<h1>Title ', page_id, '</h1><time>2024-01-', lpad(cast(page_id % 28 + 1 as string), 2, '0'), '</time>', html) end"""
SWEPT_SQL = "'Title ' || page_id as title, '2024-01-' || lpad(cast(page_id % 28 + 1 as varchar), 2, '0') as updated"


def _swept(pages: DataFrame) -> DataFrame:
    title = F.nullif(landing.plain(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)), F.lit(""))
    day = F.regexp_extract("html", r"<time>([^<]*)</time>", 1).try_cast("date")
    return sweep.sweep(pages, "page_id", "html", {"not a page": F.col("html").startswith("%PDF")}, {"title": title, "updated": day}, ["title", "updated"])


@query(f"select page_id, case when error is null then title end as title, case when error is null then updated end as updated, error from (select page_id, {SWEPT_SQL}, case page_id % 10 when 0 then 'nothing landed' when 1 then 'not a page' when 2 then 'no title' when 3 then 'no updated' end as error from pages)")
def s17_sweep(t: Tables) -> DataFrame:
    swept = _swept(t.pages.select("page_id", F.expr(SWEPT_HTML).alias("html")))
    return swept.select("page_id", "title", F.col("updated").cast("string").alias("updated"), "error")


@query(f"select page_id, case when page_id % 10 = 1 then title end as title, case when page_id % 10 = 1 then updated end as updated, case when page_id % 10 = 2 then 'not a page' end as error from (select page_id, {SWEPT_SQL} from pages) where page_id % 10 in (1, 2)")
def s17_sweep_again(t: Tables) -> DataFrame:
    """The second sweep of pages of which some have changed: those that failed and changed, and no others."""
    first = t.pages.select("page_id", F.expr(SWEPT_HTML).alias("html"))
    good, errors = sweep.split(_swept(first))
    mended = F.concat(F.lit("<h1>Title "), "page_id", F.lit("</h1><time>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</time>"))
    second = first.withColumn("html", F.when(F.col("page_id") % 10 == 1, mended).when(F.col("page_id") % 10 == 2, "%PDF-1.4").when(F.col("page_id") % 10 == 5, F.lit("changed, but it went well")).otherwise(F.col("html")))
    return _swept(sweep.to_try_again(second, "page_id", "html", good, errors)).select("page_id", "title", F.col("updated").cast("string").alias("updated"), "error")


@query("""with g as (select source as topic, lang as source, 'u' || lang as url, min(n_chars) as title, md5(min(text)) as hash from documents group by all),
o as (select * from g where topic <> 'src3'), n as (select topic, source, 'new' as url, title, case when source = 'fr' then md5(hash) else hash end as hash, topic = 'src1' and source = 'de' as empty from g where topic <> 'src5'),
k as (select distinct topic from g where topic <> 'src2'), m as (select * from n where topic in (select topic from k) and not empty)
select coalesce(o.topic, m.topic) as topic, coalesce(o.source, m.source) as source, case when m.topic is null or o.hash = m.hash then o.url else m.url end as url, case when m.topic is null or o.hash = m.hash then o.hash else m.hash end as hash,
case when o.topic is not null and (m.topic is null or o.hash = m.hash) then 'done' end as text_en, case when m.topic is null then 'absent' when o.topic is null then 'created' when o.hash = m.hash then 'skipped' else 'updated' end as status from o full join m on o.topic = m.topic and o.source = m.source
union all select topic, source, url, hash, null, case when topic = 'src2' then 'unknown_topic' else 'empty' end from n where topic = 'src2' or empty""")
def w02_guidance_sweep(t: Tables) -> DataFrame:
    found = t.documents.groupBy(F.col("source").alias("topic"), F.col("lang").alias("source")).agg(F.min("n_chars").cast("string").alias("title"), F.md5(F.min("text")).alias("hash")).withColumns({"url": F.concat(F.lit("u"), "source"), "text": F.lit("words")})
    old = found.where("topic <> 'src3'").withColumn("text_en", F.lit("done"))
    none = (F.col("topic") == "src1") & (F.col("source") == "de")
    new = found.where("topic <> 'src5'").withColumns({"url": F.lit("new"), "text": F.when(none, " ").otherwise(F.col("text")), "hash": F.when(F.col("source") == "fr", F.md5("hash")).otherwise(F.col("hash"))})
    topics = t.documents.where("source <> 'src2'").select(F.col("source").alias("topic"))
    return merge.sweep_guidance(old, new, topics).select("topic", "source", "url", "hash", "text_en", "status")


@query("""with s as (select 't' || (c_custkey % 3) as topic, c_custkey as id, c_custkey % 5 as relevance from customer where c_custkey % 4 = 0), l as (select 't' || (c_custkey % 3) as topic, c_custkey as id, c_custkey % 7 as relevance from customer where c_custkey % 2 = 0)
select coalesce(s.topic, l.topic) as topic, coalesce(s.id, l.id) as section_id, coalesce(s.relevance, l.relevance) as relevance, case when l.id is null then 'created' when s.id is null then 'kept' when s.relevance = l.relevance then 'unchanged' else 'updated' end as status from l full join s on s.topic = l.topic and s.id = l.id
union all select 'extra', c_custkey, c_custkey % 5, 'created' from customer where c_custkey % 9 = 1 union all select 'gone', null, c_custkey % 5, 'missing' from customer where c_custkey % 10 = 0""")
def s14_seed_links(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    place = t.customer.select(c.alias("section_id"), F.col("c_mktsegment").alias("act"), F.nullif(F.col("c_nationkey"), F.lit(0)).alias("chapter"), c.alias("section"))
    named = [F.col("act"), F.col("chapter"), F.col("section"), (F.col("section_id") % 5).alias("relevance")]
    own = F.concat(F.lit("t"), F.col("section_id") % 3)
    seeds = place.where("section_id % 4 = 0").select(own.alias("topic"), *named).unionAll(place.where("section_id % 9 = 1").select(F.lit("extra").alias("topic"), *named))
    gone = place.where("section_id % 10 = 0").withColumn("section", -F.col("section") - 1).select(F.lit("gone").alias("topic"), *named)
    links = place.where("section_id % 2 = 0").select(own.alias("topic"), "section_id", (F.col("section_id") % 7).alias("relevance"))
    return merge.seed_links(links, seeds.unionAll(gone), place)


@query("""select r_regionkey, cast(to_json({'r_regionkey': r_regionkey, 'r_name': r_name, 'nations': coalesce(list({'n_nationkey': n_nationkey, 'n_name': n_name, 'note': nullif(n_name, 'FRANCE')} order by n_nationkey) filter (where n_nationkey is not null), [])}) as varchar) as body
from region left join (select * from nation where n_regionkey <> 2) on n_regionkey = r_regionkey group by r_regionkey, r_name""")
def k02_json_answers(t: Tables) -> DataFrame:
    nations = t.nation.where("n_regionkey <> 2").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", "n_name", F.nullif("n_name", F.lit("FRANCE")).alias("note"))
    return situation.as_json(lookup.nest(t.region.select("r_regionkey", "r_name"), nations, "r_regionkey", ["n_nationkey"], "nations"), "r_regionkey")


@query("select p_partkey, replace(replace(upper(p_name[1]) || lower(replace(p_name, ' ', '-')[2:]), 'ee', 'éé'), '-', ' ') as title from (select p_partkey, p_name from part)")
def h_slug_replacements(t: Tables) -> DataFrame:
    slug = F.concat(F.lit("/a/b/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("//"))
    return t.part.select("p_partkey", text.slug_to_title(slug, [("ee", "éé"), ("-", "?")]).alias("title"))


@query("select o_custkey, o_orderkey from orders where (o_custkey, o_orderkey) > (select (o_custkey, o_orderkey) from (select * from orders order by o_custkey, o_orderkey limit 1 offset 99)) order by o_custkey, o_orderkey limit 50")
def o10_page_after(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey")
    last = lookup.page(rows, [F.col("o_custkey"), F.col("o_orderkey")], 1, 99).first()
    return lookup.page_after(rows, ["o_custkey", "o_orderkey"], tuple(last) if last else None, 50)
