"""Queries for the remaining operators of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import agreements, classify, lookup, merge, ordered, rates
from lexmill.plans import sql
from lexmill.plans.documents import RULES, topic_sql
from lexmill.plans.registry import Tables, query
from lexmill.sources import landing


@query("select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def j05_explicit_keys(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(lookup.dimension(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")


@query("select d.doc_id, l.quality, l.doc_id is not null as found from documents d left join labels l using (doc_id)")
def j09_hash_lookup(t: Tables) -> DataFrame:
    known = t.labels.select("doc_id", "quality", F.lit(True).alias("hit"))
    return t.documents.select("doc_id").join(lookup.dimension(known), "doc_id", "left").select("doc_id", "quality", F.coalesce("hit", F.lit(False)).alias("found"))


@query("select count(r_name) as linked, count(*) - count(r_name) as skipped from customer join nation on c_nationkey = n_nationkey left join (select * from region where r_regionkey <> 2) r on n_regionkey = r_regionkey")
def j11_resolved_keys(t: Tables) -> DataFrame:
    places = t.nation.join(t.region.where("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    joined = t.customer.join(lookup.dimension(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.agg(F.count("r_name").alias("linked"), F.count_if(F.col("r_name").isNull()).alias("skipped"))


@query("select l_orderkey, l_linenumber, l_partkey, s_name from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where n_name = 'NATION_7' or n_nationkey = 7")
def j18_by_union(t: Tables) -> DataFrame:
    chosen = t.supplier.join(lookup.dimension(t.nation.where("n_name = 'NATION_7' or n_nationkey = 7")), F.col("s_nationkey") == F.col("n_nationkey"))
    return t.lineitem.join(lookup.dimension(chosen), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "s_name")


@query("select source, count(*) as total, count(quality) as done, count(*) - count(quality) as pending_done from documents d left join labels l using (doc_id) group by source")
def a03_coverage_by_source(t: Tables) -> DataFrame:
    return lookup.coverage(t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left"), ["source"], {"done": "quality"})


@query("select lang, arg_max(source, (n_chars, source)) as source from documents group by lang")
def a12_arg_max(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.max(F.struct("n_chars", "source")).alias("b")).select("lang", F.col("b.source").alias("source"))


@query("""select doc_id, case when a >= b and a >= c then 'the' when b >= c then 'que' else 'der' end as family from (select doc_id, len(string_split(text, 'the')) - 1 as a, len(string_split(text, 'que')) - 1 as b, len(string_split(text, 'der')) - 1 as c from documents)""")
def a13_best_family(t: Tables) -> DataFrame:
    n = [F.size(text.matches(F.col("text"), p, 0)) for p in ("the", "que", "der")]
    rows = t.documents.select("doc_id", *(c.alias(f"n{k}") for k, c in enumerate(n)))
    return rows.select("doc_id", F.when((F.col("n0") >= F.col("n1")) & (F.col("n0") >= F.col("n2")), "the").when(F.col("n1") >= F.col("n2"), "que").otherwise("der").alias("family"))


@query("""with e as (select event_id, user_id, event_type, nullif(cast(props->>'$.k' as bigint) % 4, 0) as chapter from events), c as (select *, last_value(chapter ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as seen from e)
select event_id, event_type, seen from (select *, row_number() over (partition by user_id, seen, event_type order by event_id) as rn from c) where rn = 1""")
def i03_nearest_and_first(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select("event_id", "user_id", "event_type", F.nullif(k % 4, F.lit(0)).alias("chapter"))
    seen = ordered.carry_forward(rows, ["user_id"], ["event_id"], F.col("chapter"), "seen")
    return ordered.first_wins(seen, ["user_id", "seen", "event_type"], [F.col("event_id")]).select("event_id", "event_type", "seen")


@query(r"""select a.o_orderkey, a.o_custkey, cast(row_number() over (partition by a.o_custkey order by a.o_orderpriority desc, a.o_orderkey) as int) as place from orders a""")
def o01_by_relevance(t: Tables) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderpriority"), "o_orderkey")
    return t.orders.select("o_orderkey", "o_custkey", F.row_number().over(order).alias("place"))


@query("select doc_id, lang, source from documents where nullif(lang, 'es') is null or source < 'src12' order by nullif(lang, 'es') nulls last, source, doc_id")
def o05_nulls_last(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source").where(F.nullif("lang", F.lit("es")).isNull() | (F.col("source") < "src12"))
    return rows.orderBy(F.asc_nulls_last(F.nullif("lang", F.lit("es"))), "source", "doc_id")


@query("select o_orderkey as id, 'order' as kind from orders where o_orderstatus = 'F' union all select l_orderkey, 'line' from lineitem where l_returnflag = 'R' union all select c_custkey, 'customer' from customer")
def u02_union_of_extracts(t: Tables) -> DataFrame:
    each = [t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind")), t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", F.lit("line")), t.customer.select("c_custkey", F.lit("customer"))]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def u04_difference(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""with g(grp, src) as (values ('x', 'src1'), ('x', 'src2'), ('y', 'src3')) select e.event_id, count(d.doc_id) as n from (select event_id, case event_type when 'click' then 'x' when 'view' then 'y' end as grp from events) e
left join documents d on (e.grp is null or d.source in (select src from g where g.grp = e.grp)) group by e.event_id""")
def c06_sector_filter(t: Tables) -> DataFrame:
    groups = t.spark.createDataFrame([("x", "src1"), ("x", "src2"), ("y", "src3")], "grp string, source string")
    asked = t.events.select("event_id", F.when(F.col("event_type") == "click", "x").when(F.col("event_type") == "view", "y").alias("grp"))
    docs = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per_group = groups.join(docs, "source").groupBy("grp").agg(F.sum("n").alias("n"))
    everyone = docs.agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("grp"), "n")
    return lookup.null_safe_join(asked, per_group.unionByName(everyone), ["grp"]).select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with t as ({topic_sql('text')}) select coalesce(topic, 'none') as topic, count(*) as n, min(doc_id) as first_doc from documents d left join t using (doc_id) group by 1")
def c08_topic_page(t: Tables) -> DataFrame:
    topics = t.documents.select("doc_id", F.coalesce(classify.topic_of(F.col("text"), RULES), F.lit("none")).alias("topic"))
    return topics.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""select c_custkey, 'Agreement of ' || c_mktsegment as name, (2020 + c_nationkey % 3) || '-02-01' as first, (2024 + c_nationkey % 3) || '-01-31' as last from customer""")
def c14_metadata(t: Tables) -> DataFrame:
    y = F.col("c_nationkey") % 3
    header = F.concat(F.lit("Agreement of Agreement of \n12 pages\n"), F.col("c_mktsegment"), F.lit("\n1.1.2023–31.12.2023\nISBN 1\n1.2."), y + 2020, F.lit(" – 31.1."), y + 2024, F.lit("\n1 § Scope"))
    rows = t.customer.select("c_custkey", F.regexp_replace(header, "Agreement of Agreement of ", "Agreement of").alias("h"))
    period = agreements.validity_period(F.col("h"))
    return rows.select("c_custkey", agreements.agreement_name(F.col("h"), ["valid"]).alias("name"), period["first"].alias("first"), period["last"].alias("last"))


C16_HTML = "concat('<h3>§ ', page_id, ' Scope</h3><div>', html, '</div><h2>2 § Pay</h2><p>', repeat('pay ', 40), '</p>')"
C16_HEAD = r"(tag = 'h3' and contains(text, '§')) or (tag in ('h2', 'h3', 'h4', 'h5', 'h6') and length(text) < 150 and regexp_matches(text, '^\d+\s*§'))"


@query(sql.sections("page_id", sql.blocks("html", "page_id", f"(select page_id, {C16_HTML} as html from pages)"), C16_HEAD, 80))
def c16_html_clauses(t: Tables) -> DataFrame:
    return landing.agreement_clauses(t.pages.select("page_id", F.expr(C16_HTML).alias("html")), "page_id")


#: Chapter pages: every third has no header with a section sign but its h1.
C17_HTML = """concat('<h1>', page_id, ' § Whole</h1><nav><h2>9 § Menu</h2></nav><div id="x" class="tes content-main">', case when page_id % 3 = 0 then '<h2>Plain</h2>' else '<h2>1 § <b>Scope</b> &amp; aim</h2>' end, '<p>', repeat('One line. ', cast(page_id % 12 as int)), '</p><div><p>two  two</p></div><table><tr><th>a</th><th>b</th></tr><tr><td>', page_id, '</td></tr><tr><td>x</td><td>y</td><td>z</td></tr></table>',
case when page_id % 3 = 0 then '' else '<h2>Unsigned</h2><p>back to top</p><h2>Pay § rates</h2>' end, '<pre>', repeat('pay ', cast(page_id % 40 as int)), '</pre></div><footer><p>end</p></footer>')"""
C17_FIRST = "array_to_string(list_filter([trim(repeat('One line. ', cast(page_id % 12 as int))), 'two two'], lambda x: x <> ''), chr(10) || chr(10)) || chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' |  |' || chr(10) || '| x | y |'"
C17_PAY = "trim(repeat('pay ', cast(page_id % 40 as int)))"
GAP = "chr(10) || chr(10)"


@query(f"""with c as (select page_id, 0 as ord, '§ 1' as section, 'Scope & aim' as title, {C17_FIRST} || {GAP} || 'Unsigned' || {GAP} as body from pages where page_id % 3 <> 0 union all select page_id, 1, '§ ?', 'Pay § rates', {C17_PAY} from pages where page_id % 3 <> 0
union all select page_id, 0, '§ ' || page_id, 'Whole', 'Plain' || {GAP} || {C17_FIRST} || case when {C17_PAY} <> '' then {GAP} || {C17_PAY} else '' end from pages where page_id % 3 = 0) select page_id, ord, section, title, {sql.strip("body")} as body from c where length(case when section = '§ 1' then body || 'back to top' else body end) >= 80""")
def c17_chapter_clauses(t: Tables) -> DataFrame:
    return landing.chapter_clauses(t.pages.select("page_id", F.expr(C17_HTML).alias("html")), "page_id", "content", footers=("back to top",))


@query(sql.sections("page_id", sql.blocks("html", "page_id", "(select page_id, '<h2>' || url || '</h2>' || replace(html, 'h1>', 'h2>') as html from pages)"), "tag = 'h2'", 80))
def c17_h2_sections(t: Tables) -> DataFrame:
    body = F.concat(F.lit("<h2>"), F.col("url"), F.lit("</h2>"), F.regexp_replace("html", "h1>", "h2>"))
    return landing.page_sections(t.pages.select("page_id", body.alias("html")), "page_id", "h2", 80)


@query("""with o as (select source as topic, lang as url, text from documents join labels using (doc_id)), n as (select distinct source as topic, lang as url, substring(text, 1, 50) as head from documents)
select n.topic, n.url, n.head, exists (select 1 from o where o.topic = n.topic and o.url = n.url and contains(o.text, n.head)) as present from n""")
def w03_match_by_prefix(t: Tables) -> DataFrame:
    keys = [F.col("source").alias("topic"), F.col("lang").alias("url")]
    # the item of a head is the head itself, with its topic and link
    old = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *keys, F.col("text").alias("old_text"))
    new = t.documents.select(*keys, F.substring("text", 1, 50).alias("head")).distinct()
    asked = new.select(F.struct("topic", "url", "head").alias("item"), "*")
    hit = lookup.containing(old, "doc_id", "old_text", asked, "item", "head", ("topic", "url")).select("item.*").distinct().withColumn("hit", F.lit(True))
    return new.join(hit, ["topic", "url", "head"], "left").select("topic", "url", "head", F.coalesce("hit", F.lit(False)).alias("present"))


@query("select l_orderkey, l_linenumber, l_partkey, strftime(coalesce(case when l_linenumber > 2 then l_shipdate end, o_orderdate), '%Y-%m-%d') as since from lineitem join orders on l_orderkey = o_orderkey")
def w06_injected_start(t: Tables) -> DataFrame:
    found = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") > 2, F.to_date("l_shipdate")).alias("effective_from"))
    agreed = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("valid_from"))
    dated = rates.with_start(found, agreed, "o_orderkey")
    return dated.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", F.col("effective_from").cast("string").alias("since"))


@query("select conv_id, turn, role from conversations where conv_id not in (select conv_id from conversations where role = 'system') union all select conv_id, turn, 'new' from conversations where conv_id in (select conv_id from conversations where role = 'system') and role <> 'assistant'")
def w07_replace_children(t: Tables) -> DataFrame:
    old = t.conversations.select("conv_id", "turn", "role")
    new = t.conversations.where("role <> 'assistant'").select("conv_id", "turn", F.lit("new").alias("role"))
    changed = t.conversations.where("role = 'system'").select("conv_id").distinct()
    return merge.replace_children(old, new, changed, ["conv_id"])


@query("select r_regionkey, case when r_regionkey in (1, 2) then 'SEED ' || r_regionkey else r_name end as r_name from region union all select 77, 'SEED 77'")
def w08_seed(t: Tables) -> DataFrame:
    seed = t.spark.createDataFrame([(1, "SEED 1"), (2, "SEED 2"), (77, "SEED 77")], "r_regionkey int, r_name string").withColumn("h", F.md5("r_name"))
    return merge.upsert(t.region.withColumn("h", F.md5("r_name")), seed, ["r_regionkey"], "h").select("r_regionkey", "r_name")


@query("select count(*) filter (n_chars >= 200) as success, count(*) filter (n_chars < 200) as errors from documents where doc_id not in (select doc_id from labels)")
def w10_pending(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels.select("doc_id", F.lit(True).alias("is_parsed")), "doc_id", "left").withColumn("is_parsed", F.coalesce("is_parsed", F.lit(False)))
    return agreements.pending(rows, lambda df: df.withColumn("error", F.when(F.col("n_chars") < 200, "too short")))[1]


def _rates(topic: str, clause):
    def run(t: Tables) -> DataFrame:
        return rates.extract(t.documents.select("doc_id", clause().alias("text")), topic).select("doc_id", "rate_type", "context", (F.col("value") * 100).cast("long").alias("cents"), "unit")

    return run


N = "cast(doc_id % 9 + 1 as varchar)"
query(f"select doc_id, 'min_wage' as rate_type, 'harjoittelija' as context, (doc_id % 9 + 1) * 100000 + 24650 as cents, 'eur_month' as unit from documents", name="x01_min_wage")(
    _rates("min_wage", lambda: F.concat(F.lit("Palkka 1.6.2023 alkaen "), F.col("doc_id") % 9 + 1, F.lit(" 246,50 euroa")))
)
query("""select doc_id, unnest(['overtime_rate_tier1_hours', 'overtime_rate_tier1_pct', 'overtime_rate_tier2_pct']) as rate_type, 'vuorokautinen' as context, unnest([(doc_id % 9 + 1) * 100, 5000, 10000]) as cents, unnest(['hours', 'pct', 'pct']) as unit from documents""", name="x03_overtime")(
    _rates("overtime", lambda: F.concat(F.lit("1 mom. Vuorokautinen ylityö\n"), F.col("doc_id") % 9 + 1, F.lit(" ensimmäiseltä tunnilta 50 %:lla ja seuraavilta 100 %:lla")))
)
query("select doc_id, 'night_sunday_rate_pct' as rate_type, 'sunnuntai' as context, (doc_id % 9 + 1) * 100 as cents, 'pct' as unit from documents", name="x09_night_sunday")(
    _rates("night_and_sunday_work", lambda: F.concat(F.lit("1 mom. Sunnuntaityö\n"), F.col("doc_id") % 9 + 1, F.lit(" prosentin lisä\n2 mom. Muu\n50 %")))
)
query("""select doc_id, 'annual_leave_days' as rate_type, 'taulukko' || (k // 12 + 1) || '_m' || lpad(cast(k % 12 + 1 as varchar), 2, '0') as context, (doc_id % 9 + 1 + k % 12) * 100 as cents, 'days' as unit from documents, range(36) r(k)""", name="x22_leave_tables")(
    _rates("annual_leave", lambda: F.concat(*[x for k in range(3) for x in (F.lit("Vuosilomapäivät "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("doc_id") % 9 + 1 + i).cast("string")), " "), F.lit(" loppu. "))]))
)


@query(r"select doc_id, 1 as chapter, 'General' as chapter_title, cast(doc_id as int) as section, 'Scope' as section_title, 0 as order_index, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents where trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''")
def s03_statutes(t: Tables) -> DataFrame:
    xml = F.concat(F.lit('<akn:act xmlns:akn="u" dateProduced="2024-01-02"><akn:chapter><akn:num>1 luku</akn:num><akn:heading>General</akn:heading><akn:section><akn:num>'), F.col("doc_id"), F.lit(" §</akn:num><akn:heading>Scope</akn:heading><akn:p>"), text.html_escape(F.col("text")), F.lit("</akn:p></akn:section></akn:chapter></akn:act>"))
    return landing.statute_paragraphs(t.documents.select("doc_id", xml.alias("xml")), "doc_id")


@query(f"with p as (select page_id, url, {sql.plain('html')} as answer from pages) select page_id, 0 as ord, {sql.plain('url')} as question, answer from p where length(answer) >= 50")
def s08_faq(t: Tables) -> DataFrame:
    html = F.concat(F.lit("<details><summary>"), F.col("url"), F.lit("</summary>"), F.col("html"), F.lit("</details>"))
    return landing.faq_pairs(t.pages.select("page_id", html.alias("html")), "page_id")


@query(f"""with l as ({sql.links("html", "page_id", "url", "pages")}), k as (select * from l where contains(href, 'http') and contains(href, '.') and rtrim(href, '/') <> 'https://example.com' and not contains(href, 'login'))
select page_id, ord, href, text from (select *, row_number() over (partition by href order by page_id, ord) as rn from k) where rn = 1""")
def s09_discovery(t: Tables) -> DataFrame:
    return landing.discover(t.pages, {"marker": "http", "domain": ".", "catalog_url": "https://example.com", "excluded": ["login"]})


#: A catalogue page for each page with links to versions, and a version page with its title and its links.
S10_CATALOGUE = "concat('<a href=\"/sopimukset/a', page_id % 7, '/', 2020 + page_id % 4, '-', 2024 + page_id % 4, '\">one</a><a href=\"/sopimukset/a', page_id % 7, '\">no</a><a href=\"/sopimukset/a', page_id % 7, '/', 2020 + page_id % 4, '-', 2024 + page_id % 4, '\">again</a>')"
S10_PATTERN = r"^https://www\.example\.com/sopimukset/([^/]+)/(20\d{2}-20\d{2})$"


@query("""select page_id, ord, slug, period, href from (select *, row_number() over (partition by slug, period order by page_id, ord) as rn from (select page_id, unnest([0, 2]) as ord, 'a' || (page_id % 7) as slug, (2020 + page_id % 4) || '-' || (2024 + page_id % 4) as period, 'https://www.example.com/sopimukset/a' || (page_id % 7) || '/' || (2020 + page_id % 4) || '-' || (2024 + page_id % 4) as href from pages)) where rn = 1""")
def s10_version_links(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.lit("https://www.example.com/sopimukset").alias("url"), F.expr(S10_CATALOGUE).alias("html"))
    return landing.version_links(pages, "page_id", "url", S10_PATTERN)


S10_VERSION = "concat('<head><meta property=\"og:title\" content=\"', case when page_id % 4 = 0 then concat('Aa ', 2020 + page_id % 5, '–', 2023 + page_id % 5) when page_id % 4 = 1 then concat('Bb, voimassa 1.', page_id % 12 + 1, '.2025 lukien') else 'Cc? dd' end, ' – Sähköinen Sopimuskirja &gt;\"></head><a href=\"/x\">x</a>', case when page_id % 5 <> 0 then concat('<a href=\"/k/', page_id, '/kokoteksti\">all</a><a href=\"/other/kokoteksti\">o</a>') else '' end)"


@query("""select page_id, case when page_id % 4 = 0 then concat('Aa ', 2020 + page_id % 5, '-', 2023 + page_id % 5) when page_id % 4 = 1 then concat('Bb, voimassa 1.', page_id % 12 + 1, '.2025 lukien') else 'Cc- dd' end as name, 'https://www.example.com/k/' || page_id || '/kokoteksti' as full_url,
case when page_id % 4 = 0 then concat(2020 + page_id % 5, '-01-01') when page_id % 4 = 1 then '2025-' || lpad(cast(page_id % 12 + 1 as varchar), 2, '0') || '-01' else '2022-01-01' end as first, case when page_id % 4 = 0 then concat(2023 + page_id % 5, '-12-31') else '2026-12-31' end as last, case when page_id % 2 = 0 then 'Listed' else 'Slug one' end as sector from pages where page_id % 5 <> 0""")
def s10_version_pages(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.lit("https://www.example.com/v").alias("url"), F.expr(S10_VERSION).alias("html"), F.when(F.col("page_id") % 2 == 0, "slug-two").otherwise("slug-one").alias("slug"), F.lit("2022-2026").alias("period"))
    found = landing.version_pages(pages, "page_id", "url", "slug", "period", "/kokoteksti", "sähköinen sopimuskirja", {"slug-two": "Listed"})
    return found.select("page_id", "name", "full_url", F.col("valid_from").cast("string").alias("first"), F.col("valid_until").cast("string").alias("last"), "sector")


S11_INDEX = "concat('<h1>Name  of ', page_id, '</h1><p>In force 1.', page_id % 12 + 1, '.2024 – 31.', case when page_id % 2 = 0 then '2' else '1' end, '.2026</p>', case when page_id % 3 <> 0 then '<a href=\"/tes/taysi/one/\">1</a><a href=\"/tes/other/\">o</a><a href=\"/tes/taysi/two/\">2</a><a href=\"/tes/taysi/one/\">1</a>' else '' end)"


@query("""select page_id, 'agreement-' || page_id as agreement, 'Name of ' || page_id as name, '2024-' || lpad(cast(page_id % 12 + 1 as varchar), 2, '0') || '-01' as first, case when page_id % 2 <> 0 then '2026-01-31' end as last, unnest([0, 2]) as ord, unnest(['https://www.example.com/tes/taysi/one/', 'https://www.example.com/tes/taysi/two/']) as href from pages where page_id % 3 <> 0""")
def s11_chapter_pages(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.concat(F.lit("https://www.example.com/tes/agreement-"), F.col("page_id"), F.lit("/")).alias("url"), F.expr(S11_INDEX).alias("html"))
    found = landing.chapter_pages(pages, "page_id", "url", "/taysi/")
    return found.select("page_id", "agreement", "name", F.col("valid_from").cast("string").alias("first"), F.col("valid_until").cast("string").alias("last"), "ord", "href")
