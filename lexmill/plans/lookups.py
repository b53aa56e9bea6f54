"""Queries: filters, joins, nesting, aggregates, ordered computations (F, J, A, I, O, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.values import percent
from lexmill.operators import classify, lookup, ordered
from lexmill.plans.registry import Tables, query

CENTS = "cast(round({0} * 100) as bigint)"


@query("select c_custkey, c_name, c_mktsegment from customer where c_custkey = 42")
def f01_key_lookup(t: Tables) -> DataFrame:
    return lookup.one_row(t.customer, c_custkey=42).select("c_custkey", "c_name", "c_mktsegment")


@query("select o_orderkey, o_totalprice from orders where o_custkey = 7 and o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
def f02_composite_key(t: Tables) -> DataFrame:
    return lookup.all_of(t.orders, o_custkey=7, o_orderstatus="O", o_orderpriority="1-URGENT").select("o_orderkey", "o_totalprice")


@query("select event_id, (value > 50) as is_high from events where (value > 50)")
def f03_flag(t: Tables) -> DataFrame:
    return lookup.optional(t.events.withColumn("is_high", F.col("value") > 50), {"is_high": True}).select("event_id", "is_high")


@query("select c_custkey, c_nationkey from customer where c_mktsegment = 'BUILDING'")
def f04_optional_filters(t: Tables) -> DataFrame:
    return lookup.optional(t.customer, c_mktsegment="BUILDING", c_name="").select("c_custkey", "c_nationkey")


@query("select p_partkey, p_name from part where p_name ilike '%BOLT%'")
def f05_icontains(t: Tables) -> DataFrame:
    return t.part.where(lookup.icontains(F.col("p_name"), "BOLT")).select("p_partkey", "p_name")


@query("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, substring(b.text, 1, 50))")
def f06_prefix_like(t: Tables) -> DataFrame:
    items = t.benchmark.select("item_id", F.substring("text", 1, 50).alias("head"))
    return lookup.containing(t.documents, "doc_id", "text", items, "item_id", "head")


@query("select d.doc_id from documents d left join labels l using (doc_id) where l.quality is null")
def f07_pending_rows(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").where("quality is null").select("doc_id")


@query("select d.doc_id, d.source, l.quality from documents d left join labels l using (doc_id) where l.quality in (0) or d.source = 'src1'")
def f08_in_or_source(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.where(lookup.in_or_source(F.col("quality"), [0], F.col("source"), "src1")).select("doc_id", "source", "quality")


@query("select doc_id, source from documents where source <> 'src0'")
def f09_exclude_source(t: Tables) -> DataFrame:
    return t.documents.where(F.col("source") != "src0").select("doc_id", "source")


@query("select d.doc_id, nullif(l.quality, 0) as q, nullif(l.toxic, 0) as x from documents d left join labels l using (doc_id) where nullif(l.quality, 0) is not null or nullif(l.toxic, 0) is not null")
def f10_or_not_null(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.nullif("quality", F.lit(0)).alias("q"), F.nullif("toxic", F.lit(0)).alias("x"))
    return joined.where(F.col("q").isNotNull() | F.col("x").isNotNull())


@query("select doc_id, lang, source from documents")
def f11_projection(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def f12_date_text(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))


@query("select doc_id, substring(text, 1, 300) as preview, length(text) as n from documents")
def f12_preview(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 300).alias("preview"), F.length("text").cast("long").alias("n"))


@query("select doc_id from documents where length(text) >= 500")
def f13_min_length(t: Tables) -> DataFrame:
    return t.documents.where(F.length("text") >= 500).select("doc_id")


@query(r"""select doc_id, (length(l) < 4 or l like '%?' or contains(l, 'the ') or contains(l, 'que ') or (regexp_matches(l, '^\d+[.)]?\s') and length(l) < 15)) as noise
from (select doc_id, lower(trim(split_part(text, chr(10), 1), ' ')) as l from documents)""")
def f14_noise_title(t: Tables) -> DataFrame:
    title = F.element_at(F.split("text", "\n"), 1)
    return t.documents.select("doc_id", classify.is_noise_title(title, ["the ", "que "]).alias("noise"))


@query("""select page_id, url from pages where contains(url, 'http') and contains(url, '.com') and rtrim(url, '/') <> 'https://example.com'
and len(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/'), lambda x: x <> '')) = 2""")
def f15_url_filter(t: Tables) -> DataFrame:
    return t.pages.where(classify.eligible_url(F.col("url"), "http", ".com", "https://example.com", 2)).select("page_id", "url")


@query("select p_partkey, contains(lower(p_name), 'steel') or contains(lower(p_name), 'bolt') as stopped from part")
def f16_stop_words(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", classify.has_stop_word(F.col("p_name"), ["steel", "bolt"]).alias("stopped"))


@query("select c_custkey, case when trim(c_name) = '' then 'empty' when c_name = 'Customer#000000001' then 'catalogue' when lower(c_name) in ('customer#000000002') then 'generic' end as reason from customer")
def f17_reject_reason(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", classify.reject_reason(F.col("c_name"), "Customer#000000001", ["customer#000000002"]).alias("reason"))


@query("select o_orderkey from orders where o_custkey = 7")
def f19_foreign_key(t: Tables) -> DataFrame:
    return lookup.all_of(t.orders, o_custkey=7).select("o_orderkey")


@query("select d.doc_id from documents d left join labels l using (doc_id) where l.quality is null and length(d.text) > 300")
def f20_review_queue(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.where(F.col("quality").isNull() & (F.length("text") > 300)).select("doc_id")


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
def j01_two_way(t: Tables) -> DataFrame:
    europe = lookup.all_of(t.region, r_name="EUROPE")
    return t.nation.join(lookup.dimension(europe), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j02_three_way(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(lookup.dimension(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("""select o_orderkey, c_custkey, n_name, r_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and o_orderstatus = 'F'""")
def j03_four_way_optional(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(lookup.dimension(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return lookup.optional(joined, r_name="ASIA", o_orderstatus="F", c_mktsegment=None).select("o_orderkey", "c_custkey", "n_name", "r_name")


@query("""select n_name, count(*) as n_lines, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey group by n_name""")
def j04_four_way_aggregate(t: Tables) -> DataFrame:
    buyers = t.customer.join(lookup.dimension(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    # lines are summed per order before they meet the rest, so the widest join carries one row an order
    sums = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), F.sum(F.expr(CENTS.format("l_extendedprice"))).alias("c"))
    joined = t.orders.select("o_orderkey", "o_custkey").join(sums, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.sum("k").alias("n_lines"), F.sum("c").alias("cents"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 3)")
def j06_in_semi(t: Tables) -> DataFrame:
    inside = t.customer.join(lookup.dimension(t.nation.where("n_regionkey = 3")), F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(inside, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select c_custkey from customer c where exists (select 1 from orders where o_custkey = c.c_custkey and o_totalprice > 300000)")
def j07_exists_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""select o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)), '') as lines, count(l_orderkey) as n_lines
from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def j08_nested_ordered(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.expr(CENTS.format("l_extendedprice")).alias("c"))
    nested = lookup.nest(t.orders.select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "c"], "lines")
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"], F.lit(":"), x["l_partkey"])), ",")
    return nested.select("o_orderkey", text.alias("lines"), F.size("lines").cast("long").alias("n_lines"))


@query("""with o as (select md5(text) as h, case when min(quality) = 1 then 'fixed' end as topic from documents join labels using (doc_id) group by text)
select doc_id, case when o.h is not null then o.topic else lang end as topic, o.h is not null as overridden from documents d left join o on o.h = md5(d.text)""")
def j10_override_join(t: Tables) -> DataFrame:
    corrected = t.documents.join(t.labels, "doc_id").groupBy(F.md5("text").alias("h")).agg(F.min("quality").alias("q")).select("h", F.when(F.col("q") == 1, "fixed").alias("topic"), F.lit(True).alias("hit"))
    joined = t.documents.withColumn("h", F.md5("text")).join(corrected, "h", "left")
    return joined.select("doc_id", F.when(F.col("hit"), F.col("topic")).otherwise(F.col("lang")).alias("topic"), F.coalesce("hit", F.lit(False)).alias("overridden"))


@query("select event_id, case event_type when 'click' then 'act' when 'view' then 'look' else 'other' end as kind from events")
def j12_map_default(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([("click", "act"), ("view", "look")], "event_type string, kind string")
    return lookup.with_default(t.events, kinds, "event_type", "kind", "other").select("event_id", "kind")


@query("""select e.event_id, (select max_by(s.event_id, (s.ts, s.event_id)) from events s where s.event_type = 'signup' and s.user_id = e.user_id and s.ts <= e.ts) as last_signup from events e""")
def j13_asof(t: Tables) -> DataFrame:
    marks = t.events.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("signup"))
    return lookup.asof_last(t.events, marks, ["user_id"], "ts", "ts", "signup").select("event_id", "last_signup")


@query("""select a.o_orderkey, count(b.c_custkey) as n from (select o_orderkey, nullif(o_custkey % 50, 0) as k from orders) a
left join (select c_custkey, nullif(c_custkey % 50, 0) as k from customer) b on a.k is not distinct from b.k group by a.o_orderkey""")
def j15_null_safe(t: Tables) -> DataFrame:
    a = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("k"))
    # counted by key first, so no pairs are made
    b = t.customer.groupBy(F.nullif(F.col("c_custkey") % 50, F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return lookup.null_safe_join(a, b, ["k"]).select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("""select cast(c.ord as bigint) as cat, u.topic, u.pos from (values (1, ['click', 'view']), (2, ['purchase', 'signup', 'none'])) c(ord, topics), lateral (select unnest(c.topics) as topic, generate_subscripts(c.topics, 1) - 1 as pos) u
where u.topic in (select distinct event_type from events)""")
def j17_hierarchy(t: Tables) -> DataFrame:
    menu = t.spark.createDataFrame([(1, ["click", "view"]), (2, ["purchase", "signup", "none"])], "cat long, topics array<string>")
    rows = menu.select("cat", F.posexplode("topics").alias("pos", "topic"))
    return rows.join(t.events.select(F.col("event_type").alias("topic")).distinct(), "topic", "left_semi").select("cat", "topic", F.col("pos").cast("long").alias("pos"))


@query("""select lang, count(*) as total, count(quality) as labelled, count(*) - count(quality) as pending_labelled, max(d.doc_id) as latest from documents d left join labels l using (doc_id) group by lang""")
def a01_coverage_by_group(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return lookup.coverage(joined, ["lang"], {"labelled": "quality"}, {"latest": "doc_id"})


@query("""select lang, total, done, cast(case when total > 0 then floor(1000.0 * done / total + 0.5) else 0 end as bigint) as permille
from (select lang, count(*) as total, count(quality) as done from documents d left join labels l using (doc_id) group by lang)""")
def a02_percent(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    counts = lookup.coverage(joined, ["lang"], {"done": "quality"})
    return counts.select("lang", "total", "done", (percent(F.col("done"), F.col("total")) * 10).cast("long").alias("permille"))


@query("select n_nationkey, n_name, n_regionkey, count(*) as n_customers from nation join customer on c_nationkey = n_nationkey where c_acctbal > 0 group by all")
def a04_group_entity(t: Tables) -> DataFrame:
    # counted by key first, so the entity's columns take no part in the shuffle
    counts = t.customer.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    return t.nation.join(counts, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "n_name", "n_regionkey", "n_customers")


@query("select count(*) as n from documents where lang = 'en'")
def a05_count(t: Tables) -> DataFrame:
    return lookup.all_of(t.documents, lang="en").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct source from documents")
def a06_distinct(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct()


@query("select distinct nullif(lang, 'es') as lang, source from documents order by lang nulls last, source")
def a07_distinct_ordered(t: Tables) -> DataFrame:
    return t.documents.select(F.nullif("lang", F.lit("es")).alias("lang"), "source").distinct().orderBy(F.asc_nulls_last("lang"), "source")


@query("""select count(*) filter (s = 'linked') as linked, count(*) filter (s = 'unlinked') as unlinked, count(*) filter (s = 'unchanged') as unchanged from
(select case when lang is not distinct from n then 'unchanged' when n is null then 'unlinked' else 'linked' end as s from (select lang, case when n_chars < 500 then null when n_chars > 2000 then source else lang end as n from documents))""")
def a08_outcome_counts(t: Tables) -> DataFrame:
    moved = t.documents.select("lang", F.when(F.col("n_chars") < 500, F.lit(None)).when(F.col("n_chars") > 2000, F.col("source")).otherwise(F.col("lang")).alias("n"))
    status = F.when(F.col("lang").eqNullSafe(F.col("n")), "unchanged").when(F.col("n").isNull(), "unlinked").otherwise("linked")
    return lookup.outcome_counts(moved.withColumn("s", status), "s", ["linked", "unlinked", "unchanged"])


@query("""select coalesce(lang, 'None') || ' -> ' || coalesce(n, 'None') as transition, count(*) as n from (select lang, case when n_chars < 500 then null when n_chars > 2000 then source else lang end as n from documents)
where lang is distinct from n group by 1""")
def a09_transitions(t: Tables) -> DataFrame:
    moved = t.documents.select("lang", F.when(F.col("n_chars") < 500, F.lit(None)).when(F.col("n_chars") > 2000, F.col("source")).otherwise(F.col("lang")).alias("n"))
    return lookup.transitions(moved, "lang", "n")


@query("select n_nationkey, count(c_custkey) as n_customers from nation left join customer on c_nationkey = n_nationkey group by n_nationkey")
def a10_child_count(t: Tables) -> DataFrame:
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("c_custkey").alias("n"))
    return t.nation.select("n_nationkey").join(counts, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n_customers"))


@query("select o_custkey, span from (select o_custkey, (max(year(o_orderdate)) - min(year(o_orderdate))) * 365 as span from orders group by 1) order by span desc, o_custkey limit 1")
def a11_longest_span(t: Tables) -> DataFrame:
    spans = t.orders.groupBy("o_custkey").agg(((F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate"))) * 365).cast("long").alias("span"))
    return spans.agg(F.max(F.struct("span", (-F.col("o_custkey")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("o_custkey"), F.col("b.span").alias("span"))


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as body from conversations group by conv_id")
def a14_ordered_text(t: Tables) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("body"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) = 3)")
def a15_exactly_n(t: Tables) -> DataFrame:
    return lookup.exactly(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], 3)


@query("select cast(sum(n) as bigint) as n_all from (select conv_id, count(*) as n from conversations group by conv_id)")
def a16_sum_of_counts(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_all"))


@query("""with s as (select *, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as section from conversations)
select conv_id, section, max(case when role = 'user' then text end) as title, coalesce(string_agg(case when role <> 'user' then text end, chr(10) || chr(10) order by turn), '') as body from s where section > 0 group by conv_id, section""")
def i01_sections(t: Tables) -> DataFrame:
    return ordered.sections(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", "text")


@query("""select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as seen from events""")
def i02_carry_forward(t: Tables) -> DataFrame:
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return ordered.carry_forward(t.events, ["user_id"], ["ts", "event_id"], signup, "seen").select("event_id", "seen")


@query("""select event_id, coalesce(lead(event_id) over (partition by user_id order by event_id), -1) as segment_end from events""")
def i05_lead_segments(t: Tables) -> DataFrame:
    return ordered.segments(t.events, ["user_id"], "event_id", F.lit(-1)).select("event_id", "segment_end")


@query("""select user_id, case when count(*) >= 2 then list(event_id order by event_id)[2] else list(event_id order by event_id)[1] end as place from events where event_type = 'purchase' group by user_id""")
def i06_second_or_first(t: Tables) -> DataFrame:
    found = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("f"))
    return found.select("user_id", ordered.second_or_first(F.col("f")).alias("place"))


@query("""select event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is null or p <> event_type""")
def i07_dedupe_consecutive(t: Tables) -> DataFrame:
    return ordered.changes_only(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("""select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as rn from orders) where rn = 1""")
def i08_first_match(t: Tables) -> DataFrame:
    return ordered.first_wins(t.orders, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("select md5(text) as h, min(doc_id) as doc_id from documents group by 1")
def i09_first_wins(t: Tables) -> DataFrame:
    return ordered.first_wins(t.documents.select(F.md5("text").alias("h"), "doc_id"), ["h"], [F.col("doc_id")])


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents), s as (select *, max(case when length(line) > 400 then 1 else 0 end)
over (partition by doc_id order by pos rows unbounded preceding) as stopped from l) select doc_id, pos, line from s where stopped = 0 and pos < 6""")
def i10_take_while(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    return ordered.take_while(lines, ["doc_id"], ["pos"], F.length("line") > 400, 6).select("doc_id", "pos", "line")


@query("select md5(text) as h, max(doc_id) as doc_id from documents group by 1")
def i11_last_wins(t: Tables) -> DataFrame:
    return ordered.first_wins(t.documents.select(F.md5("text").alias("h"), "doc_id"), ["h"], [F.desc("doc_id")])


@query("""select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by o_custkey""")
def o03_latest(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("b")).select("o_custkey", F.col("b.o_orderkey").alias("o_orderkey"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def o04_top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("select p_partkey, p_name from part order by p_name, p_partkey limit 20 offset 40")
def o10_page(t: Tables) -> DataFrame:
    return lookup.page(t.part.select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 20, 2)


@query("""select r_name, 'table' as origin from region union all select v.r_name, 'list' from (values ('ATLANTIS'), ('ASIA'), ('LEMURIA')) v(r_name) where v.r_name not in (select r_name from region)""")
def u01_union_missing(t: Tables) -> DataFrame:
    listed = t.spark.createDataFrame([("ATLANTIS", "list"), ("ASIA", "list"), ("LEMURIA", "list")], "r_name string, origin string")
    return lookup.union_missing(t.region.select("r_name", F.lit("table").alias("origin")), listed, "r_name")


@query("select conv_id as id, text from conversations union all select page_id, url from pages")
def u03_union_all(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("id"), "text").unionByName(t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("text")))
