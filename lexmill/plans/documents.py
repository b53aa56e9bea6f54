"""Queries: scalar functions, classification, rules, merges, chunks, rates and sources (H, C, W, X, S, UF)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import inference, text, values
from lexmill.operators import chunks, classify, keywords, lookup, merge, ordered, rates, situation
from lexmill.operators.conditions import conditions_of, inputs_of, match_rules
from lexmill.plans import sql
from lexmill.plans.registry import Tables, query
from lexmill.sources import landing

#: Rules for the synthetic documents: short keywords match as words, long ones anywhere.
RULES = [
    classify.Keyword("contract", "the"), classify.Keyword("contract", "oration"), classify.Keyword("contract", "einung"),
    classify.Keyword("leave", "que"), classify.Keyword("leave", "mentation"), classify.Keyword("leave", "erand"),
    classify.Keyword("overtime", "der"), classify.Keyword("overtime", "thhation"), classify.Keyword("overtime", "eauxel"),
    classify.Keyword("wages", "los"), classify.Keyword("wages", "cióndo"), classify.Keyword("wages", "ingthe"),
]

RULES_SQL = "(values " + ", ".join(f"('{r.topic}', '{r.keyword}')" for r in RULES) + ") r(topic, kw)"
HIT_SQL = r"(case when length(kw) >= 6 then contains(lower({0}), kw) else regexp_matches(lower({0}), '(^|[^\p{{L}}\p{{N}}_])' || kw || '([^\p{{L}}\p{{N}}_]|$)') end)"


def topic_sql(expr: str, key: str = "doc_id", source: str = "documents") -> str:
    """(key, topic) of the longest matching keyword, ties to the greatest topic."""
    best = "arg_max(topic, (length(kw), topic))"
    return f"select {key}, {best} as topic from {source} join {RULES_SQL} on {HIT_SQL.format(expr)} group by {key}"


@query(f"with t as ({topic_sql('text')}) select d.lang, t.topic, count(*) as total, count(l.quality) as labelled, count(*) - count(l.quality) as pending_labelled from documents d left join t using (doc_id) left join labels l using (doc_id) group by all")
def c01_topic_coverage(t: Tables) -> DataFrame:
    topics = t.documents.select("doc_id", "lang", classify.topic_of(F.col("text"), RULES).alias("topic"))
    return lookup.coverage(topics.join(t.labels.select("doc_id", "quality"), "doc_id", "left"), ["lang", "topic"], {"labelled": "quality"})


@query(f"with t as ({topic_sql('text')}) select d.doc_id, t.topic from documents d left join t using (doc_id)")
def c01_topic_detect(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", classify.topic_of(F.col("text"), RULES).alias("topic"))


@query(f"with t as ({topic_sql('text')}) select d.doc_id, t.topic from documents d left join t using (doc_id)")
def j14_contains_join(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(r.topic, r.keyword) for r in RULES], "topic string, keyword string")
    return keywords.topic_by_index(t.documents.select("doc_id", "text"), rules, "text", "doc_id")


@query(f"""with a as ({topic_sql("split_part(text, chr(10), 1)")}), b as ({topic_sql("substring(substring(text, length(split_part(text, chr(10), 1)) + 1), 1, 500)")})
select d.doc_id, coalesce(a.topic, b.topic) as topic from documents d left join a using (doc_id) left join b using (doc_id)""")
def c02_title_body(t: Tables) -> DataFrame:
    title = F.element_at(F.split("text", "\n"), 1)
    body = F.substring("text", F.length(title) + 1, F.length("text"))
    return t.documents.select("doc_id", classify.title_then_body(title, body, RULES).alias("topic"))


@query(rf"""with p as (select doc_id, split_part(text, chr(10), 1) as title, text from documents), n as (select doc_id, title, text, (length(l) < 4 or l like '%?' or contains(l, 'the ') or (regexp_matches(l, '^\d+[.)]?\s') and length(l) < 15)) as noise
from (select *, lower(trim(title, ' ')) as l from p)), a as ({topic_sql("title", source="n")}), b as ({topic_sql("substring(text, 1, 1000)")})
select n.doc_id, coalesce(case when not noise then a.topic end, b.topic) as topic from n left join a using (doc_id) left join b using (doc_id)""")
def c03_noise_title(t: Tables) -> DataFrame:
    title = F.element_at(F.split("text", "\n"), 1)
    return t.documents.select("doc_id", classify.title_without_noise(title, F.col("text"), RULES, ["the "]).alias("topic"))


@query(f"""with t as ({topic_sql('text')}), o as (select md5(text) as h, case when min(quality) = 1 then 'wages' end as topic from documents join labels using (doc_id) group by text),
n as (select d.doc_id, d.lang as topic, case when o.h is not null then o.topic else t.topic end as new_topic from documents d left join t using (doc_id) left join o on o.h = md5(d.text))
select doc_id, new_topic, case when new_topic is not null and new_topic = 'overtime' then 'unknown_topic' when new_topic is not distinct from topic then 'unchanged' when new_topic is null then 'unlinked' else 'linked' end as outcome from n""")
def c04_relink(t: Tables) -> DataFrame:
    clauses = t.documents.select("doc_id", F.lit("a").alias("agreement_key"), "text", F.col("lang").alias("topic"))
    fixed = t.documents.join(t.labels, "doc_id").groupBy(F.md5("text").alias("text_hash")).agg(F.min("quality").alias("q")).select(F.lit("a").alias("agreement_key"), "text_hash", F.when(F.col("q") == 1, "wages").alias("topic"))
    known = t.spark.createDataFrame([("contract",), ("leave",), ("wages",)], "topic string")
    return classify.relink(clauses, fixed, RULES, known).select("doc_id", "new_topic", "outcome")


RULE_ROWS = [(1, "click", 5), (2, "click", 9), (3, "view", 1), (4, "view", 1), (5, "purchase", 3), (6, "purchase", 2), (7, "signup", 4)]
CONDITION_ROWS = [(1, "value", "gte", 10.0, None), (1, "k", "lt", 50.0, None), (2, "value", "gt", 80.0, None), (3, "k", "lte", 20.0, None), (4, "k", "gte", 70.0, None), (5, "k", "eq", 7.0, None), (6, "missing", "gt", 0.0, None), (7, "kind", "eq", None, "signup"), (7, "value", "near", 1.0, None)]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


@query(f"""with rules(rule_id, topic, priority) as (values {_values(RULE_ROWS)}), conds(rule_id, field, op, cnum, cstr) as (values {_values(CONDITION_ROWS)}),
req as (select event_id, event_type, value, cast(props->>'$.k' as double) as k from events),
inp as (select event_id, 'value' as field, value as num, null::varchar as str from req union all select event_id, 'k', k, null from req union all select event_id, 'kind', null, event_type from req),
s as (select q.event_id, r.rule_id, r.priority, min(case when c.op is null then 1 when c.op = 'eq' then case when i.num is not distinct from c.cnum and i.str is not distinct from c.cstr then 1 else 0 end
 when c.op = 'lt' then case when i.num < c.cnum then 1 else 0 end when c.op = 'lte' then case when i.num <= c.cnum then 1 else 0 end when c.op = 'gt' then case when i.num > c.cnum then 1 else 0 end
 when c.op = 'gte' then case when i.num >= c.cnum then 1 else 0 end else 1 end) as ok from req q join rules r on r.topic = q.event_type left join conds c on c.rule_id = r.rule_id left join inp i on i.event_id = q.event_id and i.field = c.field group by all)
select event_id as request_id, cast(arg_min(rule_id, (-priority, rule_id)) as bigint) as rule_id from s where ok = 1 group by event_id""")
def c05_rule_match(t: Tables) -> DataFrame:
    requests = t.events.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("topic"))
    k = F.get_json_object("props", "$.k").cast("double")
    fields = F.array(
        F.struct(F.lit("value").alias("field"), F.col("value").alias("num"), F.lit(None).cast("string").alias("str")),
        F.struct(F.lit("k").alias("field"), k.alias("num"), F.lit(None).cast("string").alias("str")),
        F.struct(F.lit("kind").alias("field"), F.lit(None).cast("double").alias("num"), F.col("event_type").alias("str")),
    )
    inputs = t.events.select(F.col("event_id").alias("request_id"), F.inline(fields))
    rules = t.spark.createDataFrame(RULE_ROWS, "rule_id long, topic string, priority int")
    conditions = t.spark.createDataFrame(CONDITION_ROWS, "rule_id long, field string, op string, num double, str string")
    return match_rules(requests, inputs, rules, conditions)


#: Rules with their conditions as JSON: none, a scalar, bounds, a null beside a bound, a field that no input has, and no object at all.
JSON_RULES = """case n_nationkey % 6 when 0 then '{}' when 1 then concat('{"k": ', n_nationkey, '}') when 2 then concat('{"k": {"gte": ', n_nationkey, ', "lt": ', n_nationkey + 30, '}}')
when 3 then concat('{"k": {"lte": ', n_nationkey * 4, '.5}, "other": null, "name": {"near": 1}}') when 4 then '{"missing": {"gt": 0}}' else concat('{"flag": true, "who": "u', n_nationkey % 3, '"}') end"""


@query("""with r as (select n_nationkey as id, ['click', 'view', 'purchase', 'signup'][n_nationkey % 4 + 1] as topic, n_regionkey as priority, n_nationkey % 6 as kind from nation),
e as (select event_id, event_type, cast(props->>'$.k' as double) as k, user_id % 2 = 0 as flag, 'u' || (user_id % 3) as who from events),
m as (select event_id, id, priority from e join r on r.topic = e.event_type where case kind when 0 then true when 1 then k = id when 2 then k >= id and k < id + 30 when 3 then k <= id * 4 + 0.5 when 4 then false else flag and who = 'u' || (id % 3) end)
select event_id as request_id, cast(arg_min(id, (-priority, id)) as bigint) as rule_id from m group by event_id""")
def h_json_conditions(t: Tables) -> DataFrame:
    topic = F.get(F.array(*map(F.lit, ["click", "view", "purchase", "signup"])), F.col("n_nationkey") % 4)
    rules = t.nation.select(F.col("n_nationkey").cast("long").alias("rule_id"), topic.alias("topic"), F.col("n_regionkey").alias("priority"), F.expr(JSON_RULES).alias("conditions"))
    given = F.concat(F.rtrim("props", F.lit("}")), F.lit(', "flag": '), (F.col("user_id") % 2 == 0).cast("string"), F.lit(', "who": "u'), F.col("user_id") % 3, F.lit('", "list": [1]}'))
    asked = t.events.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("topic"), given.alias("inputs"))
    return match_rules(asked, inputs_of(asked), rules, conditions_of(rules))


@query("""with l as (select l_orderkey, count(*) as n from lineitem group by 1), s as (select o_custkey, count(*) as n_sections, sum(coalesce(n, 0)) as n_paragraphs, arg_min(o_orderkey, (-cast(o_orderpriority[1] as int), o_orderkey)) as first_section
from orders left join l on l_orderkey = o_orderkey group by 1)
select c_custkey as request_id, n_sections, cast(n_paragraphs as bigint) as n_paragraphs, first_section, case when c_acctbal > 5000 then 'rich' when c_mktsegment = 'BUILDING' then 'builder' end as answer from customer join s on o_custkey = c_custkey""")
def c07_situation(t: Tables) -> DataFrame:
    topics = t.customer.select(F.col("c_custkey").cast("string").alias("topic"))
    relevance = F.substring("o_orderpriority", 1, 1).cast("int")
    links = t.orders.select(F.col("o_custkey").cast("string").alias("topic"), F.col("o_orderkey").alias("section_id"), relevance.alias("relevance"))
    sections = t.orders.select(F.col("o_orderkey").alias("section_id"), F.col("o_orderstatus").alias("number"), F.col("o_orderpriority").alias("title"))
    paragraphs = t.lineitem.select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("order_index"), "l_partkey")
    guidance = t.supplier.select(F.lit("none").alias("topic"), F.col("s_suppkey").alias("guidance_id"), F.col("s_name").alias("sector"))
    page = situation.topic_page(topics, links, sections, paragraphs, guidance)
    requests = t.customer.select(F.col("c_custkey").alias("request_id"), F.col("c_custkey").cast("string").alias("topic"), F.col("c_mktsegment").alias("sector_group"))
    inputs = t.customer.select(F.col("c_custkey").alias("request_id"), F.inline(F.array(F.struct(F.lit("balance").alias("field"), F.col("c_acctbal").alias("num"), F.lit(None).cast("string").alias("str")), F.struct(F.lit("segment").alias("field"), F.lit(None).cast("double").alias("num"), F.col("c_mktsegment").alias("str")))))
    rules = t.customer.select(F.col("c_custkey").cast("string").alias("topic"), F.inline(F.array(F.struct((F.col("c_custkey") * 2).alias("rule_id"), F.lit(5).alias("priority"), F.lit("rich").alias("answer")), F.struct((F.col("c_custkey") * 2 + 1).alias("rule_id"), F.lit(1).alias("priority"), F.lit("builder").alias("answer")))))
    null = lambda kind: F.lit(None).cast(kind)
    conditions = rules.select("rule_id", F.when(F.col("answer") == "rich", "balance").otherwise("segment").alias("field"), F.when(F.col("answer") == "rich", "gt").otherwise("eq").alias("op"), F.when(F.col("answer") == "rich", F.lit(5000.0)).alias("num"), F.when(F.col("answer") == "builder", F.lit("BUILDING")).otherwise(null("string")).alias("str"))
    groups = t.spark.createDataFrame([("BUILDING", "x")], "sector_group string, sector string")
    found = situation.situations(requests, inputs, page, rules, conditions, groups)
    count = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.size(s["paragraphs"]))
    return found.where(F.size("sections") > 0).select("request_id", F.size("sections").cast("long").alias("n_sections"), count.alias("n_paragraphs"), F.col("sections")[0]["section_id"].alias("first_section"), "answer")


@query(r"""select p_partkey, nullif(coalesce(nullif(trim(regexp_replace(trim(regexp_replace(trim(p_name), '(?i)(?:bolt|nut)\s*$', '')), '(?i)(?:red|blue)\s*$', '')), ''), p_name), 'steel') as name from part""")
def c09_recompute(t: Tables) -> DataFrame:
    cut = text.strip_suffixes(F.col("p_name"), ["bolt|nut", "red|blue"])
    return t.part.select("p_partkey", F.nullif(cut, F.lit("steel")).alias("name"))


@query("select doc_id, case when length(text) <= 500 then 'batch' else 'single' end as route from documents")
def c10_length_route(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", chunks.length_route(F.col("text")).alias("route"))


def _each(listed: str, name: str) -> str:
    return f"with l as (select doc_id, {listed} as parts from documents) select doc_id, unnest(parts) as {name}, cast(generate_subscripts(parts, 1) - 1 as int) as pos from l"


@query(_each(sql.chunks("text"), "chunk"))
def c11_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(chunks.chunks(F.col("text"))).alias("pos", "chunk"))


@query(_each(sql.pages("text"), "page"))
def c12_pager(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(chunks.pages(F.col("text"))).alias("pos", "page"))


@query("select d.doc_id, (l.quality is null or sha256(d.text) <> sha256(lower(d.text))) as needed from documents d left join labels l using (doc_id)")
def c13_needs_translation(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    drift = text.content_hash([F.col("text")]) != text.content_hash([F.lower("text")])
    return joined.select("doc_id", (F.col("quality").isNull() | drift).alias("needed"))


CLAUSES = "concat('Intro ', doc_id, chr(10), '1 § Scope ... 3', chr(10), '1 § Scope', chr(10), concat(text, repeat('x', greatest(0, 120 - length(text)))), chr(10), '2 § Terms', chr(10), 'short', chr(10), '3 § Pay', chr(10), concat(text, repeat('y', greatest(0, 200 - length(text)))))"


HEADER = r"^[ \t]*(\d+)\s*§[ \t]*([^\n]*)$"


@query(rf"""with c as (select doc_id, {CLAUSES} as t from documents), l as (select doc_id, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from c),
p as (select *, cast(sum(length(line) + 1) over (partition by doc_id order by i) - length(line) - 1 as bigint) as pos, regexp_extract(line, '{HEADER}', 2) as title from l),
h as (select *, row_number() over (partition by doc_id order by i) - 1 as ord, coalesce(lead(pos) over (partition by doc_id order by i), length(t)) as stop from p where regexp_matches(line, '{HEADER}') and not regexp_matches(title, '(\.{{3,}}|\s)\s*\d+\s*$') and not regexp_matches(trim(title), '^[:)]')),
b as (select *, {sql.strip("substring(t, pos + length(line) + 1, least(stop - pos - length(line), 30000))")} as body from h)
select doc_id, cast(ord as int) as ord, regexp_extract(line, '{HEADER}', 1) as number, trim(title) as title, body, cast(pos as int) as start from b where length(body) >= 100""")
def c15_clauses(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", F.expr(CLAUSES.replace("chr(10)", "'\\n'")).alias("clause_text"))
    return chunks.clauses(texts, "doc_id", "clause_text")


@query("select doc_id, unnest(string_split(text, chr(10))) as line, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as bigint) as pos from documents")
def split_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query("select doc_id, sha256(text) as sha, md5(text) as md, sha256(coalesce(text, '') || chr(10) || coalesce(lang, '')) as joined from documents")
def h_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.content_hash([F.col("text")]).alias("sha"), text.text_key(F.col("text")).alias("md"), text.content_hash([F.col("text"), F.col("lang")], "\n").alias("joined"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean, length(text) as n from documents")
def h_squeeze(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.squeeze(F.col("text")).alias("clean"), F.length("text").cast("long").alias("n"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part")
def h_slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@query("select page_id, upper(substring(s, 1, 1)) || lower(substring(s, 2)) as title from (select page_id, replace(list_last(string_split(rtrim(url, '/'), '/')), '-', ' ') as s from pages)")
def h_slug_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.slug_to_title(F.col("url"), []).alias("title"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(replace(text, ' the ', ''), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') as clean from documents")
def h_scrub(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.scrub(F.col("text"), [" the "]).alias("clean"))


@query("select doc_id, case when contains(text, ': ') then substring(text, instr(text, ': ') + 2) else text end as rest, substring(text, 1, 20) as head from documents")
def h_after_label(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.after_label(F.col("text")).alias("rest"), F.substring("text", 1, 20).alias("head"))


@query("select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as safe from pages")
def h_html_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_escape(F.col("html")).alias("safe"))


@query("select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, strftime(o_orderdate, '%Y-%m-%d') as day, null::varchar as bad from orders")
def h_amount_date(t: Tables) -> DataFrame:
    written = F.replace(F.replace(F.format_number(F.col("o_totalprice"), 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    day = F.concat_ws(".", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    read = values.locale_decimal(written)
    return t.orders.select("o_orderkey", (read * 100).cast("long").alias("cents"), values.dmy(day).cast("string").alias("day"), values.dmy(F.concat(F.lit("31.2."), F.year("o_orderdate"))).cast("string").alias("bad"))


@query("select c_custkey, cast(make_date(2000 + c_nationkey, 1, 1) as varchar) as first, cast(make_date(2003 + c_nationkey, 12, 31) as varchar) as last, 3 * 365 as span from customer")
def h_year_range(t: Tables) -> DataFrame:
    period = values.year_range(F.concat(F.lit("valid "), F.col("c_nationkey") + 2000, F.lit("–"), F.col("c_nationkey") + 2003))
    return t.customer.select("c_custkey", period["first"].cast("string").alias("first"), period["last"].cast("string").alias("last"), values.span_days(period["first"], period["last"]).alias("span"))


@query("select event_id, case event_type when 'click' then 2 when 'view' then 10 when 'purchase' then 37 end as n from events")
def h_number_words(t: Tables) -> DataFrame:
    word = F.when(F.col("event_type") == "click", "Kahden").when(F.col("event_type") == "view", "kymmeneltä").when(F.col("event_type") == "purchase", "37").otherwise("monta")
    return t.events.select("event_id", values.number_word(word).alias("n"))


@query("""with a as (select doc_id, md5(text) as h from documents where source <> 'src3'), b as (select doc_id, md5(case when lang = 'fr' then text || '!' else text end) as h from documents where source <> 'src5')
select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'created' when b.doc_id is null then 'absent' when a.h = b.h then 'unchanged' else 'updated' end as status from a full join b on a.doc_id = b.doc_id""")
def w01_hash_diff(t: Tables) -> DataFrame:
    a = t.documents.where("source <> 'src3'").select("doc_id", F.md5("text").alias("h"))
    b = t.documents.where("source <> 'src5'").select("doc_id", F.md5(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return merge.hash_diff(a, b, ["doc_id"], "h")


@query("""with a as (select doc_id, md5(text) as h, lang as title, 'x' as translated from documents where source <> 'src3'), b as (select doc_id, md5(case when lang = 'fr' then text || '!' else text end) as h, source as title from documents where source <> 'src5')
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(case when b.doc_id is not null then b.h end, a.h) as h, case when b.doc_id is not null then b.title else a.title end as title, case when b.doc_id is null or a.h = b.h then a.translated end as translated from a full join b on a.doc_id = b.doc_id""")
def w02_upsert(t: Tables) -> DataFrame:
    a = t.documents.where("source <> 'src3'").select("doc_id", F.md5("text").alias("h"), F.col("lang").alias("title"), F.lit("x").alias("translated"))
    b = t.documents.where("source <> 'src5'").select("doc_id", F.md5(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"), F.col("source").alias("title"))
    return merge.upsert(a, b, ["doc_id"], "h", always=["title"], reset=["translated"])


@query("""with o as (select o_custkey as k, o_orderkey as url, true as is_current from orders where o_orderdate < timestamp '1996-01-01'), n as (select o_custkey as k, o_orderkey as url from orders where o_orderdate >= timestamp '1997-06-01')
select k, url, is_current and k not in (select k from n) as is_current from o union all select k, url, true from n""")
def w04_versions(t: Tables) -> DataFrame:
    old = t.orders.where("o_orderdate < timestamp '1996-01-01'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("url"), F.lit(True).alias("is_current"))
    new = t.orders.where("o_orderdate >= timestamp '1997-06-01'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("url"))
    return merge.new_versions(old, new, "k", "url")


ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


@query(f"""with s as (select l_orderkey, l_linenumber, l_quantity, row_number() over w as rn, lag(l_quantity) over w as p, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_shipdate desc) as back
from lineitem window w as (partition by l_orderkey, l_linenumber order by {ORDER}))
select l_orderkey, l_linenumber, count(*) filter (rn = 1) as created, count(*) filter (rn > 1 and p <> l_quantity) as updated, count(*) filter (rn > 1 and p = l_quantity) as skipped, max(case when back = 1 then l_quantity end) as value from s group by 1, 2""")
def w05_merge_outcomes(t: Tables) -> DataFrame:
    order = ORDER.split(", ")
    outcomes = merge.sequential_outcomes(t.lineitem, ["l_orderkey", "l_linenumber"], order, "l_quantity")
    counts = [F.count_if(F.col("outcome") == s).alias(s) for s in ("created", "updated", "skipped")]
    return outcomes.groupBy("l_orderkey", "l_linenumber").agg(*counts, F.max(F.struct(*order)).alias("b")).select("l_orderkey", "l_linenumber", "created", "updated", "skipped", F.col("b.l_quantity").alias("value"))


@query("""select doc_id, coalesce(quality, -1) as quality from (select d.doc_id, case when l.quality is not null then l.quality when d.lang = 'en' then 1 end as quality from documents d left join labels l using (doc_id))""")
def w09_fill_and_insert(t: Tables) -> DataFrame:
    new = t.documents.select("doc_id", F.when(F.col("lang") == "en", 1).alias("quality"))
    merged = merge.fill_nulls(t.labels.select("doc_id", "quality"), new, ["doc_id"], ["quality"])
    return merged.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""select d.doc_id, case when l.doc_id is not null and l.quality = 1 then null else d.lang end as lang, (l.doc_id is not null and l.quality = 1 and d.lang is not null) as cleared from documents d left join labels l using (doc_id)""")
def w11_conditional_null(t: Tables) -> DataFrame:
    found = merge.clear_in_scope(t.documents.select("doc_id", "lang"), ["lang"], t.labels.where("quality = 1"), "doc_id")
    return found.select("doc_id", "lang", F.col("_cleared").alias("cleared"))


@query("select doc_id, source, upper(source) as label from documents")
def w12_propagate(t: Tables) -> DataFrame:
    load = lambda: lambda texts: [x.upper() for x in texts]
    return inference.translate_values(t.documents.select("doc_id", "source"), "source", "label", load)


@query("select o_orderkey, case when c_acctbal >= 0 then o_custkey end as o_custkey from orders join customer on o_custkey = c_custkey")
def w14_set_null(t: Tables) -> DataFrame:
    return merge.set_null(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_acctbal >= 0"), "o_custkey", "c_custkey")


def clause_texts(t: Tables) -> DataFrame:
    """A clause a document with the wordings that rates are read from and a number of its own."""
    n = F.col("doc_id") % 90 + 10
    return t.documents.select("doc_id", F.concat(F.lit("Kokopäiväraha on "), n, F.lit(" euroa ja osapäiväraha "), n - 5, F.lit(",50 euroa. Lisäksi 16,00 euron yömatkaraha. Varsinainen palkkansa enintään "), n, F.lit(" kalenteripäivän ajalta ja sen jälkeen kaksi kolmasosaa (⅔) varsinaisesta palkastaan enintään 120 kalenteripäivän ajalta.")).alias("text"))


@query("""select doc_id, rate_type, cast(round(value * 100) as bigint) as cents from (select doc_id, unnest(['daily_allowance_full_eur', 'daily_allowance_part_eur', 'night_travel_allowance_eur']) as rate_type, unnest([(doc_id % 90 + 10)::decimal(10,2), doc_id % 90 + 5.5, 16]) as value from documents)""")
def x16_expenses(t: Tables) -> DataFrame:
    return rates.extract(clause_texts(t), "expense_reimbursement").select("doc_id", "rate_type", (F.col("value") * 100).cast("long").alias("cents"))


@query("""select doc_id, rate_type, cast(round(value * 100) as bigint) as cents, unit from (select doc_id, unnest(['sick_pay_tier1_days', 'sick_pay_tier1_pct', 'sick_pay_tier2_days', 'sick_pay_tier2_pct']) as rate_type, unnest([(doc_id % 90 + 10)::decimal(10,2), 100, 120, 66.67]) as value, unnest(['days', 'pct', 'days', 'pct']) as unit from documents)""")
def x21_sick_leave(t: Tables) -> DataFrame:
    return rates.extract(clause_texts(t), "sick_leave").select("doc_id", "rate_type", (F.col("value") * 100).cast("long").alias("cents"), "unit")


@query(sql.blocks("html", "page_id", "pages"))
def s05_html_blocks(t: Tables) -> DataFrame:
    return landing.html_blocks(t.pages, "page_id")


#: Nested lists, text before and after blocks, cells with paragraphs, unclosed paragraphs and a sidebar, with the number of the page.
NESTED_HTML = """concat('lead ', page_id, '<div class="x">bare<ul><li>item ', page_id, '<ol><li>inner</li><li>second</ol> tail</li><li>last</ul>between<!-- no --><table><tr><td>cell<p>para ', page_id, '</p>rest<td>next<tr><th>head</table>', case when page_id % 2 = 0 then '<p>open<p>again' else '</p>' end, '</div><script>"<p>no</p>"</script>after<aside>side</aside>')"""
NESTED_ROWS = "[['', 'lead N'], ['div', 'bare'], ['li', 'item N'], ['li', 'inner'], ['li', 'second'], ['li', 'tail'], ['li', 'last'], ['div', 'between'], ['td', 'cell'], ['p', 'para N'], ['td', 'rest'], ['td', 'next'], ['th', 'head'], ['p', 'open'], ['p', 'again'], ['', 'after'], ['aside', 'side']]"


@query(f"select page_id, cast(row_number() over (partition by page_id order by k) - 1 as int) as ord, r[1] as tag, replace(r[2], 'N', cast(page_id as varchar)) as text from (select page_id, unnest({NESTED_ROWS}) as r, unnest(range(0, 17)) as k from pages) where page_id % 2 = 0 or k not in (13, 14)")
def s05_nested_blocks(t: Tables) -> DataFrame:
    return landing.html_blocks(t.pages.select("page_id", F.expr(NESTED_HTML).alias("html")), "page_id")


#: Guidance pages: named sections, a repeated one of which the last counts, headings with what they are about before a dash; every
#: fourth page has none of them, and its text is taken but for a skipped heading; every seventh has no main element.
GUIDANCE_HTML = """concat('<nav><h2>General</h2>menu</nav><div id="', case when page_id % 7 = 0 then 'other' else 'main-content' end, '"><div class="in">', case when page_id % 4 = 0 then concat('<h2>About</h2><p>Long enough ', page_id, '</p><p>short</p><ul><li>one list of <ul><li>several</li></ul> items</li></ul><h2>X - Sanasto</h2><p>left out entirely here</p>')
else concat('<div><h2>Pay – General</h2></div><p>old</p><h2>General</h2>bare ', page_id, '<ul><li>a<ul><li>b</li></ul>c</li></ul> FOOT and more<h2>For the employee</h2><p>yours</p>') end, '</div></div><h2>General</h2><p>outside</p>')"""


@query("""with g as (select page_id, case when page_id % 7 = 0 then '' when page_id % 4 = 0 then 'Long enough ' || page_id || ' one list of several items' else 'bare ' || page_id || ' a b c' end as general, case when page_id % 7 = 0 or page_id % 4 = 0 then '' else 'yours' end as employee from pages)
select page_id, general, employee, sha256(general || employee) as content_hash from g""")
def s05_guidance(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.expr(GUIDANCE_HTML).alias("html"))
    return landing.guidance(pages, "page_id", {"general": "general", "employee": ["employee", "työntekijä"]}, "FOOT", "main-content", ("sanasto",), 8)


#: References: an item before any act, an act linked inside an item, nested items, chapters from items before, repeats, an act of another site.
REFERENCES_HTML = """concat('<ul><li>9 § too early</li></ul><p><a href="https://law.example/fi/laki/ajantasa/2019/2019', lpad(cast(page_id % 1000 as string), 4, '0'), '">Act</a> and <a href="https://other.example/laki/ajantasa/1999/19990001">no</a></p><ul><li>2 luku ', page_id % 9 + 1, ' § a</li><li>', page_id % 9 + 1, ' § again</li><li>20 § ja 21 § <ul><li>3 luku 30 §</li><li>30 §</li></ul></li></ul>',
'<ul><li>See <b>40</b> § of <a href="https://law.example/x/2001/20010055">next</a></li><li>41 §</li><li>41 §</li><li>luku ja 42 §</li></ul>')"""


@query("""with r as (select page_id, unnest(['A', 'A', 'A', 'A', 'A', 'B', 'B']) as w, unnest([2, 3, 3, 3, null, null, null]) as chapter, unnest([page_id % 9 + 1, 20, 21, 30, 40, 41, 42]) as section from pages)
select page_id, case when w = 'A' then '2019/' || (page_id % 1000) else '2001/55' end as act, case when w = 'A' then (page_id % 1000) || '/2019' else '55/2001' end as code, chapter, cast(section as int) as section from r""")
def s06_references(t: Tables) -> DataFrame:
    found = landing.statute_references(t.pages.select("page_id", F.expr(REFERENCES_HTML).alias("html")), "page_id", site="law.example")
    return found.select("page_id", "act", "code", "chapter", "section")


@query(sql.links("html", "page_id", "url", "pages"))
def s06_links(t: Tables) -> DataFrame:
    return landing.html_links(t.pages, "page_id", "url")


@query(sql.sections("page_id", sql.blocks("html", "page_id", "pages"), "tag = 'h1'", 1))
def s07_page_sections(t: Tables) -> DataFrame:
    return landing.page_sections(t.pages, "page_id", "h1", 1)


@query("""select user_id, line, string_agg(event_type, ' ' order by x0, event_type) as text from (select user_id, event_type, event_id % 3 as x0, cast(floor(event_id / 1000) as int) as line from events) group by user_id, line""")
def i04_lines_of_words(t: Tables) -> DataFrame:
    words = t.events.select("user_id", (F.floor(F.col("event_id") / 1000) * 10).cast("double").alias("top"), (F.col("event_id") % 3).cast("double").alias("x0"), F.col("event_type").alias("text"))
    lines = ordered.lines_of_words(words, ["user_id"])
    first = t.events.select("user_id", F.floor(F.col("event_id") / 1000).cast("int").alias("line")).distinct()
    numbered = ordered.first_wins(first, ["user_id", "line"], [F.col("line")])
    place = numbered.withColumn("at", F.row_number().over(_by_user()) - 1)
    return lines.join(place.select("user_id", F.col("line").alias("block"), F.col("at")), (lines["user_id"] == place["user_id"]) & (F.col("line") == F.col("at"))).select(lines["user_id"], F.col("block").alias("line"), "text")


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("line")


@query(f"select doc_id, array_to_string(list_transform({sql.chunks('text')}, lambda c: replace(c, 'e', '3')), ' ') as text_en from documents")
def uf02_translate(t: Tables) -> DataFrame:
    """Documents with a text worked out by a model; here a stand-in that changes a letter in each chunk."""
    load = lambda: lambda texts: [x.replace("e", "3") for x in texts]
    return inference.translate_pending(t.documents.select("doc_id", "text", F.lit(None).cast("string").alias("text_en")), "text", "text_en", load).select("doc_id", "text_en")
