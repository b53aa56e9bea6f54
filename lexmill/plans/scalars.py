"""Queries: the remaining functions over text, dates and landed bytes (H, K-03, S-04, S-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text, values
from lexmill.operators import chunks, merge
from lexmill.plans import sql
from lexmill.plans.registry import Tables, query
from lexmill.sources import landing


@query("select doc_id, replace(replace(replace(replace(replace(text, ' ', ' – '), '—', '-'), '–', '-'), '−', '-'), '­', '') as plain from documents")
def h_dashes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.plain_dashes(F.replace("text", F.lit(" "), F.lit(" – "))).alias("plain"))


CODE_URL = "concat('https://x.fi/laki/', 1990 + c_custkey % 30, '/', case when c_custkey % 3 = 0 then concat(1990 + c_custkey % 30, lpad(cast(c_custkey % 500 as {0}), 4, '0')) when c_custkey % 3 = 1 then cast(c_custkey as {0}) else 'none' end, case when c_custkey % 2 = 0 then '/' else '' end)"


@query("select c_custkey, case when c_custkey % 3 < 2 then (case when c_custkey % 3 = 0 then c_custkey % 500 else c_custkey end) || '/' || (1990 + c_custkey % 30) end as code from customer")
def h_statute_code(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.statute_code(F.expr(CODE_URL.format("string"))).alias("code"))


@query("select n_nationkey, '| ' || n_name || ' | key |' || chr(10) || '| --- | --- |' || chr(10) || '| a |  |' || chr(10) || '| ' || n_regionkey || ' | c |' as md from nation")
def h_markdown_table(t: Tables) -> DataFrame:
    rows = F.array(F.array("n_name", F.lit("key")), F.array(F.lit("a")), F.array(F.col("n_regionkey").cast("string"), F.lit("c"), F.lit("too much")))
    return t.nation.select("n_nationkey", text.markdown_table(rows).alias("md"))


@query("""select doc_id, trim(split_part(text, ' the ', 1), ' ') as head, case when coalesce(lang, '') = 'fr' or lang is null then 'nothing' else lang end as answer, concat_ws(chr(10) || chr(10), nullif(lang, 'de'), nullif(source, ''), case when n_chars < 300 then 'short' end) as joined from documents""")
def h_footer_fallback_join(t: Tables) -> DataFrame:
    blank = F.when(F.col("lang") == "fr", "").otherwise(F.col("lang"))
    parts = text.join_filled("\n\n", F.when(F.col("lang") == "de", "").otherwise(F.col("lang")), F.col("source"), F.when(F.col("n_chars") < 300, "short"))
    return t.documents.select("doc_id", text.cut_at(F.col("text"), " the ").alias("head"), text.fallback(blank, "nothing").alias("answer"), parts.alias("joined"))


@query("""select o_orderkey, case when o_orderkey % 3 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as day, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then '2025-01-01' else '2021-01-01' end as first, case o_orderkey % 3 when 1 then '2028-12-31' when 2 then '2024-12-31' end as last,
case o_orderkey % 7 when 0 then 0 when 1 then 1 when 2 then 12 when 3 then 48 when 4 then 96 when 5 then 144 end as months from orders""")
def h_dates_and_tenure(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    written = F.when(key % 3 == 0, F.lit("2024-02-31")).otherwise(F.to_date("o_orderdate").cast("string"))
    day = F.concat_ws(".", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    name = F.when(key % 3 == 0, F.concat(F.lit("Sopimus 2025–2028, voimassa "), day, F.lit(" alkaen"))).when(key % 3 == 1, "Sopimus 2025 – 2028").otherwise("Sopimus")
    span = values.validity(name, F.lit("2021-2024"))
    answers = F.array(*map(F.lit, ["lt_1m", "1_12m", "1_4y", "4_8y", "8_12y", "gt_12y", "unknown"]))
    return t.orders.select("o_orderkey", values.iso_date(written).cast("string").alias("day"), span["first"].cast("string").alias("first"), span["last"].cast("string").alias("last"), values.tenure_months(F.get(answers, (key % 7).cast("int"))).alias("months"))


@query("select d.doc_id, case when l.quality = 1 then '2026-01-02 03:04:05' when l.quality = 0 then '2020-01-01 00:00:00' end as parsed_at from documents d left join labels l using (doc_id)")
def h_stamps(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", F.when(F.col("quality").isNotNull(), F.lit("2020-01-01").cast("timestamp")).alias("parsed_at"))
    return merge.stamped(rows, F.col("quality") == 1, "parsed_at", "2026-01-02 03:04:05").select("doc_id", F.date_format("parsed_at", "yyyy-MM-dd HH:mm:ss").alias("parsed_at"))


@query("select doc_id, case when doc_id % 3 = 0 then '2024-01-02' end as version from documents")
def s04_version_date(t: Tables) -> DataFrame:
    xml = F.concat(F.lit("<act "), F.when(F.col("doc_id") % 3 == 0, "dateProduced='2024-01-02T00:00'").when(F.col("doc_id") % 3 == 1, 'dateProduced="2024-02-31"').otherwise("x='1'"), F.lit("><a dateProduced='2020-01-01x'/></act>"))
    first = F.when(F.col("doc_id") % 3 == 2, F.replace(xml, F.lit("dateProduced"), F.lit("other"))).otherwise(xml)
    return t.documents.select("doc_id", landing.version_date(first).cast("string").alias("version"))


@query("select page_id, case page_id % 4 when 1 then 'html instead of pdf' when 2 then 'not a pdf' end as error from pages")
def s12_landed_pdfs(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    content = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "url")).when(k == 1, F.col("html")).when(k == 2, F.lit("?")).otherwise(F.lit("plain"))
    path = F.concat(F.lit("/landed/"), "page_id", F.when(k == 3, ".html").otherwise(".PDF"))
    return t.pages.select("page_id", landing.pdf_error(F.encode(content, "UTF-8"), path).alias("error"))


@query(f"with l as (select doc_id, {sql.pages('text')} as p from documents) select doc_id, p[least(2, len(p))] || chr(10) || chr(10) || 'Page ' || least(2, len(p)) || '/' || len(p) as page from l where len(p) > 0")
def k03_second_page(t: Tables) -> DataFrame:
    paged = t.documents.select("doc_id", chunks.pages(F.col("text")).alias("p"))
    return paged.select("doc_id", chunks.page_at(F.col("p"), F.lit(1)).alias("page")).where("page is not null")
