import random
import time
from decimal import Decimal

from pyspark.sql import functions as F

from lexmill.functions import inference, text
from lexmill.operators import chunks, classify, conditions, keywords, lookup, merge, ordered, rates
from lexmill.sources import landing
from lexmill.streaming import incremental

RULES = [classify.Keyword("pay", "palkka"), classify.Keyword("leave", "loma"), classify.Keyword("wages", "palkat"), classify.Keyword("leave", "vuosiloma")]


def topics(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.r for r in rows.select("k", classify.topic_of(F.col("t"), RULES).alias("r")).orderBy("k").collect()]


def test_topics(spark):
    assert topics(spark, "lomautus", "LOMA.", "minimipalkkaan", "vuosilomaa ja palkka", "palkka ja palkat", None, "") == [None, "leave", "pay", "leave", "wages", None, None]


def test_topics_by_join_agree(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["loma", "lomautus", "palkkaa", "Palkat", "x.y"]) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rules = spark.createDataFrame([(r.topic, r.keyword) for r in RULES], "topic string, keyword string")
    found = {r.k: r.topic for r in keywords.topic_by_index(rows, rules, "t", "k").collect()}
    assert [found[k] for k in range(60)] == topics(spark, *texts)
    assert {(r.topic, r.keyword) for r in classify.read_rules(rules)} == {(r.topic, r.keyword) for r in RULES}


def python_match(conditions, inputs):
    tests = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}
    for field, op, number in conditions:
        value = inputs.get(field)
        if op == "eq" and value != number or op in tests and (value is None or not tests[op](value, number)):
            return False
    return True


def test_rules_against_a_model(spark):
    rng = random.Random(2)
    rules = [(k, "t", rng.randint(1, 3)) for k in range(1, 9)]
    conds = [(k, rng.choice("abc"), rng.choice(["eq", "lt", "lte", "gt", "gte", "odd"]), float(rng.randint(0, 4)), None) for k in range(1, 8) for _ in range(rng.randint(0, 3))]
    requests = [(k, "t" if k % 9 else "none") for k in range(80)]
    inputs = [(k, f, float(rng.randint(0, 4)), None) for k, _ in requests for f in "abc" if rng.random() < 0.7]
    found = {r.request_id: r.rule_id for r in conditions.match_rules(spark.createDataFrame(requests, "request_id long, topic string"), spark.createDataFrame(inputs, "request_id long, field string, num double, str string"), spark.createDataFrame(rules, "rule_id long, topic string, priority int"), spark.createDataFrame(conds, "rule_id long, field string, op string, num double, str string")).collect()}
    for k, topic in requests:
        given = {f: v for q, f, v, _ in inputs if q == k}
        fits = [(-p, r) for r, t, p in rules if t == topic and python_match([(f, o, n) for q, f, o, n, _ in conds if q == r], given)]
        assert found.get(k) == (min(fits)[1] if fits else None)


def test_merge_outcomes_and_second_run(spark):
    keys = ["a", "b"]
    old = spark.createDataFrame([("x", None, Decimal(1), "2024", None), ("y", "1", Decimal(2), "2024", 5)], "a string, b string, value decimal(10,2), effective_from string, clause int")
    new = spark.createDataFrame([("x", None, Decimal(1), "2024", 7, 1), ("z", None, Decimal(3), "2024", 8, 1), ("z", None, Decimal(4), "2024", 9, 2), ("q", None, None, "2024", 1, 1), ("y", "1", Decimal(9), "2024", 6, 1)], "a string, b string, value decimal(10,2), effective_from string, clause int, ord int")
    merged, counts = merge.merge_rates(old, new, keys, ["ord"], ["clause"])
    assert counts.first().asDict() == {"created": 1, "updated": 2, "skipped": 1, "rejected": 1}
    assert {r.a: (r.value, r.clause) for r in merged.collect()} == {"x": (1, 7), "y": (9, 6), "z": (4, 9)}
    last = merge.last_rows(new, keys, ["ord"])
    assert merge.merge_rates(merged, last, keys, ["ord"])[1].first().asDict() == {"created": 0, "updated": 0, "skipped": 3, "rejected": 1}


def test_upsert_resets_and_references(spark):
    old = spark.createDataFrame([(1, "h", "t", "x"), (2, "g", "u", "y"), (3, "k", "v", "z")], "id int, hash string, title string, translated string")
    new = spark.createDataFrame([(1, "h", "T"), (2, "G", "U"), (4, "n", "N")], "id int, hash string, title string")
    out = {r.id: tuple(r)[1:] for r in merge.upsert(old, new, ["id"], "hash", ["title"], ["translated"]).collect()}
    assert out == {1: ("h", "T", "x"), 2: ("G", "U", None), 3: ("k", "v", "z"), 4: ("n", "N", None)}
    children = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "c int, p int")
    parents = spark.createDataFrame([(1,)], "id int")
    assert {r.c for r in merge.cascade_delete(children, parents, "p", "id").collect()} == {1, 3}
    assert {(r.c, r.p) for r in merge.set_null(children, parents, "p", "id").collect()} == {(1, 1), (2, None), (3, None)}


def test_relink(spark):
    clauses = spark.createDataFrame([(1, "a", "vuosiloma", "pay"), (2, "a", "palkka", "pay"), (3, "a", "fixed", "pay"), (4, "b", "fixed", None), (5, "a", "palkat", None)], "id int, agreement_key string, text string, topic string")
    overrides = clauses.where("id = 3").select("agreement_key", F.md5("text").alias("text_hash"), F.lit(None).cast("string").alias("topic"))
    known = spark.createDataFrame([("pay",), ("leave",)], "topic string")
    out = {r.id: (r.new_topic, r.outcome) for r in classify.relink(clauses, overrides, RULES, known).collect()}
    assert out == {1: ("leave", "linked"), 2: ("pay", "unchanged"), 3: (None, "unlinked"), 4: (None, "unchanged"), 5: ("wages", "unknown_topic")}


def test_lines_do_not_chain_by_drift(spark):
    words = spark.createDataFrame([("p", 10.0, 1.0, "a"), ("p", 12.0, 2.0, "b"), ("p", 14.0, 0.0, "c"), ("p", 30.0, 5.0, "e"), ("p", 30.5, 1.0, "d")], "page string, top double, x0 double, text string")
    assert [r.text for r in ordered.lines_of_words(words, ["page"]).orderBy("line").collect()] == ["a b", "c", "d e"]


def test_repeats(spark):
    tokens = lambda s: spark.createDataFrame([(s.split(),)], "w array<string>").select(ordered.without_repeats(F.col("w")).alias("r")).first().r
    assert tokens("a a b b a") == ["a", "b", "a"] and tokens("a b a b") == ["a", "b"] and tokens("a") == ["a"]


def test_chunks_and_pages(spark):
    text = "One two. " * 90 + "\n" + "x" * 1300 + "\nshort"
    got = spark.createDataFrame([(text,)], "t string").select(chunks.chunks(F.col("t")).alias("c"), chunks.pages(F.lit("a\n\n" + "b" * 898 + "\n\n \n\nc")).alias("p"), chunks.page_at(F.array(F.lit("q")), F.lit(7)).alias("at")).first()
    assert all(0 < len(c) <= 500 for c in got.c) and "".join("".join(got.c).split()) == "".join(text.split())
    assert got.p == ["a", "b" * 898, "c"] and got.at == "q\n\nPage 1/1"


def brute_pack(parts, limit, sep):
    out = []
    for x in parts:
        if out and len(out[-1]) + len(sep) + len(x) <= limit:
            out[-1] += sep + x
        else:
            out.append(x)
    return out


def test_packing_and_matches_of_long_texts(spark):
    """Against plain loops; a fold that copied its result at every step would take minutes here."""
    rng = random.Random(5)
    lines = ["x" * rng.randint(1, 30) for _ in range(60_000)]
    frame = spark.createDataFrame([(lines, "ab1cé" * 60_000)], "lines array<string>, t string")
    began = time.time()
    got = frame.select(chunks.pack(F.col("lines"), 100, ", ").alias("p"), text.matches(F.col("t"), r"[a-z](\d)", 1).alias("m")).first()
    assert time.time() - began < 40
    assert got.p == brute_pack(lines, 100, ", ")
    assert [(m.start, m.end, list(m.g)) for m in got.m] == [(5 * k + 1, 5 * k + 3, ["b1", "1"]) for k in range(60_000)]
    few = spark.createDataFrame([([],), (["a"],), (["a" * 9, "b"],)], "p array<string>").select(chunks.pack(F.col("p"), 5, " ").alias("p")).collect()
    assert [r.p for r in few] == [[], ["a"], ["a" * 9, "b"]]


def test_heads_are_found_through_their_longest_word(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "x", "é", "_y", "7"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "-"]) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    heads = [t[k : k + n] for t in texts[:80] if t for k, n in [(rng.randrange(len(t)), rng.randint(1, 12))]] + ["nothing of this", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    items = spark.createDataFrame(list(enumerate(heads)), "i int, h string")
    found = {(r.k, r.i) for r in lookup.containing(docs, "k", "t", items, "i", "h").collect()}
    assert found == {(k, i) for k, t in enumerate(texts) for i, h in enumerate(heads) if t is not None and h is not None and h in t}


def extract(spark, topic, clause):
    rows = rates.extract(spark.createDataFrame([(1, clause)], "k int, text string"), topic).orderBy("ord").collect()
    return [(r.rate_type, r.context, r.value, r.unit) for r in rows], rows


def test_wage_rates(spark):
    got, rows = extract(spark, "min_wage", "Palkka 1.6.2023 alkaen 1 746,00 euroa ja 31.2.2024 lukien 1 800 €. Koulutetun näyttelijän (1234567) vähimmäisperuspalkka on 2 100,50 €/kk (1.1.2024) ja 2 200,00 € / kk (1.1.2025)")
    assert got == [("min_wage", "harjoittelija", Decimal("1746.00"), "eur_month"), ("min_wage", "koulutettu_nayttelija", Decimal("2100.50"), "eur_month"), ("min_wage", "koulutettu_nayttelija", Decimal("2200.00"), "eur_month")]
    assert [str(r.effective_from) for r in rows] == ["2023-06-01", "2024-01-01", "2025-01-01"] and rows[0].source_text.startswith("Palkka 1.6.2023")


def test_overtime_rates(spark):
    got, _ = extract(spark, "overtime", "1 mom. Vuorokautinen ylityö\n2 ensimmäiseltä tunnilta 50 %:lla ja sitten 100 %:lla.\n2 mom. Muu\n50 %:lla korotettu tuntipalkka viikoittaisen ylityön viideltä ensimmäiseltä tunnilta ja 100 %:lla.")
    assert [(c, v) for _, c, v, _ in got] == [("vuorokautinen", 2), ("vuorokautinen", 50), ("vuorokautinen", 100), ("viikoittainen", 5), ("viikoittainen", 50), ("viikoittainen", 100)]
    got, _ = extract(spark, "overtime", "Jaksotyössä 50 %:lla korotettu palkka kahden viikon työaikajakson 12 ensimmäiseltä ja neljän ja kuuden viikon työaikajakson 24 ensimmäiseltä tunnilta, 100 %:lla kultakin seuraavalta")
    assert [c for _, c, _, _ in got][::3] == ["jaksotyo_2vk", "jaksotyo_4-6vk"] and [v for _, _, v, _ in got] == [12, 50, 100, 24, 50, 100]
    assert extract(spark, "overtime", "Jaksotyössä 50 %:lla korotettu")[0] == []


def test_night_rates(spark):
    got, _ = extract(spark, "night_and_sunday_work", "1 mom. Sunnuntaityö\nkaksinkertaista palkkaa\n2 mom. Iltatyö\n15 prosentin lisä ja 20 %\n3 mom. Muu\n99 %")
    assert got == [("night_sunday_rate_pct", "sunnuntai", 100, "pct"), ("night_sunday_rate_pct", "ilta", 15, "pct")]


def test_expense_and_sick_rates(spark):
    got, _ = extract(spark, "expense_reimbursement", "Ateriakorvausta 13,50 euroa tai 2,02 euron suuruinen ateriakorvaus; huollosta aiheutuvista kustannuksista korvataan 5 euroa kuukaudessa")
    assert got == [("meal_compensation_eur", "tier1", Decimal("13.50"), "eur"), ("meal_compensation_eur", "tier2", Decimal("2.02"), "eur"), ("clothing_maintenance_eur", None, 5, "eur_month")]
    got, _ = extract(spark, "sick_leave", "Työtapaturma. Lisäksi voidaan harkinnan mukaan maksaa kaksi kolmasosaa varsinaisesta palkasta enintään 125 kalenteripäivän ajalta.")
    assert got == [("sick_pay_tier3_discretionary_days", "work_accident", 125, "days")]


def test_leave_tables_are_all_or_nothing(spark):
    table = lambda k: f"Taulukko {k} Täysiä kuukausia Vuosilomapäivät {' '.join(str(k + m) for m in range(12))} "
    got, _ = extract(spark, "annual_leave", table(1) + table(2) + table(3))
    assert len(got) == 36 and got[0][1:3] == ("taulukko1_m01", 1) and got[-1][1:3] == ("taulukko3_m12", 14)
    assert extract(spark, "annual_leave", table(1) + table(2))[0] == [] == extract(spark, "annual_leave", table(1) + table(3) + table(2))[0]


HTML = "<h1>T</h1><p>before</p><h2>First &amp; one</h2><p>a <b>b</b></p><script>x<p>no</p></script><li>c</li><h2>Second</h2><p>d</p><details><summary>Why?</summary>Because of it</details><a href='/doc.pdf'>PDF</a><a href='https://o.x/y'>out</a>"


def test_html(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c", HTML)], "page_id int, url string, html string")
    assert [(r.title, r.body) for r in landing.page_sections(pages, "page_id", "h2", 1).orderBy("section").collect()] == [("First & one", "a b\n\nc"), ("Second", "d\n\nWhy?\n\nBecause of it\n\nPDF out")]
    assert [(r.question, r.answer) for r in landing.faq_pairs(pages, "page_id", least=1).collect()] == [("Why?", "Because of it")]
    assert [r.href for r in landing.discover(pages, {"strategy": "all_pdfs"}).collect()] == ["https://a.b/doc.pdf"]
    found = landing.discover(pages, {"marker": "o", "domain": "o.x", "catalog_url": "https://o.x", "depth": 1}).collect()
    assert [r.href for r in found] == ["https://o.x/y"]
    named = landing.guidance(pages, "page_id", {"general": "second", "employee": "none"}, "Why").first()
    assert named.general == "d" and len(named.content_hash) == 64


def test_statutes(spark):
    xml = '<a:act xmlns:a="u"><a:chapter><a:num>2 luku</a:num><a:heading>Pay</a:heading><a:section><a:num>3 §</a:num><a:heading>When</a:heading><a:p>One <a:i>two</a:i>.</a:p><a:p>Three.</a:p></a:section></a:chapter></a:act>'
    rows = landing.statute_paragraphs(spark.createDataFrame([("k", xml)], "k string, xml string"), "k").orderBy("order_index").collect()
    assert [(r.chapter, r.chapter_title, r.section, r.section_title, r.text) for r in rows] == [(2, "Pay", 3, "When", "One two ."), (2, "Pay", 3, "When", "Three.")]
    page = "<a href='https://f/laki/2001/20010055'>Act</a><li>2 luku 3 § ja 4 §</li><li>3 §</li>"
    refs = landing.statute_references(spark.createDataFrame([(1, page)], "k int, html string"), "k").orderBy("ord", "section").collect()
    assert [(r.act, r.code, r.chapter, r.section) for r in refs] == [("2001/55", "55/2001", 2, 3), ("2001/55", "55/2001", 2, 4)]


def test_clauses(spark):
    text = "Intro\n1 § Scope ... 3\n1 § Scope\n" + "a" * 120 + "\n2 § Terms\nshort\n3 § Pay\n" + "b" * 150
    rows = chunks.clauses(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("ord").collect()
    assert [(r.number, r.title, r.body[0]) for r in rows] == [("1", "Scope", "a"), ("3", "Pay", "b")]


def test_translation_of_pending_rows(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, "abc", "kept"), (3, None, None), (4, "x" * 1200, None)], "id int, src string, out string")
    got = {r.id: r.out for r in inference.translate_pending(rows, "src", "out", lambda: lambda texts: [t.upper() for t in texts]).collect()}
    assert got[1] == "ABC" and got[2] == "kept" and got[3] is None and got[4].replace(" ", "") == "X" * 1200


def test_stream_of_documents_merges_by_hash(spark, tmp_path):
    land = f"{tmp_path}/in"
    schema = spark.createDataFrame([(1, 1, "palkka")], "id long, seen long, text string").schema
    store = incremental.snapshot_store(schema, f"{tmp_path}/store", "id", 8)
    for run, rows in enumerate([[(1, 1, "palkka"), (2, 1, "loma")], [(2, 2, "loma on"), (3, 2, "muu"), (3, 1, "vanha")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        incremental.follow(spark, land, schema, RULES, store, f"{tmp_path}/cp", "id", "seen").awaitTermination()
        assert run or store.read(spark, "documents", before=1).count() == 2
    got = {r.id: (r.text, r.topic) for r in store.read(spark, "documents").collect()}
    assert got == {1: ("palkka", "pay"), 2: ("loma on", "leave"), 3: ("muu", None)}


def test_new_versions_do_not_gather_in_one_task(spark):
    """Links without an old row have no old key to be joined by."""
    kinds = {"url": "long", "key": "long", "name": "string", "hash": "string", "valid_from": "string", "valid_until": "string", "is_parsed": "boolean", "is_current": "boolean"}
    both = lambda n, at: spark.range(n).select(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in (("name", "n"), ("hash", "h"), ("valid_from", None), ("valid_until", None), ("is_parsed", True), ("is_current", True))), (F.col("id") + at).alias("url"), (F.col("id") % 500).alias("key")).select(*kinds)
    old, new = both(100, 0), both(4000, 90).drop("is_parsed", "is_current")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        rows = merge.agreement_versions(old, new)[0].withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tasks = [r.task for r in rows]
    assert len(rows) == 4090 and max(map(tasks.count, set(tasks))) < 1000
    assert sum(r.is_current for r in rows) == 3990


def test_chunks_of_a_text_do_not_each_carry_it(spark):
    """Translations of long, repeated, blank and done texts; chunks are no rows beside their whole text."""
    long = "\n".join(f"line {k} " + "e" * 60 for k in range(200))
    texts = [long, long, " " * 600, "", None, "see", "see", "no"]
    rows = spark.createDataFrame([(k, x, "done" if k == 6 else None) for k, x in enumerate(texts)], "k int, t string, en string")
    load = lambda: lambda some: [x.replace("e", "3") if len(x) > 2 else None for x in some]
    done = inference.translate_pending(rows, "t", "en", load)
    found = {r.k: r.en for r in done.collect()}
    assert found[0] == found[1] == long.replace("e", "3").replace("\n", " ")
    assert [found[k] for k in range(2, 8)] == [None, "", None, "s33", "done", ""]
    assert "Generate" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_job_counts_move_no_text_to_be_counted(spark):
    rows = spark.createDataFrame([(1, "a b", None), (2, "a b", None), (3, "x", None), (4, None, None), (5, "a b", "done")], "k int, t string, en string")
    load = lambda: lambda some: [x.upper() if " " in x else None for x in some]
    counts = inference.translation_outcomes(rows, "t", "en", load).agg(F.sum("translated").alias("translated"), F.sum("skipped").alias("skipped"))
    assert tuple(counts.first()) == (2, 1)
    joins = [x for x in counts._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert len(joins) == 1 and "_digest" in joins[0]


def test_heads_that_share_a_word_do_not_meet_all_documents(spark):
    """The longest word is in every text and head; heads of few words, of none and under other topics are found as before."""
    texts = [f"begin {k} of an understanding between part{k} and part{k + 1} of it" for k in range(300)] + ["a (b) c", "...!?...", None]
    docs = spark.createDataFrame([(k, x, "s" if k != 7 else None) for k, x in enumerate(texts)], "k int, x string, topic string")
    heads = [x[4:56] for x in texts[:300]] + ["(b)", "!?.", "of an understanding between", None]
    items = spark.createDataFrame([(k, x, "s") for k, x in enumerate(heads)], "i int, h string, topic string")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = lookup.containing(docs, "k", "x", items, "i", "h", ("topic",))
        pairs = sorted(map(tuple, found.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert pairs == sorted((d, i) for d, x in enumerate(texts) for i, h in enumerate(heads) if x and h and d != 7 and h in x)
    made, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if "Join" in plan.nodeName():
            made.append(plan.metrics().apply("numOutputRows").value())
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    assert made and max(made) < 2000


def test_job_counts_with_states_in_another_table(spark, tmp_path):
    """Copies, null and empty texts, null and double keys and states, and tables without rows, as by the query's SQL."""
    import duckdb

    from lexmill.plans import catalog

    long = "\n".join(f"fish {k} " + "e" * 60 for k in range(200))
    some = [(1, "a sh"), (2, "a sh"), (2, "a sh"), (2, "b"), (3, None), (None, "b"), (None, "a sh"), (4, ""), (5, " " * 600), (6, long), (7, long), (8, "sh"), (9, "c"), (10, "b")]
    states = [(1, 1), (2, 0), (2, 1), (2, None), (7, 1), (9, 1), (10, 0), (None, 1), (99, 1)]
    for name, rows, known in (("some", some, states), ("unlabelled", some, []), ("none", [], [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(*x, 0) for x in known], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
        con = duckdb.connect()
        for table in ("documents", "labels"):
            con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
        assert tuple(catalog.queries()["uf05_job_counts"](spark, folder).first()) == con.sql(catalog.oracle_sql()["uf05_job_counts"]).fetchall()[0]


def test_job_counts_move_a_text_once(spark, tmp_path):
    """With states too many to be sent to all, shuffles hold little more than the texts."""
    from lexmill.plans import catalog

    rng = random.Random(5)
    texts = [" ".join(rng.randbytes(50).hex() for _ in range(20)) for _ in range(1500)]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 3, 0) for k in range(0, 1500, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    context = spark.sparkContext._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        assert catalog.queries()["uf05_job_counts"](spark, folder).first() is not None
        assert sum(map(len, texts)) / 2 < written() - before < 1.3 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
