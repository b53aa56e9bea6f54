"""Keyword and condition indexes against plain versions, with many rules and without rules meeting all rows."""

import random

from pyspark.sql import functions as F

from lexmill.operators import classify, keywords
from lexmill.operators.conditions import conditions_of, inputs_of, match_rules


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(4)
    letters = "abcdeåäö"
    word = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    table = [(f"t{k % 50:02d}", word(9, 14)) for k in range(100_000)] + [("short", "aa"), ("short", "b.c"), ("tie", "abcdef"), ("tiz", "ABCDEF"), ("none", ""), ("none", None), ("long", "deep " * 40 + "end")]
    picked = [rng.choice(table[:100_000])[1] for _ in range(40)]
    texts = [f"{word(1, 5)} {word(0, 3)}{kw.upper()}{word(0, 3)} tail" for kw in picked] + ["x aa, y", "xaa aax", "b.c", "ab.cd", "zABCDEFz", "", None, "deep " * 40 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = keywords.topic_by_index(docs, spark.createDataFrame(table, "topic string, keyword string"), "t", "k")
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    got = {r.k: r.topic for r in found.collect()}

    def best(text):
        low = (text or "").lower()
        hits = [(len(k), t) for t, k in table if k and k.lower() in low and (len(k) >= 6 or any((i == 0 or not (low[i - 1].isalnum() or low[i - 1] == "_")) and (i + len(k) == len(low) or not (low[i + len(k)].isalnum() or low[i + len(k)] == "_")) for i in range(len(low)) if low.startswith(k.lower(), i)))]
        return max(hits)[1] if hits else None

    assert got == {k: best(t) for k, t in enumerate(texts)}


def test_the_index_agrees_with_conditions_in_order_whatever_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK", 7)
    rules = [classify.Keyword("pay", "palkka"), classify.Keyword("leave", "loma"), classify.Keyword("wages", "palkat"), classify.Keyword("leave", "vuosiloma")]
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["loma", "lomautus", "minimipalkkaa", "Palkat", "x.y", "vuosilomaa"]) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    table = spark.createDataFrame([(r.topic, r.keyword) for r in rules], "topic string, keyword string")
    wanted = {r.k: r.topic for r in docs.select("k", classify.topic_of(F.col("t"), rules).alias("topic")).collect()}
    for limit in (1000, 2):
        assert {r.k: r.topic for r in keywords.topic_by_index(docs, table, "t", "k", limit=limit).collect()} == wanted
    assert {r.topic for r in keywords.topic_by_index(docs, table.limit(0), "t", "k").collect()} == {None}


def holds(op, given, wanted):
    if op == "eq":
        return given == wanted
    return given is not None and wanted is not None and {"lt": given < wanted, "lte": given <= wanted, "gt": given > wanted, "gte": given >= wanted}[op]


def test_many_rules_with_many_bounds(spark):
    rng = random.Random(8)
    rules = [(k, f"t{k % 3}", rng.randint(0, 5)) for k in range(3000)]
    conditions = [(k, rng.choice("abc"), rng.choice(["eq", "lt", "lte", "gt", "gte"]), rng.choice([None, -0.0, 0.0, *[rng.randint(-500, 500) / 4 for _ in range(30)]]), None) for k, _, _ in rules for _ in range(rng.randint(2, 4))]
    conditions += [(5, "a", "odd", 1.0, None), (7, "s", "eq", None, "x")]
    requests = [(k, f"t{k % 4}") for k in range(120)]
    inputs = [(k, f, rng.choice([None, 0.0, rng.randint(-500, 500) / 4, rng.uniform(-130, 130)]), None) for k, _ in requests for f in "abc" if rng.random() < 0.8] + [(k, "s", None, "x") for k in range(0, 120, 2)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = match_rules(table(requests, "request_id long, topic string"), table(inputs, "request_id long, field string, num double, str string"), table(rules, "rule_id long, topic string, priority int"), table(conditions, "rule_id long, field string, op string, num double, str string"))
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    got = {r.request_id: r.rule_id for r in found.collect()}
    by_rule = {}
    for k, f, op, num, text in conditions:
        by_rule.setdefault(k, []).append((f, op, num, text))
    for q, topic in requests:
        given = {f: (num, text) for k, f, num, text in inputs if k == q}
        fits = [(-p, k) for k, t, p in rules if t == topic and all(op == "odd" or (given.get(f, (None, None)) == (num, text) if op == "eq" else holds(op, given.get(f, (None, None))[0], num)) for f, op, num, text in by_rule[k])]
        assert got.get(q) == (min(fits)[1] if fits else None), q


def test_conditions_and_inputs_from_json(spark):
    rows = [(1, "{}"), (2, '{"a": 1, "b": "x", "c": true, "d": null, "e": {"gte": 1.5, "lt": "z", "eq": null}}'), (3, "no json"), (4, None), (5, "[1]"), (6, '{"a": {}}')]
    found = conditions_of(spark.createDataFrame(rows, "rule_id long, conditions string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(2, "a", "eq", 1.0, None), (2, "b", "eq", None, "x"), (2, "c", "eq", 1.0, None), (2, "d", "eq", None, None), (2, "e", "gte", 1.5, None), (2, "e", "lt", None, "z"), (2, "e", "eq", None, None)], key=str)
    given = inputs_of(spark.createDataFrame([(1, '{"a": 2, "b": [1], "c": {"x": 1}, "d": null, "e": false, "f": "s"}'), (2, None), (3, "?")], "request_id long, inputs string")).collect()
    assert sorted(map(tuple, given), key=str) == sorted([(1, "a", 2.0, None), (1, "d", None, None), (1, "e", 0.0, None), (1, "f", None, "s")], key=str)
