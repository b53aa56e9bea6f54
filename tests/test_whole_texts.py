import re

from lexmill.plans import documents
from lexmill.plans.registry import Tables


def brute_clauses(text):
    heads = [m for m in re.finditer(r"(?m)^[ \t]*(\d+)\s*§[ \t]*([^\n]*)$", text) if not re.search(r"(\.{3,}|\s)\s*\d+\s*$", m[2]) and not re.match(r"[:)]", m[2].strip())]
    for k, m in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        body = text[m.end() : min(end, m.end() + 30_000)].strip()
        if len(body) >= 100:
            yield k, m[1], m[2].strip(" "), body, m.start()


def test_clauses_of_whole_texts(spark, tmp_path):
    rows = [(1, "short"), (2, "a line of prose. " * 40), (3, "long " * 9000), (4, "one\n7 § Own header\n" + "é🙂 body " * 60), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in documents.c15_clauses(Tables(spark, str(tmp_path))).collect())
    wanted = []
    for d, t in rows:
        text = f"Intro {d}\n1 § Scope ... 3\n1 § Scope\n{t.ljust(120, 'x')}\n2 § Terms\nshort\n3 § Pay\n{t.ljust(200, 'y')}"
        wanted += [(d, *x) for x in brute_clauses(text)]
    assert found == sorted(wanted)
    assert max(len(r[4]) for r in found) >= 29_999
