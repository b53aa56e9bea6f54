"""Queries: second wordings, near misses and several matches in one text for the extractors of rates (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import rates
from lexmill.plans.registry import Tables, query

#: A number of the document in a clause and in what is expected of it.
N = "doc_id % 9 + 1"


def variants(name: str, topic: str, *cases: tuple[str, list[tuple[str, str]]]) -> None:
    """Register a query over clauses, one of the cases for each document; a case has the rows (rate_type, cents) that are read from it.

    {n} in a clause is the document's number, n in cents as well.
    """
    spoken = ["concat('" + clause.replace("\n", r"\n").replace("{n}", f"', {N}, '") + "')" for clause, _ in cases]
    clause = f"case doc_id % {len(cases)} " + " ".join(f"when {k} then {c}" for k, c in enumerate(spoken)) + " end"
    rows = [f"select doc_id, '{kind}' as rate_type, cast({cents.replace('n', f'({N})')} as bigint) as cents from documents where doc_id % {len(cases)} = {k}" for k, (_, found) in enumerate(cases) for kind, cents in found]

    def run(t: Tables) -> DataFrame:
        found = rates.extract(t.documents.select("doc_id", F.expr(clause).alias("text")), topic)
        return found.select("doc_id", "rate_type", (F.col("value") * 100).cast("long").alias("cents"))

    query(" union all ".join(rows), name=name)(run)


variants(
    "x12_expenses_variants", "expense_reimbursement",
    ("KOKOPÄIVÄRAHA  on {n},25€ ja osapäiväraha 5 €", [("daily_allowance_full_eur", "n * 100 + 25"), ("daily_allowance_part_eur", "500")]),
    ("Kokopäiväraha oli {n} euroa ja osapäiväraha 5 euroa", []),
    ("Matkalta ateriakorvaus {n} € ja 4 euron yömatkaraha", [("meal_compensation_eur", "n * 100"), ("night_travel_allowance_eur", "400")]),
    ("Huollosta  aiheutuvista kustannuksista korvataan {n} euroa kuukaudessa. Yömatkaraha {n} euroa", [("clothing_maintenance_eur", "n * 100")]),
    ("Huollosta aiheutuvista kustannuksista korvataan {n} euroa vuodessa", []),
)

variants(
    "x17_sick_leave_variants", "sick_leave",
    ("VARSINAINEN palkkansa enintään {n} kalenteripäivän ajalta ja sen jälkeen kaksi kolmasosaa ⅔ varsinaisesta palkastaan enintään 30kalenteripäivän ajalta", [("sick_pay_tier1_days", "n * 100"), ("sick_pay_tier1_pct", "10000"), ("sick_pay_tier2_days", "3000"), ("sick_pay_tier2_pct", "6667")]),
    ("Varsinainen palkkansa enintään {n} kalenteripäivän ajalta ja sen jälkeen puolet varsinaisesta palkastaan enintään 30 kalenteripäivän ajalta", []),
    ("Saada sairauspoissaolon ajalta varsinainen palkkansa {n}kalenteripäivän ajalta,jonka jälkeen ei suoriteta mitään palkkaetuja", [("sick_pay_short_tenure_days", "n * 100"), ("sick_pay_short_tenure_pct", "10000")]),
    ("Saada sairauspoissaolon ajalta varsinainen palkkansa {n} kalenteripäivän ajalta", []),
    ("lisäksi voidaan harkinnan mukaan maksaa kaksi kolmasosaa varsinaisesta palkasta enintään {n} kalenteripäivän  ajalta", [("sick_pay_tier3_discretionary_days", "n * 100")]),
)

TABLE = "Vuosilomapäivät (työpäiviä) {n} 2 3 4 5 6 7 8 9 10 11 12 loppu. "
variants(
    "x22_annual_leave_variants", "annual_leave",
    (TABLE * 3, [("annual_leave_days", c) for c in ["n * 100", *(f"{k}00" for k in range(2, 13))] * 3]),
    (TABLE * 2, []),
    ("oikeus {n} vuosilomapäivään, jos hänen täydeltä lomanmääräytymisvuodelta ansaitsemansa vuosiloma alittaa 30 vuosilomapäivää", [("annual_leave_min_days_illness", "n * 100")]),
    ("oikeus {n} vuosilomapäivään, jos hänen ansaitsemansa vuosiloma alittaa 30 vuosilomapäivää", []),
)

variants(
    "x04_overtime_variants", "overtime",
    ("1 mom. Vuorokautinen ylityö\n{n} ensimmaiselta ylityötunnista 50,5 prosentilla ja seuraavilta 100 prosentilla", [("overtime_rate_tier1_hours", "n * 100"), ("overtime_rate_tier1_pct", "5050"), ("overtime_rate_tier2_pct", "10000")]),
    ("1 mom. Vuorokautinen ylityö\n{n} ensimmäiseltä tunnilta 50 euroa ja seuraavilta 100 euroa", []),
    ("1 mom. Vuorokautinen ylityö\n{n} ensimmäiseltä tunnilta 50 %:lla", []),
)

variants(
    "x10_night_sunday_variants", "night_and_sunday_work",
    ("1 mom. Sunnuntaityö\n{n} %:n lisä", [("night_sunday_rate_pct", "n * 100")]),
    ("1 mom. Sunnuntaityö\nlisä on {n} euroa", []),
    ("1 mom. Muu työ\n{n} prosentin lisä", []),
)

variants(
    "x26_min_wage_variants", "min_wage",
    ("Palkka 1.6.2023 lukien {n} 246,50 €/kk", [("min_wage", "n * 100000 + 24650")]),
    ("Palkka 1.6.2023 on {n} 246,50 euroa", []),
)
