"""Queries: rate extractors, each over one clause a document that both engines build with the same expression (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import rates
from lexmill.plans.registry import Tables, query

N = "(doc_id % 9 + 1)"


def around(match: str, before: int = 40) -> str:
    """The source text of a match in DuckDB: so many letters before it and 40 after."""
    at = f"strpos(t, {match})"
    first = f"greatest({at} - {before}, 1)"
    return f"trim(substring(t, {first}, {at} - {first} + length({match}) + 40))"


def wording(name: str, topic: str, clause: str, *rows: tuple[str, str, str, str, str, str]) -> None:
    """Register a query; rows are (rate_type, context, cents, unit, source text, effective_from) in DuckDB, where t is the clause."""
    each = [f"select doc_id, {kind} as rate_type, {context} as context, cast({cents} as bigint) as cents, {unit} as unit, {source} as source, {since} as since from c" for kind, context, cents, unit, source, since in rows]

    def run(t: Tables) -> DataFrame:
        found = rates.extract(t.documents.select("doc_id", F.expr(clause).alias("text")), topic)
        return found.select("doc_id", "rate_type", "context", (F.col("value") * 100).cast("long").alias("cents"), "unit", F.col("source_text").alias("source"), F.col("effective_from").cast("string").alias("since"))

    query(f"with c as (select doc_id, {clause} as t from documents) {' union all '.join(each)}", name=name)(run)


NONE = "null::varchar"

wording(
    "x02_actor_steps", "min_wage", f"concat('Koulutetun näyttelijän (1234567) vähimmäisperuspalkka on ', {N}, ' 100,50 €/kk (1.1.2024) ja ', {N}, ' 200,00 € / kk (31.2.2025). Näyttelijän (7654321) vähimmäisperuspalkka on 1 900,00 €/kk (1.6.2024)')",
    ("'min_wage'", "'koulutettu_nayttelija'", f"({N} * 1000 + 100.5) * 100", "'eur_month'", "substring(t, 1, strpos(t, '1.1.2024)') + 8)", "'2024-01-01'"),
    ("'min_wage'", "'nayttelija'", "190000", "'eur_month'", "substring(t, strpos(t, 'Näyttelijän (7'))", "'2024-06-01'"),
)

DAY = f"concat({N} + 50, ' %:lla korotettu tuntipalkka kahdelta ensimmäiseltä vuorokautiselta tunnilta, sitten 100 %:lla')"
wording(
    "x05_compact_overtime", "overtime", f"concat('Palkka: ', {DAY})",
    *((f"'overtime_rate_tier{k}'", "'vuorokautinen'", cents, unit, "t", NONE) for k, cents, unit in (("1_hours", "200", "'hours'"), ("1_pct", f"({N} + 50) * 100", "'pct'"), ("2_pct", "10000", "'pct'"))),
)

wording(
    "x06_period_work", "overtime", f"concat('Jaksotyössä ', {N} + 50, ' %:lla korotettu palkka kahden viikon työaikajakson 12 ensimmäiseltä ja neljän ja kuuden viikon työaikajakson 24 ensimmäiseltä tunnilta, 100 %:lla kultakin seuraavalta')",
    *((f"'overtime_rate_tier{k}'", f"'jaksotyo_{weeks}vk'", cents, unit, around(f"'{match}'"), NONE) for weeks, hours, match in (("2", 12, "kahden viikon työaikajakson 12 ensimmäiseltä"), ("4-6", 24, "neljän ja kuuden viikon työaikajakson 24 ensimmäiseltä")) for k, cents, unit in (("1_hours", f"{hours}00", "'hours'"), ("1_pct", f"({N} + 50) * 100", "'pct'"), ("2_pct", "10000", "'pct'"))),
)

wording(
    "x13_meals", "expense_reimbursement", f"concat('Ateriakorvausta ', {N}, ',50 euroa tai ', {N}, ' euron suuruinen ateriakorvaus matkalta, joka jatkuu pitkään ja päättyy myöhään illalla')",
    ("'meal_compensation_eur'", "'tier1'", f"{N} * 100 + 50", "'eur'", around(f"concat('Ateriakorvausta ', {N}, ',50 euroa')"), NONE),
    ("'meal_compensation_eur'", "'tier2'", f"{N} * 100", "'eur'", around(f"concat({N}, ' euron suuruinen ateriakorvaus')"), NONE),
)

wording(
    "x15_clothing", "expense_reimbursement", f"concat('Vaatteiden huollosta aiheutuvista kustannuksista korvataan ', {N}, ' euroa kuukaudessa työntekijälle')",
    ("'clothing_maintenance_eur'", NONE, f"{N} * 100", "'eur_month'", "t", NONE),
)

wording(
    "x18_short_tenure", "sick_leave", f"concat('Hän voi saada sairauspoissaolon ajalta varsinainen palkkansa ', {N}, ' kalenteripäivän ajalta, jonka jälkeen ei suoriteta mitään palkkaetuja')",
    ("'sick_pay_short_tenure_days'", "'general'", f"{N} * 100", "'days'", "t", NONE), ("'sick_pay_short_tenure_pct'", "'general'", "10000", "'pct'", "t", NONE),
)

wording(
    "x19_discretionary", "sick_leave", f"concat(case when doc_id % 2 = 0 then 'Työtapaturma. ' else 'Muu syy. ' end, 'Lisäksi voidaan harkinnan mukaan maksaa kaksi kolmasosaa varsinaisesta palkasta enintään ', {N}, ' kalenteripäivän ajalta.')",
    ("'sick_pay_tier3_discretionary_days'", "case when doc_id % 2 = 0 then 'work_accident' else 'general' end", f"{N} * 100", "'days'", "t", NONE),
)

wording(
    "x23_ten_years", "annual_leave", f"concat({N}, ' vuoden palvelu Täysiä kuukausia 7 Vuosilomapäiviä ', {N} + 20, '. Jos palvelua on vähintään ', {N}, ' vuotta, hänen lomansa pituus on 25 vuosilomapäivän sijasta ', {N} + 21, ' vuosilomapäivää edellyttäen, että hän ansaitsee vuosilomaa 12 täydeltä')",
    ("'annual_leave_days'", f"concat('taulukko2_', {N}, 'y_m07')", f"({N} + 20) * 100", "'days'", around(f"concat({N}, ' vuoden palvelu Täysiä kuukausia 7 Vuosilomapäiviä ', {N} + 20)"), NONE),
    ("'annual_leave_days'", f"concat('taulukko2_', {N}, 'y_m12')", f"({N} + 21) * 100", "'days'", around(f"concat('vähintään ', {N}, ' vuotta, hänen lomansa pituus on 25 vuosilomapäivän sijasta ', {N} + 21, ' vuosilomapäivää edellyttäen, että hän ansaitsee vuosilomaa 12 täydeltä')"), NONE),
)

wording(
    "x24_leave_in_illness", "annual_leave", f"concat('Hänellä on oikeus ', {N} + 10, ' vuosilomapäivään, jos työntekijän täydeltä lomanmääräytymisvuodelta ansaitsemansa vuosiloma alittaa 24 vuosilomapäivää')",
    ("'annual_leave_min_days_illness'", NONE, f"({N} + 10) * 100", "'days'", "t", NONE),
)
