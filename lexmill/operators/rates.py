"""Rates out of clause texts: declared patterns become typed rows, without leaving the JVM.

Each extractor gives rows (rate_type, context, value, unit, source_text, effective_from) for a key and a text. A source text is
the match with 40 letters around it, white space squeezed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import excerpt, let, matches, squeeze, strip
from lexmill.functions.values import NUMBER_WORDS, dmy, locale_decimal, number_word

# The wordings of the source language that rates are read from. In Java's notation, groups by number.
DAY = r"\d{1,2}\.\d{1,2}\.\d{4}"
NUMBER = r"\d+(?:,\d+)?"
FIRST = r"ensimm(?:äi|ai)selt[äa]"
EURO = r"\s*(?:euroa|€)"
WORDS = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
PATTERNS = {
    "date_amount": rf"(?iu)({DAY})\s+(?:alkaen|lukien)\s+(\d[\d\s\xa0]*(?:,\d{{2}})?)(?:\s*(?:€/kk|euroa|€))?",
    "actor_header": r"(?iu)(koulutetun\s+)?näyttelijän\s*\((\d{6,8})\)\s+vähimmäisperuspalkka\s+on",
    "actor_amount": rf"(?iu)(\d{{1,3}}(?:[ \xa0]\d{{3}})*,\d{{2}})\s*€\s*/\s*kk\s*\(\s*({DAY})\s*\)",
    "overtime": rf"(?iu)(\d+)\s+{FIRST}\s+(?:ylityö)?tunni(?:lta|sta).{{0,80}}?({NUMBER})\s*(?:%(?::lla)?|prosentilla).{{0,80}}?({NUMBER})\s*(?:%(?::lla)?|prosentilla)",
    "compact_day": rf"(?iu)({NUMBER})\s*%:lla\s+korotettu\s+[\wäöåÄÖÅ]+\s+([a-zäö]+|\d+)\s+{FIRST}\s+vuorokautis[\wäöå]*.{{0,80}}?({NUMBER})\s*%:lla",
    "compact_week": rf"(?iu)({NUMBER})\s*%:lla\s+korotettu\s+[\wäöåÄÖÅ]+\s+viikoittais[\wäöå]*\s+ylityön\s+([a-zäö]+|\d+)\s+{FIRST}.{{0,80}}?({NUMBER})\s*%:lla",
    "period_zone": r"(?iu)jaksoty",
    "period_tier1": rf"(?iu)jaksoty[\wäöå]*.{{0,40}}?({NUMBER})\s*%:lla",
    "period_tier2": rf"(?iu)({NUMBER})\s*%:lla.{{0,40}}?kultakin\s+seuraavalta",
    "period": rf"(?iu)((?:{WORDS})(?:\s+ja\s+(?:{WORDS}))?)\s+viikon\s+työaikajakson\s+(\d+)\s+{FIRST}",
    "head_before": r"\d+\s*mom\.[ \t]*([^\n]*)",
    "head_after": r"([^\n]*?)[ \t]+\d+\s*mom\.",
    "head_above": r"(?m)^([^\n.,]{3,40}?)[ \t]*\n[ \t]*\n(\d+)[ \t]*mom\.[ \t]*$",
    "percent": rf"(?iu)({NUMBER})\s*(?:%(?::n)?|prosentin)",
    "full_rate": r"(?iu)\bkorottamaton\s+tuntipalkka\b",
    "double_rate": r"(?iu)kaksinkertais",
    "daily": rf"(?iu)Kokopäiväraha\s+on\s+({NUMBER}){EURO}\s+ja\s+osapäiväraha\s+({NUMBER}){EURO}",
    "meal": rf"(?iu)ateriakorvaus(?:ta)?\s+({NUMBER}){EURO}|({NUMBER})\s*euron\s+suuruinen\s+ateriakorvaus",
    "night_travel": rf"(?iu)({NUMBER})\s*euron\s+yömatkaraha",
    "clothing": rf"(?iu)huollosta\s+aiheutuvista\s+kustannuksista\s+korvataan\s+({NUMBER})\s*euroa\s+kuukaudessa",
    "sick_ladder": r"(?iu)varsinainen(?:\s+palkkansa|en\s+palkkansa)\s+enintään\s+(\d+)\s*kalenteripäivän ajalta\s+ja\s+sen\s+jälkeen\s+kaksi\s+kolmasosaa\s*\(?⅔\)?\s*varsinaisesta\s+palkastaan\s+enintään\s+(\d+)\s*kalenteripäivän ajalta",
    "sick_short": r"(?iu)saada\s+sairauspoissaolon\s+ajalta\s+varsinainen\s+palkkansa\s+(\d+)\s*kalenteripäivän\s+ajalta,\s*jonka\s+jälkeen\s+ei\s+suoriteta\s+mitään\s+palkkaetuja",
    "sick_more": r"(?iu)Lisäksi\s+voidaan\s+harkinnan\s+mukaan\s+maksaa\s+kaksi\s+kolmasosaa\s+varsinaisesta\s+palkasta\s+enintään\s+(\d+)\s*kalenteripäivän\s+ajalta",
    "accident": r"työtapaturma|ammattitauti|tapaturmavakuutuslainsäädännössä|työtehtävistä\s+johtuneesta\s+väkivallasta",
    "leave_table": r"Vuosilomapäiv[\wäöå]+(?:\s*\(työpäiviä\))?\s+((?:\d{1,2}\s+){11}\d{1,2})(?!\d)",
    "leave_label": r"Taulukko\s+(\d)\s+Täysiä",
    "leave_ten_inline": r"(?iu)(\d+)\s+vuoden\s+palvelu\s+Täysiä[^\d]*?(\d{1,2})\s+Vuosilomapäiv[\wäöå]+(?:\s*\(työpäiviä\))?\s+(\d{1,2})(?!\d)",
    "leave_ten_prose": r"(?iu)vähintään\s+(\d+)\s+vuotta,\s+hänen\s+lomansa\s+pituus\s+on\s+\d+\s+vuosilomapäivän\s+sijasta\s+(\d+)\s+vuosilomapäivää\s+edellyttäen,\s+että\s+hän\s+ansaitsee\s+vuosilomaa\s+(\d+)\s+täydeltä",
    "leave_illness": r"(?iu)oikeus\s+(\d+)\s+vuosilomapäivään,\s+jos\s+(?:hänen|työntekijän)\s+täydeltä\s+lomanmääräytymisvuodelta\s+ansaitsemansa\s+vuosiloma\s+alittaa\s+\d+\s+vuosilomapäivää",
}
TWO_THIRDS = "66.67"

ROW = "array<struct<rate_type:string,context:string,value:decimal(10,2),unit:string,source_text:string,effective_from:date>>"


def _row(rate_type: str, value: Column, unit: str, source: Column, context: Column | str | None = None, since: Column | None = None) -> Column:
    named = context if isinstance(context, Column) else F.lit(context).cast("string")
    start = F.lit(None).cast("date") if since is None else since
    return F.struct(F.lit(rate_type).alias("rate_type"), named.alias("context"), value.cast("decimal(10,2)").alias("value"), F.lit(unit).alias("unit"), source.alias("source_text"), start.alias("effective_from"))


def _each(text: Column, name: str, groups: int, rows: Callable[[Column, Column], list[Column]], before: int = 40) -> Column:
    """The rows of every match; those with a value that cannot be read are left out."""
    made = F.transform(matches(text, PATTERNS[name], groups), lambda m: F.array(*rows(m["g"], excerpt(text, m["start"], m["end"], before))))
    return F.filter(F.flatten(made), lambda r: r["value"].isNotNull())


def _first(text: Column, name: str, groups: int) -> Column:
    return F.get(matches(text, PATTERNS[name], groups), F.lit(0))


def _tiers(context: Column | str, hours: Column, tier1: Column, tier2: Column, source: Column) -> list[Column]:
    return [_row("overtime_rate_tier1_hours", hours, "hours", source, context), _row("overtime_rate_tier1_pct", tier1, "pct", source, context), _row("overtime_rate_tier2_pct", tier2, "pct", source, context)]


def mom_segments(text: Column) -> Column:
    """array<struct<title,body>>: the family of headers with the most filled titles cuts the text; without any it is one segment."""
    families = [matches(text, PATTERNS[p], 1) for p in ("head_before", "head_after", "head_above")]
    filled = [F.size(F.filter(f, lambda m: strip(m["g"][1]) != "")) for f in families]
    best = F.when((filled[0] >= filled[1]) & (filled[0] >= filled[2]), families[0]).when(filled[1] >= filled[2], families[1]).otherwise(families[2])

    def cut(found: Column) -> Column:
        end = lambda i: F.coalesce(F.get(found, i + 1)["start"], F.length(text))
        return F.transform(found, lambda m, i: F.struct(strip(m["g"][1]).alias("title"), strip(F.substring(text, m["start"] + 1, end(i) - m["start"])).alias("body")))

    return let(best, lambda f: F.when(F.size(f) > 0, cut(f)).otherwise(F.array(F.struct(F.lit("").alias("title"), text.alias("body")))))


def overtime_mode(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.contains("vuorokautinen") | low.contains("vuorokautista"), "vuorokautinen").when(low.contains("viikoittainen") | low.contains("viikoittaista"), "viikoittainen")


def night_mode(title: Column) -> Column:
    low = F.lower(title)
    found = F.when(low.contains("sunnuntai"), "sunnuntai").when(low.contains("lauantai"), "lauantai").when(low.contains("aatto"), "aatto").when(low.contains("ilta"), "ilta")
    return found.when(low.contains("yötyö") | low.contains("yölisä") | low.contains("yökorvaus"), "yo")


def _compact(text: Column) -> Column:
    """First daily and weekly wording, then period work with one pair of rates and many thresholds."""
    parts = []
    for name, mode in (("compact_day", "vuorokautinen"), ("compact_week", "viikoittainen")):
        m = _first(text, name, 3)
        hours = number_word(m["g"][2])
        parts.append(F.when(hours.isNotNull(), F.array(*_tiers(mode, hours, locale_decimal(m["g"][1]), locale_decimal(m["g"][3]), excerpt(text, m["start"], m["end"])))).otherwise(F.array().cast(ROW)).cast(ROW))
    zone = F.when(text.rlike(PATTERNS["period_zone"]), F.substring(text, F.regexp_instr(text, F.lit(PATTERNS["period_zone"])), F.length(text)))
    tier1, tier2 = (locale_decimal(F.nullif(F.regexp_extract(zone, PATTERNS[p], 1), F.lit(""))) for p in ("period_tier1", "period_tier2"))
    weeks = lambda words: F.concat(F.lit("jaksotyo_"), F.array_join(F.transform(F.split(words, r"\s+ja\s+"), number_word), "-"), F.lit("vk"))
    periods = F.flatten(F.transform(matches(zone, PATTERNS["period"], 2), lambda m: F.array(*_tiers(weeks(m["g"][1]), locale_decimal(m["g"][2]), tier1, tier2, excerpt(zone, m["start"], m["end"])))))
    parts.append(F.when(tier1.isNotNull() & tier2.isNotNull(), periods).otherwise(F.array().cast(ROW)).cast(ROW))
    return F.concat(*parts)


def overtime(text: Column) -> Column:
    case1 = lambda s: _each(s["body"], "overtime", 3, lambda g, src: _tiers(overtime_mode(s["title"]), *(locale_decimal(g[k]) for k in (1, 2, 3)), src))
    return F.flatten(F.transform(mom_segments(text), lambda s: F.when(overtime_mode(s["title"]).isNotNull(), case1(s).cast(ROW)).otherwise(_compact(s["body"]))))


def night_sunday(text: Column) -> Column:
    def rate(s: Column) -> Column:
        body, mode = s["body"], night_mode(s["title"])
        first = {p: _first(body, p, 1 if p == "percent" else 0) for p in ("percent", "full_rate", "double_rate")}
        one = lambda p, value: F.array(_row("night_sunday_rate_pct", value, "pct", excerpt(body, first[p]["start"], first[p]["end"]), mode))
        found = F.when(first["percent"].isNotNull(), one("percent", locale_decimal(first["percent"]["g"][1])))
        for p in ("full_rate", "double_rate"):
            found = found.when(first[p].isNotNull(), one(p, F.lit(100)))
        return F.when(mode.isNotNull(), F.coalesce(found, F.array().cast(ROW))).otherwise(F.array().cast(ROW)).cast(ROW)

    return F.flatten(F.transform(mom_segments(text), rate))


def min_wage(text: Column) -> Column:
    steps = _each(text, "date_amount", 2, lambda g, src: [_row("min_wage", locale_decimal(g[2]), "eur_month", src, "harjoittelija", dmy(g[1]))])
    heads = matches(text, PATTERNS["actor_header"], 2)

    def pairs(found: Column) -> Column:
        def of(h: Column, i: Column) -> Column:
            zone = F.substring(text, h["end"] + 1, F.coalesce(F.get(found, i + 1)["start"], F.length(text)) - h["end"])
            context = F.when(h["g"][1] != "", "koulutettu_nayttelija").otherwise("nayttelija")
            return F.transform(matches(zone, PATTERNS["actor_amount"], 2), lambda m: _row("min_wage", locale_decimal(m["g"][1]), "eur_month", squeeze(F.substring(text, h["start"] + 1, h["end"] + m["end"] - h["start"])), context, dmy(m["g"][2])))

        return F.flatten(F.transform(found, of))

    dated = lambda rows: F.filter(rows, lambda r: r["value"].isNotNull() & r["effective_from"].isNotNull())
    return F.concat(dated(steps).cast(ROW), dated(let(heads, pairs)).cast(ROW))


def expenses(text: Column) -> Column:
    euro = locale_decimal
    tier = lambda g: F.when(g[1] != "", "tier1").otherwise("tier2")
    return F.concat(
        _each(text, "daily", 2, lambda g, s: [_row("daily_allowance_full_eur", euro(g[1]), "eur", s), _row("daily_allowance_part_eur", euro(g[2]), "eur", s)]).cast(ROW),
        _each(text, "meal", 2, lambda g, s: [_row("meal_compensation_eur", euro(F.when(g[1] != "", g[1]).otherwise(g[2])), "eur", s, tier(g))]).cast(ROW),
        _each(text, "night_travel", 1, lambda g, s: [_row("night_travel_allowance_eur", euro(g[1]), "eur", s)]).cast(ROW),
        _each(text, "clothing", 1, lambda g, s: [_row("clothing_maintenance_eur", euro(g[1]), "eur_month", s)]).cast(ROW),
    )


def sick_leave(text: Column) -> Column:
    context = F.when(F.lower(F.substring(text, 1, 200)).rlike(PATTERNS["accident"]), "work_accident").otherwise("general")
    days = locale_decimal
    return F.concat(
        _each(text, "sick_ladder", 2, lambda g, s: [_row("sick_pay_tier1_days", days(g[1]), "days", s, context), _row("sick_pay_tier1_pct", F.lit(100), "pct", s, context), _row("sick_pay_tier2_days", days(g[2]), "days", s, context), _row("sick_pay_tier2_pct", F.lit(TWO_THIRDS), "pct", s, context)]).cast(ROW),
        _each(text, "sick_short", 1, lambda g, s: [_row("sick_pay_short_tenure_days", days(g[1]), "days", s, context), _row("sick_pay_short_tenure_pct", F.lit(100), "pct", s, context)]).cast(ROW),
        _each(text, "sick_more", 1, lambda g, s: [_row("sick_pay_tier3_discretionary_days", days(g[1]), "days", s, context)]).cast(ROW),
    )


def annual_leave(text: Column) -> Column:
    labels = F.regexp_extract_all(text, F.lit(PATTERNS["leave_label"]), F.lit(1))
    month = lambda m: F.lpad(m.cast("string"), 2, "0")

    def tables(found: Column) -> Column:
        def rows(m: Column, t: Column) -> Column:
            source = excerpt(text, m["start"], m["end"], before=100)
            return F.transform(F.split(strip(m["g"][1]), r"\s+"), lambda d, i: _row("annual_leave_days", locale_decimal(d), "days", source, F.concat(F.lit("taulukko"), t + 1, F.lit("_m"), month(i + 1))))

        in_order = (F.size(labels) == 0) | (labels == F.array(F.lit("1"), F.lit("2"), F.lit("3")))
        return F.when((F.size(found) == 3) & in_order, F.flatten(F.transform(found, rows))).otherwise(F.array().cast(ROW))

    ten = lambda y, m: F.concat(F.lit("taulukko2_"), y.cast("int"), F.lit("y_m"), month(m.cast("int")))
    return F.concat(
        let(matches(text, PATTERNS["leave_table"], 1), tables).cast(ROW),
        _each(text, "leave_ten_inline", 3, lambda g, s: [_row("annual_leave_days", locale_decimal(g[3]), "days", s, ten(g[1], g[2]))]).cast(ROW),
        _each(text, "leave_ten_prose", 3, lambda g, s: [_row("annual_leave_days", locale_decimal(g[2]), "days", s, ten(g[1], g[3]))]).cast(ROW),
        _each(text, "leave_illness", 1, lambda g, s: [_row("annual_leave_min_days_illness", locale_decimal(g[1]), "days", s)]).cast(ROW),
    )


#: Extractors by topic; add to it to register one.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "min_wage": min_wage,
    "overtime": overtime,
    "night_and_sunday_work": night_sunday,
    "expense_reimbursement": expenses,
    "sick_leave": sick_leave,
    "annual_leave": annual_leave,
}


def extract(clauses: DataFrame, topic: str, text: str = "text") -> DataFrame:
    """The clauses' other columns with one row a rate, in order of emission (ord)."""
    kept = [c for c in clauses.columns if c != text]
    return clauses.select(*kept, F.posexplode(EXTRACTORS[topic](F.col(text))).alias("ord", "_r")).select(*kept, "ord", "_r.*")


def with_start(rates: DataFrame, agreements: DataFrame, key: str) -> DataFrame:
    """rates with effective_from of their agreement where the text gave none."""
    valid = agreements.select(key, F.col("valid_from").alias("_v"))
    return rates.join(valid, key, "left").withColumn("effective_from", F.coalesce("effective_from", "_v")).drop("_v")
