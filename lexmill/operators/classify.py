"""Topics by keyword rules, manual corrections, and tests of links and names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import after_label, has_keyword, text_key
from lexmill.operators.lookup import dimension


@dataclass(frozen=True)
class Keyword:
    topic: str
    keyword: str


def topic_of(text: Column, rules: list[Keyword]) -> Column:
    """The topic of the longest matching keyword, of equally long ones the greatest topic; null if none matches.

    Keywords are tried in that order, so a row is done with its first match. A rule table is a parameter of some
    hundred rows, not data.
    """
    lowered = F.lower(text)
    found = None
    for r in sorted(rules, key=lambda r: (len(r.keyword), r.topic), reverse=True):
        test = has_keyword(lowered, r.keyword.lower())
        found = F.when(test, F.lit(r.topic)) if found is None else found.when(test, F.lit(r.topic))
    return F.lit(None).cast("string") if found is None else found


def read_rules(rules: DataFrame, limit: int = 5_000) -> list[Keyword]:
    """A rule table (topic, keyword) as a parameter; more rows than the limit are an error."""
    rows = rules.select("topic", "keyword").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a rule table has at most {limit} rows")
    return [Keyword(r.topic, r.keyword) for r in rows]


def title_then_body(title: Column, body: Column, rules: list[Keyword], letters: int = 500) -> Column:
    return F.coalesce(topic_of(title, rules), topic_of(F.substring(body, 1, letters), rules))


def is_noise_title(title: Column, stop: list[str]) -> Column:
    """Titles that say nothing: short ones, questions, stop phrases, short numbered ones."""
    lowered = F.lower(F.trim(title))
    stops = F.lit(False)
    for s in stop:
        stops = stops | lowered.contains(s)
    return (F.length(lowered) < 4) | lowered.endswith("?") | stops | (lowered.rlike(r"^\d+[.)]?\s") & (F.length(lowered) < 15))


def title_without_noise(title: Column, body: Column, rules: list[Keyword], stop: list[str], letters: int = 1000) -> Column:
    return F.coalesce(F.when(~is_noise_title(title, stop), topic_of(after_label(title), rules)), topic_of(F.substring(body, 1, letters), rules))


def relink(clauses: DataFrame, overrides: DataFrame, rules: list[Keyword], known: DataFrame, letters: int | None = None) -> DataFrame:
    """clauses (agreement_key, text, topic) with new_topic and outcome: linked, unlinked, unchanged or unknown_topic.

    An override of (agreement_key, md5 of the text) wins even where it is null: it means "no topic". A detected topic
    that `known` (topic) does not hold is skipped. Applying is to keep new_topic where outcome is linked or unlinked.
    """
    fixed = overrides.select("agreement_key", F.col("text_hash").alias("_h"), F.col("topic").alias("_fixed"), F.lit(True).alias("_hit"))
    body = F.col("text") if letters is None else F.substring("text", 1, letters)
    joined = clauses.withColumn("_h", text_key(F.col("text"))).join(dimension(fixed), ["agreement_key", "_h"], "left")
    wanted = joined.withColumn("new_topic", F.when(F.col("_hit"), F.col("_fixed")).otherwise(topic_of(body, rules)))
    checked = wanted.join(dimension(known.select(F.col("topic").alias("new_topic"), F.lit(True).alias("_known"))), "new_topic", "left")
    outcome = F.when(F.col("new_topic").isNotNull() & F.col("_known").isNull(), "unknown_topic").when(F.col("new_topic").eqNullSafe(F.col("topic")), "unchanged").when(F.col("new_topic").isNull(), "unlinked").otherwise("linked")
    return checked.withColumn("outcome", outcome).drop("_h", "_hit", "_fixed", "_known")


def eligible_url(url: Column, marker: str, domain: str, catalogue: str, depth: int | None = None, excluded: list[str] = ()) -> Column:
    """Links of a catalogue: they hold the marker and the domain, are not the catalogue, nothing excluded, and have the wanted depth."""
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+", ""), r"[?#].*$", "")
    test = url.contains(marker) & url.contains(domain) & (F.rtrim(url, F.lit("/")) != catalogue.rstrip("/"))
    for e in excluded:
        test = test & ~url.contains(e)
    return test & (F.size(F.filter(F.split(path, "/"), lambda x: x != "")) == depth) if depth is not None else test


def has_stop_word(name: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(name).contains(w)) if words else F.lit(False)


def reject_reason(slug: Column, catalogue: str, generic: list[str]) -> Column:
    """Why a discovered key is no key, or null."""
    return F.when(F.coalesce(F.trim(slug), F.lit("")) == "", "empty").when(slug == catalogue, "catalogue").when(F.lower(slug).isin(generic) if generic else F.lit(False), "generic")


def first_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")
