"""Answers over several tables: a topic with its sections, guidance and best rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.conditions import match_rules
from lexmill.operators.lookup import dimension, nest


def topic_page(topics: DataFrame, links: DataFrame, sections: DataFrame, paragraphs: DataFrame, guidance: DataFrame) -> DataFrame:
    """topics with sections (most relevant first, each with its ordered paragraphs) and guidance, empty where there is none."""
    full = nest(sections, paragraphs, "section_id", ["order_index"], "paragraphs")
    linked = links.join(full, "section_id").withColumn("_rank", -F.col("relevance"))
    with_sections = nest(topics, linked.select("topic", "_rank", "section_id", "relevance", "number", "title", "paragraphs"), "topic", ["_rank", "section_id"], "sections")
    return nest(with_sections, guidance, "topic", ["guidance_id"], "guidance")


def situations(requests: DataFrame, inputs: DataFrame, page: DataFrame, rules: DataFrame, conditions: DataFrame, groups: DataFrame) -> DataFrame:
    """One answer a request (request_id, topic, sector_group): the topic's page, guidance of the group's sectors, the first rule that holds.

    Requests of unknown topics have no answer; without a matching rule its columns are null. groups: (sector_group, sector);
    guidance without a sector is for everyone; a group that is not listed filters nothing.
    """
    best = match_rules(requests.select("request_id", "topic"), inputs, rules.select("rule_id", "topic", "priority"), conditions)
    answered = best.join(dimension(rules.select("rule_id", "answer")), "rule_id")
    listed = groups.groupBy("sector_group").agg(F.collect_set("sector").alias("_sectors"))
    joined = requests.join(dimension(page), "topic").join(dimension(listed), "sector_group", "left").join(answered, "request_id", "left")
    fits = lambda g: F.col("_sectors").isNull() | g["sector"].isNull() | F.array_contains(F.col("_sectors"), g["sector"])
    return joined.withColumn("guidance", F.filter("guidance", fits)).drop("_sectors")


def as_json(page: DataFrame, key: str, name: str = "body") -> DataFrame:
    """(key, body): each row as one JSON object, nulls written out, nested rows as arrays of objects in their order."""
    return page.select(key, F.to_json(F.struct(*page.columns), {"ignoreNullFields": "false"}).alias(name))
