"""Rules with conditions on typed inputs, matched by a counting index, and conditions and inputs read from JSON.

A condition becomes keys: an equality one, a bound the dyadic intervals that make up its side of the scale. An input
becomes the keys that it can meet: its equality and, on every level, the interval that it lies in; it meets a bound that it
satisfies in exactly one of them. A rule holds where its number of met conditions is its number of conditions, so
requests and rules never meet but through conditions that hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.lookup import BROADCAST_ROWS

BOUNDS = ("lt", "lte", "gt", "gte")


def _equality(topic: Column, field: Column, num: Column, text: Column) -> Column:
    """One number for a value; null is a value, and zero has no sign."""
    number = F.when(num == 0, F.lit(0.0)).otherwise(num)
    return F.xxhash64(F.lit("eq"), topic, field, num.isNull(), number, text.isNull(), text)


def _interval(topic: Column, field: Column, level: Column, place: Column) -> Column:
    return F.xxhash64(F.lit("in"), topic, field, level, place)


def _place(bounds: Column, value: Column) -> Column:
    """Where a value lies among sorted bounds: 2k + 1 on the k-th one, 2k below it; found by halving."""
    steps = F.sequence(F.ceil(F.log2(F.size(bounds) + 1)).cast("int"), F.lit(0), F.lit(-1))

    def halve(at: Column, step: Column) -> Column:
        on = at + F.call_function("shiftleft", F.lit(1), step)
        return F.when((on <= F.size(bounds)) & (F.get(bounds, on - 1) < value), on).otherwise(at)

    below = F.aggregate(steps, F.lit(0), halve)
    return 2 * below + F.coalesce(F.get(bounds, below) == value, F.lit(False)).cast("int")


def _up_to(last: Column, levels: int) -> Column:
    """The dyadic intervals (level, place) that make up 0 to last."""
    n = (last + 1).cast("long")
    bit = lambda level: F.call_function("shiftright", n, level)
    listed = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), (bit(level) - 1).alias("place"), (bit(level) % 2 == 1).alias("own")))
    return F.transform(F.filter(listed, lambda x: x["own"]), lambda x: F.struct(x["level"], x["place"]))


def _from(first: Column, levels: int) -> Column:
    """The dyadic intervals that make up first to the end of the scale: those of its mirror image."""
    mirrored = _up_to((F.lit(1 << levels) - 1 - first).cast("long"), levels)
    return F.transform(mirrored, lambda x: F.struct(x["level"].alias("level"), (F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(levels) - x["level"]) - 1 - x["place"]).alias("place")))


def match_rules(requests: DataFrame, inputs: DataFrame, rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """(request_id, rule_id) of the first rule, by priority from high to low and then by rule_id, whose conditions all hold.

    requests: (request_id, topic); inputs: (request_id, field, num, str), a field at most once a request; rules: (rule_id,
    topic, priority), an id at most once; conditions: (rule_id, field, op, num, str) with op eq, lt, lte, gt or gte, others
    being ignored. A missing input fails every comparison but equality with null. A rule without conditions always holds.
    Requests no rule fits are left out.
    """
    known = conditions.where(F.col("op").isin("eq", *BOUNDS)).select("rule_id", "field", "op", F.col("num").cast("double").alias("num"), F.col("str").alias("str")).join(rules.select("rule_id", "topic"), "rule_id")
    counted = rules.select("rule_id", "topic", "priority").join(known.groupBy("rule_id").agg(F.count(F.lit(1)).alias("wanted")), "rule_id", "left").withColumn("rank", F.struct("priority", (-F.col("rule_id")).alias("minus")))
    per_field = known.groupBy("topic", "field").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("op").isin(*BOUNDS), F.when(F.col("num") == 0, F.lit(0.0)).otherwise(F.col("num"))))).alias("bounds"))
    sizes = per_field.agg(F.sum("n").alias("n"), F.max(F.size("bounds")).alias("most")).first()
    most, n_conditions = sizes["most"] or 0, sizes["n"] or 0  # bounds of one field, conditions of all
    levels = max(1, (2 * most + 1).bit_length())
    is_small = rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and n_conditions * (levels + 1) <= BROADCAST_ROWS
    sized = F.broadcast if is_small else lambda df: df
    bounds = sized(per_field.where(F.size("bounds") > 0).select("topic", "field", "bounds"))
    value = F.when(F.col("num") == 0, F.lit(0.0)).otherwise(F.col("num"))
    placed = known.where(F.col("op").isin(*BOUNDS)).join(bounds, ["topic", "field"]).where("num is not null").withColumn("at", F.array_position("bounds", value).cast("int") - 1)
    at = F.col("at")
    sides = F.when(F.col("op") == "lt", _up_to(2 * at, levels)).when(F.col("op") == "lte", _up_to(2 * at + 1, levels)).when(F.col("op") == "gt", _from(2 * at + 2, levels)).otherwise(_from(2 * at + 1, levels))
    ranges = placed.select("rule_id", "topic", "field", F.explode(sides).alias("x")).select("rule_id", _interval(F.col("topic"), F.col("field"), F.col("x.level"), F.col("x.place")).alias("key"))
    equal = known.where("op = 'eq'")
    index = equal.select("rule_id", _equality(F.col("topic"), F.col("field"), F.col("num"), F.col("str")).alias("key")).unionAll(ranges)

    asked = requests.select("request_id", "topic")
    # a field that is not given counts as null where a condition of the topic asks for it
    fields = sized(per_field.select("topic", "field"))
    given = asked.join(fields, "topic").join(inputs.select("request_id", "field", F.col("num").cast("double").alias("num"), F.col("str").alias("str")), ["request_id", "field"], "left")
    scaled = given.join(bounds, ["topic", "field"], "left").withColumn("at", F.when(F.col("bounds").isNotNull() & F.col("num").isNotNull(), _place(F.col("bounds"), value)))
    every = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: _interval(F.col("topic"), F.col("field"), level, F.call_function("shiftright", F.col("at").cast("long"), level)))
    own = F.array(_equality(F.col("topic"), F.col("field"), F.col("num"), F.col("str")))
    probes = scaled.select("request_id", F.explode(F.when(F.col("at").isNull(), own).otherwise(F.concat(own, every))).alias("key"))
    held = probes.join(sized(index), "key").groupBy("request_id", "rule_id").agg(F.count(F.lit(1)).alias("held"))
    full = held.join(sized(counted), "rule_id").where("held = wanted").select("request_id", "rank")
    free = counted.where("wanted is null").groupBy("topic").agg(F.max("rank").alias("rank"))
    always = asked.join(sized(free), "topic").select("request_id", "rank")
    return full.unionAll(always).groupBy("request_id").agg(F.max("rank").alias("b")).select("request_id", (-F.col("b.minus")).alias("rule_id"))


def _typed(v: str) -> list[str]:
    """num and str of a VARIANT scalar: numbers and booleans (0 and 1) as numbers; null has neither."""
    kind = f"schema_of_variant({v})"
    number = f"case when {kind} = 'BOOLEAN' then cast(try_variant_get({v}, '$', 'boolean') as double) when {kind} not in ('STRING', 'VOID') then try_variant_get({v}, '$', 'double') end as num"
    return [number, f"case when {kind} = 'STRING' then try_variant_get({v}, '$', 'string') end as str"]


def _exploded(rows: DataFrame, kept: list[str], name: str) -> DataFrame:
    """rows (kept..., v) with a row for each field of the objects among v; others give none."""
    listed = ", ".join(f"r.`{c}`" for c in kept)
    return rows.sparkSession.sql(f"select {listed}, f.key as {name}, f.value as v from {{rows}} r, lateral variant_explode(r.v) f where schema_of_variant(r.v) like 'OBJECT%'", rows=rows)


def conditions_of(rules: DataFrame, key: str = "rule_id", column: str = "conditions") -> DataFrame:
    """(key, field, op, num, str) of JSON objects: a scalar means equality, an object one condition for each of its operators.

    A null field is equality with null; booleans are 0 and 1; what is no JSON object, and an empty one, gives no conditions.
    """
    fields = _exploded(rules.select(key, F.try_parse_json(column).alias("v")), [key], "field")
    bounded = "schema_of_variant(v) like 'OBJECT%'"
    equal = fields.where(f"not ({bounded})").selectExpr(key, "field", "'eq' as op", *_typed("v"))
    return equal.unionAll(_exploded(fields.where(bounded), [key, "field"], "op").selectExpr(key, "field", "op", *_typed("v")))


def inputs_of(requests: DataFrame, key: str = "request_id", column: str = "inputs") -> DataFrame:
    """(key, field, num, str) of the scalars of JSON objects; a null is a field without a value, like one that is absent."""
    fields = _exploded(requests.select(key, F.try_parse_json(column).alias("v")), [key], "field")
    return fields.where("schema_of_variant(v) not like 'OBJECT%' and schema_of_variant(v) not like 'ARRAY%'").selectExpr(key, "field", *_typed("v"))
