"""Change detection and merges of snapshots. Results are new snapshots; write them beside the old ones and swap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexmill.operators.lookup import containing
from lexmill.operators.publish import counted


def _same(keys: list[str], a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def hash_diff(old: DataFrame, new: DataFrame, keys: list[str], hashed: str) -> DataFrame:
    """(keys, status) of all keys: created, updated, unchanged, or absent from the new side, which a merge leaves in place."""
    o = old.select(*keys, F.col(hashed).alias("_old"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.col(hashed).alias("_new"), F.lit(True).alias("_n"))
    both = o.join(n, keys, "full_outer")
    status = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "absent").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return both.select(*keys, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], hashed: str, always: list[str] = (), reset: list[str] = ()) -> DataFrame:
    """old with the rows of new merged in by null-safe keys, as one full outer join.

    Where the hash is the same, the old row stays but for the columns that are `always` overwritten; where it differs, the
    new row replaces it and the `reset` columns (translations of the old text) become null. Rows absent from new stay.
    """
    o = old.select(*(F.col(c).alias(f"_o_{c}") for c in old.columns), F.lit(True).alias("_o"))
    n = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns), F.lit(True).alias("_n"))
    test = reduce(lambda x, y: x & y, (F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys))
    both = o.join(n, test, "full_outer")
    keep = F.col("_n").isNull() | (F.col("_o").isNotNull() & F.col(f"_o_{hashed}").eqNullSafe(F.col(f"_n_{hashed}")))
    out = []
    for c in old.columns:
        if c in reset or c not in new.columns:
            value = F.when(keep, F.col(f"_o_{c}")) if c in reset else F.col(f"_o_{c}")
        elif c in always:
            value = F.when(F.col("_n").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
        else:
            value = F.when(keep, F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}"))
        out.append(value.alias(c))
    return both.select(*out)


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """Children of changed parents replaced by the new ones; the rest stays."""
    return old.join(changed.select(*key), key, "left_anti").unionByName(new.join(changed.select(*key), key, "left_semi"), allowMissingColumns=True)


def sequential_outcomes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with outcome as if merged one by one: created, then updated where the value changes, else skipped. Null keys are equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("outcome", F.when(F.row_number().over(w) == 1, "created").when(F.lag(value).over(w).eqNullSafe(F.col(value)), "skipped").otherwise("updated"))


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


OUTCOMES = ("created", "updated", "skipped", "rejected")


def rate_outcomes(snapshot: DataFrame, found: DataFrame, keys: list[str], order: list[str], links: list[str] = ()) -> DataFrame:
    """The columns of snapshot with _kept and the counts of OUTCOMES: one row for each key of either side, from one pass over both.

    Rates are merged by null-safe keys as if one by one in order; the last value wins. Rows without a value or
    effective_from are set aside as rejected. A row that creates a rate or changes its value gives all of its columns; an
    equal value is skipped, but null link columns are filled from the first row of the key. Keys that have but rejected rows
    are not kept.
    """
    w = Window.partitionBy(*keys, "_good").orderBy(*order)
    placed = found.withColumn("_good", F.col("value").isNotNull() & F.col("effective_from").isNotNull()).withColumns({"_rn": F.row_number().over(w), "_before": F.lag("value").over(w)})
    first, good = F.col("_good") & (F.col("_rn") == 1), F.col("_good")
    moved = good & (F.col("_rn") > 1) & ~F.col("value").eqNullSafe(F.col("_before"))
    row = F.struct(*(F.col(c) if c in found.columns else F.lit(None).cast(snapshot.schema[c].dataType).alias(c) for c in snapshot.columns))
    by_key = placed.groupBy(*keys).agg(
        F.max_by(row, F.when(moved, F.col("_rn"))).alias("_last"), F.max_by(row, F.when(first, F.col("_rn"))).alias("_first"), *(F.max_by(F.col(c), F.when(first, F.col("_rn"))).alias(f"_f_{c}") for c in links),
        F.count_if(moved).alias("_moved"), F.count_if(good & (F.col("_rn") > 1) & ~moved).alias("_same"), F.count_if(~good).alias("rejected"))
    new = by_key.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in by_key.columns if c not in keys))
    both = snapshot.withColumn("_there", F.lit(True)).join(new, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)), "full_outer")
    there, given = F.coalesce(F.col("_there"), F.lit(False)), F.col("_first").isNotNull()
    equal = there & given & F.col("value").eqNullSafe(F.col("_first.value"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    winner = F.when(F.col("_last").isNotNull(), F.col("_last")).when(given & ~equal, F.col("_first"))
    rated = both.withColumns({
        "_winner": winner, "_kept": there | given, "created": (given & ~there).cast("long"), "updated": count("_moved") + (given & there & ~equal).cast("long"),
        "skipped": count("_same") + equal.cast("long"), "rejected": count("rejected")})
    value = lambda c: F.when(F.col("_winner").isNotNull(), F.col(f"_winner.{c}")).otherwise(F.col(c))
    return rated.select(*((F.coalesce(value(c), f"_f_{c}") if c in links else value(c)).alias(c) for c in snapshot.columns), "_kept", *OUTCOMES)


def merge_rates(snapshot: DataFrame, found: DataFrame, keys: list[str], order: list[str], links: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, outcome counts), each from rate_outcomes(); for both from one write see merge_rates_counted()."""
    rated = rate_outcomes(snapshot, found, keys, order, links)
    return rated.where("_kept").select(*snapshot.columns), rated.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in OUTCOMES))


def merge_rates_counted(snapshot: DataFrame, found: DataFrame, keys: list[str], order: list[str], links: list[str] = ()) -> tuple[DataFrame, Observation]:
    """(new snapshot, observation): the outcome counts are there when the snapshot has been written, from the same pass."""
    rated, seen = counted(rate_outcomes(snapshot, found, keys, order, links), **{c: F.col(c) for c in OUTCOMES})
    return rated.where("_kept").select(*snapshot.columns), seen


def fill_nulls(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with null columns filled from new, and the rows of new that old lacks."""
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in columns))
    filled = old.join(n, keys, "left").select(*(F.coalesce(c, f"_n_{c}").alias(c) if c in columns else F.col(c) for c in old.columns))
    return filled.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def new_versions(old: DataFrame, new: DataFrame, key: str, url: str) -> DataFrame:
    """old with new rows as current versions: a key under a new link retires its earlier rows."""
    fresh = new.join(old.select(key, url), [key, url], "left_anti")
    retired = fresh.select(key).distinct().withColumn("_gone", F.lit(True))
    kept = old.join(retired, key, "left").withColumn("is_current", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("is_current"))).drop("_gone")
    return kept.unionByName(fresh.withColumn("is_current", F.lit(True)), allowMissingColumns=True)


def _left_join_spread(rows: DataFrame, key: str, spread: str, other: DataFrame, other_key: str) -> DataFrame:
    """rows left joined with other on a key that is null where rows come from one side of an outer join.

    Null keys match nothing, but a join on the key alone would send all of them to one task: where it is null, `spread` tells
    the task instead.
    """
    place = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(spread))
    hashed = other.withColumn("_at", F.xxhash64(other_key))
    return rows.join(hashed, (F.col(key) == F.col(other_key)) & (place == F.col("_at")), "left").drop("_at")


def agreement_versions(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, status by url) of agreements (url, key, name, hash, valid_from, valid_until, is_parsed, is_current).

    A known link with the same hash: missing dates are filled, a name is replaced, and it counts as parsed; the status is
    skipped if nothing of that changed. A known link with another hash: the hash is replaced, and its clauses are to be made
    anew (clear_clauses). A new link is a version of its own: it retires the current row of its key (updated), or is the
    first (created). Links occur once in new; rows that new lacks stay.
    """
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))
    both = named(old, "o_").join(named(new, "n_"), F.col("o_url") == F.col("n_url"), "full_outer")
    known, given = F.col("o_url").isNotNull(), F.col("n_url").isNotNull()
    same = known & given & F.col("o_hash").eqNullSafe(F.col("n_hash"))
    dates = [F.col(f"o_{c}").isNull() & F.col(f"n_{c}").isNotNull() for c in ("valid_from", "valid_until")]
    renamed = F.coalesce(F.col("n_name"), F.lit("")) != ""
    renamed = renamed & ~F.col("o_name").eqNullSafe(F.col("n_name"))
    changed = reduce(lambda a, b: a | b, [*dates, renamed, ~F.col("o_is_parsed")])
    current = old.where("is_current").select(F.col("key").alias("_key")).distinct().withColumn("_had", F.lit(True))
    status = F.when(same, F.when(changed, "updated").otherwise("skipped")).when(known & given, "updated").when(F.col("_had"), "updated").otherwise("created")
    marked = _left_join_spread(both, "n_key", "o_url", current, "_key").withColumns({"_status": F.when(given, status), "_clear": known & given & ~same})
    retired = marked.where(~known).select(F.col("n_key").alias("_gone")).distinct()
    value = {
        "url": F.coalesce("o_url", "n_url"), "key": F.when(known, F.col("o_key")).otherwise(F.col("n_key")),
        "name": F.when(same & renamed | ~known, F.col("n_name")).otherwise(F.col("o_name")),
        "hash": F.when(given, F.col("n_hash")).otherwise(F.col("o_hash")),
        **{c: F.when(~known, F.col(f"n_{c}")).otherwise(F.when(same, F.coalesce(f"o_{c}", f"n_{c}")).otherwise(F.col(f"o_{c}"))) for c in ("valid_from", "valid_until")},
        "is_parsed": F.when(known & given, F.lit(True)).when(known, F.col("o_is_parsed")).otherwise(F.lit(False)),
        "is_current": F.when(~known, F.lit(True)).otherwise(F.col("o_is_current") & F.col("_gone").isNull()),
    }
    placed = _left_join_spread(marked, "o_key", "n_url", retired, "_gone")
    snapshot = placed.select(*(value[c].alias(c) for c in old.columns))
    return snapshot, marked.where(given).select(F.col("n_url").alias("url"), F.col("_status").alias("status"), F.col("_clear").alias("clear_clauses"))


def upsert_guidance(old: DataFrame, new: DataFrame, n: int = 50) -> DataFrame:
    """(topic, url, title, text, hash, status): guidance merged by topic, link and the first n letters of the title.

    new: (topic, url, title, text, hash, agreement). An old row whose title contains the head of a new one is that one: an
    equal hash leaves it alone, another replaces title, text and hash. What has no old row is created, its title led by
    the name of its agreement. Of several old rows that fit, the one with the least title is taken.
    """
    head = F.substring("title", 1, n)
    fresh = new.withColumns({"_head": head, "_place": F.xxhash64("topic", "url", head, "hash")})
    # titles that hold a head are found through the head's longest inner word, not by comparing all of a group
    titles = old.select("topic", "url", F.col("title").alias("_title")).distinct().withColumn("_tid", F.struct("topic", "url", "_title"))
    heads = fresh.select("topic", "url", "_head").distinct().withColumn("_hid", F.struct("topic", "url", "_head"))
    met = containing(titles, "_tid", "_title", heads, "_hid", "_head", ("topic", "url"))
    best = met.groupBy("_hid").agg(F.min("_tid._title").alias("_title")).select("_hid.*", "_title")
    matched = fresh.join(best, ["topic", "url", "_head"], "left")
    prior = old.select("topic", "url", F.col("title").alias("_title"), F.col("text").alias("_text"), F.col("hash").alias("_hash"))
    both = prior.join(matched, ["topic", "url", "_title"], "full_outer")
    status = F.when(F.col("_place").isNull(), "absent").when(F.col("_title").isNull(), "created").when(F.col("_hash").eqNullSafe(F.col("hash")), "skipped").otherwise("updated")
    keep = F.col("status").isin("absent", "skipped")
    rated = both.withColumn("status", status)
    title = F.when(keep, F.col("_title")).when(F.col("status") == "created", F.concat_ws(": ", "agreement", "title")).otherwise(F.col("title"))
    return rated.select("topic", "url", title.alias("title"), F.when(keep, F.col("_text")).otherwise(F.col("text")).alias("text"), F.when(keep, F.col("_hash")).otherwise(F.col("hash")).alias("hash"), "status")


def sweep_guidance(old: DataFrame, pages: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, source, url, title, text, hash, text_en, status): guidance of a sweep merged by topic and source.

    pages: (topic, source, url, title, text, hash), one a topic and source. Pages of topics that `topics` (topic) lacks and
    pages without text are skipped and not stored (unknown_topic, empty). An equal hash leaves the old row alone (skipped),
    another replaces it and resets its translation (updated), a new one is stored (created); what the sweep lacks stays
    (absent). Rows whose status is unknown_topic or empty say what was skipped; take the others as the next snapshot.
    """
    known = topics.select("topic").distinct().withColumn("_known", F.lit(True))
    judged = pages.join(known, "topic", "left").withColumn("_bad", F.when(F.col("_known").isNull(), "unknown_topic").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty"))
    columns = ["topic", "source", "url", "title", "text", "hash", "text_en"]
    skipped = judged.where("_bad is not null").select(*columns[:-1], F.lit(None).cast("string").alias("text_en"), F.col("_bad").alias("status"))
    good = judged.where("_bad is null").select(*columns[:-1])
    merged = upsert(old, good, ["topic", "source"], "hash", reset=["text_en"])
    status = hash_diff(old, good, ["topic", "source"], "hash").withColumn("status", F.when(F.col("status") == "unchanged", "skipped").otherwise(F.col("status")))
    named = status.select(F.col("topic").alias("_t"), F.col("source").alias("_s"), "status")
    return merged.join(named, F.col("topic").eqNullSafe(F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))).select(*columns, "status").unionByName(skipped)


def seed_links(links: DataFrame, seeds: DataFrame, sections: DataFrame) -> DataFrame:
    """(topic, section_id, relevance, status) of links after seeding: seeds (topic, act, chapter, section, relevance) name sections.

    A seed whose section `sections` (section_id, act, chapter, section) lacks is missing and has no section_id; a link that
    is there gets the seed's relevance (updated, or unchanged if it has it), another is inserted (created); links no seed
    names stay (kept). A chapter may be null and then meets a null one. Of several seeds for a link the greatest relevance
    counts, so seeding again changes nothing. Rows without a section_id are no links.
    """
    named = ["act", "chapter", "section"]
    place = sections.select("section_id", *(F.col(c).alias(f"_{c}") for c in named))
    found = seeds.join(place, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in named)), "left")
    missing = found.where("section_id is null").select("topic", F.lit(None).cast(links.schema["section_id"].dataType).alias("section_id"), "relevance", F.lit("missing").alias("status"))
    wanted = found.where("section_id is not null").groupBy("topic", "section_id").agg(F.max("relevance").alias("_new"))
    both = links.select("topic", "section_id", F.col("relevance").alias("_old"), F.lit(True).alias("_there")).join(wanted, ["topic", "section_id"], "full_outer")
    status = F.when(F.col("_there").isNull(), "created").when(F.col("_new").isNull(), "kept").when(F.col("_new").eqNullSafe(F.col("_old")), "unchanged").otherwise("updated")
    return both.select("topic", "section_id", F.when(F.col("_new").isNull(), F.col("_old")).otherwise(F.col("_new")).alias("relevance"), status.alias("status")).unionByName(missing)


def upsert_acts(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Snapshots of acts, chapters, sections and paragraphs after a parse; and `statuses`, one row a section of the parse.

    acts: (act, name, url, version_date) by act, always overwritten, the date only by one that is there. chapters: (act,
    chapter, title) by both, the title overwritten. sections: (act, chapter, section, title, hash, translated) by the first
    three: replaced if the hash differs or was null, translations reset. paragraphs: (act, chapter, section,
    order_index, text): those of new or changed sections are replaced. What the parse lacks stays.
    """
    key = ["act", "chapter", "section"]
    status = hash_diff(old["sections"], new["sections"], key, "hash")
    # a section without a hash is parsed anew
    no_hash = old["sections"].where("hash is null").select(*key).withColumn("_redo", F.lit(True))
    status = status.join(no_hash, key, "left").withColumn("status", F.when((F.col("status") == "unchanged") & F.col("_redo"), "updated").otherwise(F.col("status"))).drop("_redo")
    changed = status.where("status in ('created', 'updated')")
    dated = new["acts"].join(old["acts"].select("act", F.col("version_date").alias("_v")), "act", "left").withColumn("version_date", F.coalesce("version_date", "_v")).drop("_v")
    return {
        "acts": upsert(old["acts"], dated, ["act"], "name", always=["name", "url", "version_date"]),
        "chapters": upsert(old["chapters"], new["chapters"], ["act", "chapter"], "title"),
        "sections": upsert(old["sections"], new["sections"], key, "hash", reset=["translated"]),
        "paragraphs": replace_children(old["paragraphs"], new["paragraphs"], changed, key),
        "statuses": status.where("status <> 'absent'"),
    }


def clear_in_scope(rows: DataFrame, columns: list[str], scope: DataFrame | None, key: str) -> DataFrame:
    """rows with columns set to null where key is in scope; without a scope everywhere. A dry run counts `_cleared`."""
    flagged = rows.withColumn("_in", F.lit(True)) if scope is None else rows.join(scope.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    filled = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))
    out = flagged.withColumn("_cleared", F.coalesce(F.col("_in"), F.lit(False)) & filled)
    return out.withColumns({c: F.when(~F.col("_cleared"), F.col(c)) for c in columns}).select(*rows.columns, "_cleared")


def stamped(rows: DataFrame, changed: Column, column: str, at: str) -> DataFrame:
    """rows with the run's time in a column where they changed; the time is given, so that a run can be repeated."""
    return rows.withColumn(column, F.when(changed, F.lit(at).cast("timestamp")).otherwise(F.col(column)))


def propagate(rows: DataFrame, value: str, done: DataFrame, target: str) -> DataFrame:
    """rows with target filled from a table worked out once for each distinct value."""
    return rows.drop(target).join(done.select(value, target), value, "left").select(*rows.columns)


def cascade_delete(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is left; those without a parent stay."""
    return children.join(parents.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_semi").unionByName(children.where(F.col(key).isNull()))


def set_null(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children with references to parents that are gone set to null."""
    kept = parents.select(F.col(parent_key).alias("_p"), F.lit(True).alias("_there")).distinct()
    return children.join(kept, F.col(key) == F.col("_p"), "left").withColumn(key, F.when(F.col("_there"), F.col(key))).select(*children.columns)
