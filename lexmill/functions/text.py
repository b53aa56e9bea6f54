"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda variable is evaluated where it is bound."""
    return F.transform(F.array(value), body)[0]


def prefix(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An array whose k-th entry joins the first k + 1 entries of values: a sum, or a greatest or least value.

    The scan doubles its reach in each round, so the work is n log n however long the array is; a fold that appends to an
    array would copy it at every step.
    """
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values))).cast("int"), F.lit(0)))

    def double(acc: Column, r: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), r)
        return F.transform(acc, lambda v, i: F.when(i >= reach, join(v, F.get(acc, i - reach))).otherwise(v))

    return F.when(F.size(values) > 1, F.aggregate(rounds, values, double)).otherwise(values)


#: Entries that one fold of opened() takes; folds over such blocks are joined.
FOLD = 256


def opened(values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The places of values (from 0) at which a fold from the left opens a new group.

    step(state, value) gives (whether it opens one, the next state); the state is a double, `start` at first. Flags
    gather block by block, so a long array is not copied at every entry.
    """
    kind = "struct<state:double,flags:array<boolean>>"
    begin = F.struct(start.cast("double").alias("state"), F.array().cast("array<boolean>").alias("flags")).cast(kind)

    def one(acc: Column, x: Column) -> Column:
        opens, state = step(acc["state"], x)
        return F.struct(state.cast("double").alias("state"), F.concat(acc["flags"], F.array(opens)).alias("flags")).cast(kind)

    def block(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(values, k * FOLD + 1, F.lit(FOLD)), F.struct(acc["state"].alias("state"), F.array().cast("array<boolean>").alias("flags")).cast(kind), one)
        return let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(acc["flags"], o["flags"]).alias("flags")).cast(kind))

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int"))
    flags = F.aggregate(blocks, begin, block, lambda acc: acc["flags"])
    places = let(flags, lambda f: F.filter(F.transform(f, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    return F.when(F.size(values) > 0, places).otherwise(F.array().cast("array<int>"))


def running(values: Column, start: Column, state: str, out: str, step: Callable[[Column, Column], Column]) -> Column:
    """What a fold from the left makes of each of values, as an array.

    step(state, value) gives struct<state,out>; `state` and `out` name their types. Results gather block by block, as in
    opened().
    """
    kind, none = f"struct<state:{state},out:array<{out}>>", F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")).cast(kind))

    def block(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(values, k * FOLD + 1, F.lit(FOLD)), F.struct(acc["state"].alias("state"), none.alias("out")).cast(kind), one)
        return let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(acc["out"], o["out"]).alias("out")).cast(kind))

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLD).cast("int"))
    begin = F.struct(start.cast(state).alias("state"), none.alias("out")).cast(kind)
    return F.when(F.size(values) > 0, F.aggregate(blocks, begin, block, lambda acc: acc["out"])).otherwise(none)


def grouped(values: Column, places: Column) -> Column:
    """values cut before each of the places, as an array of arrays."""
    return F.transform(places, lambda at, k: F.slice(values, at + 1, F.coalesce(F.get(places, k + 1), F.size(values)) - at))


def squeeze(text: Column) -> Column:
    """White space of any kind, no-break spaces included, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_keyword(lowered: Column, keyword: str, short: int = 6) -> Column:
    """Keywords under `short` letters match as whole words, longer ones anywhere, so that inflected compounds match."""
    if len(keyword) >= short:
        return lowered.contains(keyword)
    return lowered.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted(keyword)}([^\p{{L}}\p{{N}}_]|$)")


def quoted(literal: str) -> str:
    """A literal for use in a regular expression of Java or RE2."""
    return "".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in literal)


def slugify(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_to_title(slug: Column, replacements: list[tuple[str, str]]) -> Column:
    """Last path segment, hyphens as spaces, first letter upper and the rest lower case, then replacements in order."""
    last = F.replace(F.element_at(F.split(F.regexp_replace(slug, "/+$", ""), "/"), -1), F.lit("-"), F.lit(" "))
    title = F.concat(F.upper(F.substring(last, 1, 1)), F.lower(F.substring(last, 2, 1_000_000)))
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), replacements, title)


def strip_suffixes(text: Column, patterns: list[str]) -> Column:
    """Each pattern removed at the end in turn, in any case; the original where nothing is left."""
    cut = reduce(lambda c, p: F.trim(F.regexp_replace(c, rf"(?iu)(?:{p})\s*$", "")), patterns, F.trim(text))
    return F.coalesce(F.nullif(cut, F.lit("")), text)


def scrub(text: Column, tokens: list[str] = ()) -> Column:
    """Control characters and tokens removed, runs of blanks as one, three or more line ends as two."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    clean = reduce(lambda c, t: F.replace(c, F.lit(t), F.lit("")), tokens, clean)
    return F.trim(F.regexp_replace(F.regexp_replace(clean, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def clean_name(text: Column, markers: list[str]) -> Column:
    """Line-end hyphenation joined, then cut before the first marker word."""
    joined = F.regexp_replace(text, r"-\s*\n\s*", "")
    marker = "|".join(map(quoted, markers))
    return squeeze(F.regexp_replace(joined, rf"(?isu)\b(?:{marker})\b.*$", ""))


def plain_dashes(text: Column) -> Column:
    """Dashes of all kinds as hyphens, soft hyphens removed."""
    return F.translate(F.replace(text, F.lit("­"), F.lit("")), "‐‑‒–—−", "------")


def after_label(text: Column) -> Column:
    """What follows the first ": ", or the text itself."""
    return F.when(text.contains(": "), F.substring(text, F.instr(text, F.lit(": ")) + 2, F.length(text))).otherwise(text)


def html_escape(text: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], text)


def html_unescape(text: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")], text)


def absolute_url(href: Column, base: Column) -> Column:
    """Full links as they are, rooted ones on the site of base, others beside it."""
    site = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(base, r"[^/]*$", "")
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(folder, href))


def statute_code(url: Column) -> Column:
    """number/year from a link that ends in the year and the number, the number with or without the year before it.

    Before a number of four digits, zeros among them, the year is not part of it: 20010055 is 55, but 200155 is a number of its own.
    """
    year, number = F.regexp_extract(url, r"/(\d{4})/(\d+)/?$", 1), F.regexp_extract(url, r"/(\d{4})/(\d+)/?$", 2)
    bare = F.when((F.length(number) == 8) & number.startswith(year), F.substring(number, 5, 20)).otherwise(number)
    return F.when(year != "", F.concat(F.try_to_number(F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0")), F.lit("9999999999")).cast("string"), F.lit("/"), year))


def cut_at(text: Column, sentinel: str) -> Column:
    return F.trim(F.substring_index(text, sentinel, 1))


def join_filled(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *(F.nullif(p, F.lit("")) for p in parts))


def fallback(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: every row padded or cut to the width of the first."""
    width = F.size(rows[0])
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n"))


def content_hash(parts: list[Column] | Column, sep: str = "", stripped: bool = False) -> Column:
    """SHA-256 of parts (columns or one array column) joined by sep; stripped drops blank parts."""
    array = parts if isinstance(parts, Column) else F.array(*(F.coalesce(p, F.lit("")) for p in parts))
    if stripped:
        array = F.filter(F.transform(array, lambda x: strip(x)), lambda x: x != "")
    return F.sha2(F.array_join(array, sep), 256)


def text_key(text: Column) -> Column:
    """The MD5 under which manual corrections of a text are kept."""
    return F.md5(text)


#: A match: where it starts and ends in code points, and the text of its groups.
def matches(text: Column, pattern: str, groups: int) -> Column:
    """All matches as array<struct<start,end,g>>; g[0] is the match, g[k] group k, empty where it took no part.

    Spark gives matches without their places; these follow from the lengths of the pieces between them.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(groups + 1)]
    kind = "array<struct<start:int,end:int,g:array<string>>>"
    lengths = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found[0].alias("g0")), F.lit(1), F.size(found[0]))
    ends = let(F.transform(lengths, lambda x: F.length(x["piece"]) + F.length(x["g0"])), lambda n: prefix(n, lambda x, y: x + y))
    zipped = F.arrays_zip(ends.alias("end"), *(f.alias(f"g{k}") for k, f in enumerate(found)))
    rows = F.transform(zipped, lambda x: F.struct((x["end"] - F.length(x["g0"])).alias("start"), x["end"].alias("end"), F.array(*(x[f"g{k}"] for k in range(groups + 1))).alias("g")))
    return F.when(text.rlike(pattern), rows.cast(kind)).otherwise(F.array().cast(kind))


def excerpt(text: Column, start: Column, end: Column, before: int = 40, after: int = 40) -> Column:
    """The text around a match, white space squeezed."""
    first = F.greatest(start - before, F.lit(0))
    return squeeze(F.substring(text, first + 1, F.least(end + after, F.length(text)) - first))
