"""Secret scans with DataFrame expressions alone: three patterns, and character Markov models for the rest.

Two first-order Markov models over the letters of ALPHABET, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A run of such letters is a secret if the mean log-likelihood
ratio of its steps passes a threshold that next to no held-out ordinary sample passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import prefix
from lexmill.llm.common import packed, save

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge.
SHORTEST = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda variable is evaluated where it is bound."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """All leftmost matches as (start, kind, end) in code points; keep() tests a match's group.

    Spark gives matches without their places; these are prefix sums of the lengths of matches and of the pieces between
    them, in time that is nearly linear in the text.
    """

    def placed(found: Column) -> Column:
        held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        lengths = F.slice(F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("own")), F.lit(1), F.size(found))
        ends = prefix(F.transform(lengths, lambda x: x["gap"] + x["own"]), lambda x, y: x + y)
        spans = F.transform(F.arrays_zip(ends.alias("end"), found.alias("match"), held.alias("held")), lambda x: F.struct(x["end"].alias("end"), F.length(x["match"]).alias("size"), x["held"].alias("held")))
        good = F.filter(spans, lambda x: keep(x["held"])) if keep else spans
        return F.transform(good, lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPAN)))


#: Letters that are taken apart at once: a long run or text is cut into blocks of so many in one pass.
BLOCK = 4096


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


#: The place in ALPHABET of every ASCII letter.
PLACES = [ALPHABET.find(chr(k)) for k in range(128)]


def _steps(block: Column) -> Column:
    """The places in ALPHABET of a block's neighbouring letters, as first * letters + second."""
    places = F.array(*map(F.lit, PLACES))

    def pairs(at: Column) -> Column:
        return F.transform(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda x, i: F.get(at, i) * len(ALPHABET) + x)

    return _let(F.transform(F.split(block, ""), lambda x: F.get(places, F.ascii(x))), pairs)


def _overlapping(token: Column) -> Column:
    """The blocks of a token, each with the first letter of the next."""
    return _let(_blocks(token), lambda bs: F.transform(bs, lambda b, i: F.concat(b, F.coalesce(F.substring(F.get(bs, i + 1), 1, 1), F.lit("")))))


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of random over ordinary for each step, and the least mean ratio of a secret."""

    ratios: tuple[float, ...]
    threshold: float

    def mean_ratio(self, token: Column) -> Column:
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratios)), ",").cast("array<double>")
        of_block = lambda b: F.aggregate(_steps(b), F.lit(0.0), lambda acc, k: acc + F.get(table, k))
        total = F.when(F.length(token) <= BLOCK, of_block(token)).otherwise(F.aggregate(_overlapping(token), F.lit(0.0), lambda acc, b: acc + of_block(b)))
        return total / (F.length(token) - 1)


def random_samples(spark, n: int = 4000) -> DataFrame:
    """(token, secret): random strings over hexadecimal, base-64, upper-case and lower-case alphabets, made from hashes."""
    digest = lambda k: F.sha2(F.concat_ws(":", F.lit(k), F.col("id")), 256)
    base64 = lambda k: F.regexp_replace(F.base64(F.unhex(digest(k))), "=+$", "")
    forms = [digest("hex"), base64("base64"), F.upper(F.regexp_replace(base64("upper"), "[+/]", "")), F.regexp_replace(base64("mixed"), "[+/]", ""), F.lower(F.regexp_replace(base64("lower"), "[+/]", ""))]
    return spark.range(n).select(F.explode(F.array(*forms)).alias("token"), F.lit(True).alias("secret"))


def _number(k: int, width: int, of: Column, least: int = 0, most: int | None = None) -> Column:
    """A number of `width` digits with leading zeros, by the hash of a column; from least to most where most is given."""
    span = 10**width if most is None else most - least + 1
    return F.lpad((F.pmod(F.xxhash64(F.lit(k), of), F.lit(span)) + least).cast("string"), width, "0")


def _date(k: int, sep: str, of: Column) -> Column:
    return F.concat_ws(sep, _number(k, 4, of, 1900, 2099), _number(k + 1, 2, of, 1, 12), _number(k + 2, 2, of, 1, 31))


def numeric_samples(spark, n: int = 4000) -> DataFrame:
    """(token, secret): dates, times, counters, versions, ISBN, phone and other numbers, made from hashes."""
    of = F.col("id")
    num = lambda k, width: _number(k, width, of)
    time = F.concat_ws("-", _number(3, 2, of, 0, 23), _number(4, 2, of, 0, 59), _number(5, 2, of, 0, 59))
    isbn = F.concat_ws("-", F.lit("978"), num(10, 1), num(11, 2), num(12, 6), num(13, 1))
    phone = F.concat_ws("-", F.concat(F.lit("+"), _number(14, 2, of, 1, 99)), num(15, 2), num(16, 3), num(17, 4))
    version = F.concat(F.lit("v"), F.concat_ws("-", _number(18, 1, of), _number(19, 2, of, 0, 40), _number(20, 1, of)))
    first = F.pmod(F.xxhash64(F.lit(21), of), F.lit(10)).cast("int")
    running = lambda step: F.substring(F.repeat(F.lit("0123456789" if step > 0 else "9876543210"), 5), first + 1, 20 + F.pmod(F.xxhash64(F.lit(22), of), F.lit(15)).cast("int"))
    forms = [
        F.concat_ws("/", _date(0, "-", of), _date(30, "-", of)), F.concat_ws("/", _date(0, "/", of), _date(30, "/", of)), F.concat_ws("_", _date(0, "-", of), time), F.concat(_date(0, "", of), F.lit("T"), F.replace(time, F.lit("-"), F.lit("")), F.lit("Z-"), num(6, 4)),
        F.concat(_date(0, "-", of), F.lit("T"), time, F.lit("+0"), num(6, 1), F.lit("00")), F.concat(_date(0, "-", of), F.lit("--"), _date(30, "-", of)), F.concat_ws("_", _date(0, "_", of), time, num(6, 3)), F.concat_ws("-", _date(0, "", of), num(6, 6), num(7, 6)),
        F.concat(num(6, 15), num(7, 15)), F.concat(num(6, 12), num(7, 8)), F.concat_ws("-", num(6, 4), num(7, 4), num(8, 4), num(9, 4), num(10, 4)), F.concat_ws("/", num(6, 8), num(7, 7), num(8, 6)), F.concat_ws("_", num(6, 10), num(7, 10)), F.lpad(num(6, 5), 24, "0"),
        running(1), running(-1), F.concat_ws("-", isbn, num(6, 4)), F.concat_ws("/", isbn, num(6, 5)), F.concat_ws("/", phone, num(6, 4)), F.concat_ws("-", phone, num(6, 6)), F.concat_ws("_", version, _date(0, "-", of), num(6, 4)), F.concat_ws("-", version, version, num(6, 8)),
        F.concat_ws("+", num(6, 7), num(7, 7), num(8, 7)), F.concat_ws("=", num(6, 9), F.concat_ws("+", num(7, 8), num(8, 8))),
    ]
    return spark.range(n).select(F.explode(F.array(*forms)).alias("token"), F.lit(False).alias("secret"))


def ordinary_samples(docs: DataFrame, max_docs: int = 2000, max_words: int = 60) -> DataFrame:
    """(token, secret): words alone and joined as identifiers are, some with numbers made from their hashes; and numeric_samples.

    About max_docs distinct texts give the words, at most 2 * max_docs, those of the least hashes; of the distinct words of
    a whole text max_words go in, those of the least hashes.
    """
    text = F.col("text").cast("string")
    place = F.xxhash64(text, F.lit(3))
    share = max_docs / max(docs.agg(F.approx_count_distinct(place)).first()[0], 1)
    # tokens of the texts with digits stay out, as they may be the very secrets in question; made ones take their place
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])"), F.lit(0)))
    some = docs.where(text.isNotNull() & (F.pmod(place, F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, share))))
    chosen = F.transform(F.slice(F.array_sort(F.transform(words, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, max_words), lambda x: x["x"])
    sample = some.select(place.alias("place"), chosen.alias("w")).groupBy("place").agg(F.min("w").alias("w")).orderBy("place").limit(2 * max_docs)
    lower = lambda i: F.lower(F.col("w")[i])
    forms = lambda i: F.array(F.col("w")[i], F.concat(lower(i), lower(i + 1)), F.concat_ws("_", lower(i), lower(i + 1), lower(i + 2)), F.concat(lower(i), F.initcap(lower(i + 1))), F.concat_ws("-", lower(i), lower(i + 1)), F.upper(F.concat_ws("_", lower(i), lower(i + 1))), F.concat_ws("/", lower(i), lower(i + 1), lower(i + 2)))

    def numbered(i: Column) -> Column:
        a, b, c = (lower(i + k) for k in range(3))
        num = lambda k, width: _number(k, width, F.col("w")[i])
        date = lambda sep: _date(0, sep, F.col("w")[i])
        slug = F.concat_ws("-", a, b, c)
        return F.array(
            F.concat(F.lit("/"), date("/"), F.lit("/"), slug), F.concat(F.lit("/"), F.concat_ws("/", a, num(6, 8), b)), F.concat_ws("/", a, b, num(6, 5), num(7, 3)), F.concat_ws("-", date("-"), a, b), F.concat_ws("-", slug, num(6, 4)), F.concat_ws("_", a, b, date("-")), F.concat_ws("_", date(""), a, num(6, 3)),
            F.concat(a, num(6, 2), F.lit("_"), b, num(7, 4)), F.concat(a, F.initcap(b), num(6, 3)), F.concat(F.upper(a), F.lit("-"), date("-"), F.lit("-"), num(6, 6)), F.concat(F.upper(F.concat_ws("_", a, b)), F.lit("_"), num(6, 4)), F.concat_ws("-", a, F.concat(F.lit("v"), num(6, 1)), num(7, 2), num(8, 1), b),
            F.concat_ws("-", F.initcap(a), F.initcap(b), num(6, 2), date("-")), F.concat(a, F.lit("="), num(6, 6), F.lit("/"), b, F.lit("="), num(7, 4)))

    joined = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.when(i % 4 == 0, F.concat(forms(i), numbered(i))).otherwise(forms(i)))
    found = sample.where(F.size("w") >= 3).select(F.explode(F.flatten(joined)).alias("token"), F.lit(False).alias("secret"))
    # rulers and fillers: one letter again and again
    rulers = docs.sparkSession.range(len(ALPHABET)).select(F.repeat(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)), F.lit(2000)).alias("token"), F.lit(False).alias("secret"))
    return found.unionAll(rulers).unionAll(numeric_samples(docs.sparkSession))


def train(samples: DataFrame, margin: float = 0.15) -> MarkovModel:
    """A model from labelled samples (token, secret); tokens of under two letters and letters outside ALPHABET are ignored.

    Two thirds of the ordinary samples and all random ones train; the threshold lies `margin` above the mean
    ratio that 9999 of 10000 held-out ordinary samples of SHORTEST letters or more stay below, of those with digits and
    of those without, and at least at margin.
    """
    letters = len(ALPHABET)
    known = save(samples.where(F.col("token").isNotNull() & F.col("secret").isNotNull() & F.col("token").rlike("^[A-Za-z0-9+/_=-]{2,}$")).select("token", "secret", (F.pmod(F.xxhash64("token"), F.lit(3)) == 0).alias("held")), "samples")
    taught = known.where(~F.col("held") | F.col("secret") | (F.length("token") >= 2000))
    # pairs of letters are exploded and counted in compiled code; a token of several blocks is cut into them first
    cut = taught.where(F.length("token") > BLOCK).select("secret", F.explode(_overlapping(F.col("token"))).alias("token"))
    blocks = taught.where(F.length("token") <= BLOCK).select("secret", "token").unionAll(cut.where(F.length("token") > 1))
    pairs = blocks.select("secret", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i")).select("secret", F.substring("token", F.col("i"), F.lit(2)).alias("pair"))
    seen = {True: [0.0] * letters**2, False: [0.0] * letters**2}
    for row in pairs.groupBy("secret", "pair").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 * letters^2 rows
        seen[row.secret][ALPHABET.index(row.pair[0]) * letters + ALPHABET.index(row.pair[1])] = row.n

    def log_rates(of: list[float]) -> list[float]:
        out = []
        for k in range(letters):
            row = of[k * letters : (k + 1) * letters]
            total = sum(row) + 0.5 * letters
            out += [math.log((n + 0.5) / total) for n in row]
        return out

    ratios = tuple(a - b for a, b in zip(log_rates(seen[True]), log_rates(seen[False]), strict=True))
    model = MarkovModel(ratios, 0.0)
    held = known.where("held and not secret").where(F.length("token") >= SHORTEST)
    high = held.groupBy(F.col("token").rlike("[0-9]")).agg(F.percentile_approx(model.mean_ratio(F.col("token")), 0.9999, 10_000)).collect()
    return MarkovModel(ratios, margin + max([0.0, *(row[1] for row in high)]))


def with_spans(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """docs with _base and _added: arrays of (start, kind, end) in code points, end exclusive, kind a place in KINDS.

    _added holds what the models find and no base span touches. Null texts count as empty; repeated rows are
    alike; extra columns stay; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(SPAN)
    long_enough = lambda held: F.length(held) >= 8
    assign = _spans(text, ASSIGN, 0, long_enough, 2)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(none)
    found = docs.withColumn("_base", F.array_sort(F.concat(assign, access, _spans(text, HEX, 2))))
    random = _spans(text, RUN, 3, lambda held: model.mean_ratio(held) > model.threshold)
    return found.withColumn("_added", _let(random, lambda xs: F.when((F.size(xs) > 0) & (F.size("_base") > 0), _apart(F.col("_base"), xs)).otherwise(xs)))


def _apart(base: Column, added: Column) -> Column:
    """The added spans that no base span touches, from one order of both.

    Of base spans that start no later, the greatest end tells; of those that start later, the least start.
    """
    is_base = lambda x: x["kind"] < 3
    far = F.lit(2**31 - 1)

    def clear(both: Column) -> Column:
        ends = prefix(F.transform(both, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(0))), F.greatest)
        starts = F.reverse(prefix(F.reverse(F.transform(both, lambda x: F.when(is_base(x), x["start"]).otherwise(far))), F.least))
        rows = F.arrays_zip(both.alias("x"), ends.alias("before"), starts.alias("after"))
        return F.transform(F.filter(rows, lambda r: ~is_base(r["x"]) & (r["before"] <= r["x"]["start"]) & (r["after"] >= r["x"]["end"])), lambda r: r["x"])

    return _let(F.array_sort(F.concat(base, added)), clear)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def scan(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row.

    A null text counts as empty: no spans, and the digest of nothing. Repeated rows and null ids stay as they are; extra
    columns are ignored; an empty table gives an empty result.
    """
    marked = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    of = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")
    return marked.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.size("_added").cast("long").alias("n_markov"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("_base", "_added"))).alias("spans"))


def _piece(blocks: Column, start: Column, end: Column) -> Column:
    """The letters from start to end of a text in blocks, without a walk from the text's beginning."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    head = F.coalesce(F.get(blocks, first), F.lit(""))
    short = F.substring(head, start - first * BLOCK + 1, end - start)
    middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    long = F.concat(F.substring(head, start - first * BLOCK + 1, F.lit(BLOCK)), middle, F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), end - last * BLOCK))
    return F.when(first == last, short).otherwise(long)


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with the union of sorted spans masked: what lies between them, joined by the mask."""

    def joined(ends: Column, blocks: Column) -> Column:
        # upto: the greatest end of the spans before; a span that starts at or beyond it begins a new masked stretch
        upto = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0))
        gaps = F.filter(F.transform(spans, lambda x, i: F.struct(upto(i).alias("start"), x["start"].alias("end"))), lambda g: g["end"] >= g["start"])
        tail = F.struct(F.element_at(ends, -1).alias("start"), F.length(text).alias("end"))
        return F.array_join(F.transform(F.concat(gaps, F.array(tail)), lambda g: _piece(blocks, g["start"], g["end"])), mask)

    return _let(prefix(F.transform(spans, lambda x: x["end"]), F.greatest), lambda ends: _let(_blocks(text), lambda blocks: joined(ends, blocks)))


def redact(docs: DataFrame, model: MarkovModel, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by a mask and n_chars, where there is one, brought up to date.

    Spans that overlap are masked as one. A null text stays null; texts without a span, n_chars of theirs, and
    all other columns stay as they are; repeated rows are alike; an empty table gives an empty result.
    """
    marked = with_spans(packed(docs, "text"), model).withColumn("_all", F.array_sort(F.concat("_base", "_added")))
    changed = F.size("_all") > 0
    out = marked.select("_row", changed.alias("_changed"), F.when(changed, _masked(F.col("text").cast("string"), F.col("_all"), mask)).otherwise(F.col("text")).alias("_clean"))
    new = {"text": F.col("_clean"), "n_chars": F.when(F.col("_changed"), F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
