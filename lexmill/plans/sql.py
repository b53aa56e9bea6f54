"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

#: White space of any kind; RE2's own class is ASCII.
SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A character that no text of the tables holds, between the entries of a list written as one text.
MARK = "chr(1)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def filled(xs: str) -> str:
    return f"list_filter(list_transform({xs}, lambda f: {strip('f')}), lambda f: f <> '')"


def cut_after(x: str, pattern: str) -> str:
    """x cut behind each match of a group that stays, what else matched goes."""
    return rf"string_split(regexp_replace({x}, '{pattern}', '\1' || {MARK}, 'g'), {MARK})"


def pack(parts: str, limit: int, sep: str, size: int) -> str:
    """Greedy packing: the last chunk grows as long as it stays within the limit."""
    last = f"length(list_last(string_split(a, {MARK})))"
    step = f"case when {last} + {size} + length(x) <= {limit} then a || {sep} || x else a || {MARK} || x end"
    return f"case when len({parts}) = 0 then []::varchar[] else string_split(list_reduce({parts}, lambda a, x: {step}), {MARK}) end"


def chunks(text: str, limit: int = 500) -> str:
    hard = f"list_transform(range(0, cast(floor((length(s) - 1) / {limit}) as bigint) + 1), lambda i: substring(s, i * {limit} + 1, {limit}))"
    sentences = filled(cut_after("x", r"([.!?])[\s\x0b]+"))
    parts = f"flatten(list_transform({filled(f'string_split({text}, chr(10))')}, lambda x: case when length(x) > {limit} then flatten(list_transform({sentences}, lambda s: case when length(s) > {limit} then {hard} else [s] end)) else [x] end))"
    return f"case when length({text}) <= {limit} then [{text}] else {pack(parts, limit, repr(' '), 1)} end"


def pages(text: str, limit: int = 900) -> str:
    blank = "chr(10) || chr(10)"
    blocks = rf"case when contains({text}, {blank}) then string_split({text}, {blank}) else {cut_after(text, r'(\. )')} end"
    return pack(filled(blocks), limit, blank, 2)


def plain(html: str) -> str:
    bare = f"regexp_replace({html}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    for entity, letter in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        bare = f"replace({bare}, '{entity}', {letter})"
    return squeeze(bare)


BLOCK_TAGS = "address|article|aside|blockquote|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|menu|nav|ol|p|pre|section|summary|table|caption|thead|tbody|tfoot|tr|td|th|ul"


def blocks(html: str, key: str, source: str) -> str:
    """(key, ord, tag, text) of the runs of text between block tags, by levels: a tag raises or lowers the level, any tag
    right after an open paragraph ends it, and a run stands in the last block opened at its level."""
    clean = rf"regexp_replace({html}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->', '', 'g')"
    tag = rf"(?is)</?(?:{BLOCK_TAGS})\b[^>]*>"
    tags = f"select {key}, regexp_split_to_array(c, '{tag}') as pieces, regexp_extract_all(c, '{tag}') as tags from (select {key}, {clean} as c from {source})"
    rows = f"select {key}, unnest(pieces) as piece, unnest(['-'] || tags) as tag, unnest(range(0, len(pieces))) as k from ({tags})"
    named = rf"select {key}, k, piece, lower(regexp_extract(tag, '(?i)^</?([a-z0-9]+)', 1)) as name, starts_with(tag, '</') as close from ({rows})"
    open_p = f"coalesce(lag(name = 'p' and not close) over (partition by {key} order by k), false)"
    moved = f"select *, case when name in ('', 'hr') then 0 when not close then 1 when name = 'p' and not {open_p} then 0 else -1 end - case when {open_p} and not (close and name = 'p') then 1 else 0 end as move from ({named})"
    levels = f"select *, sum(move) over (partition by {key} order by k) as level from ({moved})"
    stood = f"select {key}, k, {plain('piece')} as text, coalesce(case when level > 0 then last_value(case when not close and name not in ('', 'hr') then name end ignore nulls) over (partition by {key}, level order by k rows unbounded preceding) end, '') as tag from ({levels})"
    return f"select {key}, cast(row_number() over (partition by {key} order by k) - 1 as int) as ord, tag, text from ({stood}) where text <> ''"


def links(html: str, key: str, base: str, source: str) -> str:
    """(key, ord, href, text) of links, made absolute."""
    link = r"""(?is)<a\b[^>]*?href\s*=\s*["''']([^"''']*)["'''][^>]*>(.*?)</a\s*>""".replace("'''", "''")
    each = [f"regexp_extract_all({html}, '{link}', {k})" for k in (1, 2)]
    rows = f"select {key}, {base} as base, unnest({each[0]}) as h, unnest({each[1]}) as i, cast(generate_subscripts({each[0]}, 1) - 1 as int) as ord from {source}"
    href = r"""case when regexp_matches(h, '^https?://') then h when starts_with(h, '//') then 'https:' || h when starts_with(h, '/') then regexp_extract(base, '^(https?://[^/]+)', 1) || h else regexp_replace(base, '[^/]*$', '') || h end"""
    return f"select {key}, ord, {href} as href, {plain('i')} as text from ({rows})"


def sections(key: str, blocks_sql: str, is_header: str, least: int, number: str = "section") -> str:
    """(key, section, title, body): blocks under their header."""
    return f"""select {key}, {number}, max(case when hd then text end) as title, coalesce(string_agg(case when not hd then text end, chr(10) || chr(10) order by ord), '') as body
from (select *, cast(sum(hd::int) over (partition by {key} order by ord) as bigint) as {number} from (select *, ({is_header}) as hd from ({blocks_sql}))) where {number} > 0 group by {key}, {number} having length(coalesce(string_agg(case when not hd then text end, chr(10) || chr(10) order by ord), '')) >= {least}"""
