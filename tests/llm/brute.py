"""Plain Python versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

WORD = r"[^\x20\x09-\x0D]+"
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "markov")


def hash_of(*values):
    """Spark's xxhash64: each value's XXH64 is the seed of the next; nulls leave it."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def base_failed(text):
    n, *_, repeated = statistics(text)
    return n < 50 or 100 * repeated > 50 * n


def features(text):
    n, chars, symbols, dup, repeated = statistics(text)
    per = max(n, 1)
    shout = len(re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}", text or ""))
    return (float(n), chars / per, symbols / per, 100 * dup / per, repeated / per, shout / per)


def learned_rules(rows, quality, bins=64, max_rules=6, max_conditions=3, precision=0.97, least=5):
    """Sequential covering over rows (doc_id, text) with quality {doc_id: 0 or 1}; rules are lists of (feature, above, threshold)."""
    known = [(quality[d] == 0, _int_hash(d, 10) % 3 == 0, features(t)) for d, t in rows if d in quality and not base_failed(t)]
    edges = []
    for k in range(6):
        ordered = sorted(f[k] for *_, f in known)
        marks = sorted({ordered[max(math.ceil(Fraction(q, bins) * len(ordered)) - 1, 0)] for q in range(1, bins)}) if ordered else []
        edges.append([(a + b) / 2 for a, b in zip(marks, marks[1:], strict=False)])
    holds = lambda c, f: (f[c[0]] > c[2]) if c[1] else (f[c[0]] <= c[2])
    left, found = known, []
    while len(found) < max_rules:
        grown, rows_in = [], [r for r in left if not r[1]]
        while len(grown) < max_conditions:
            total = [sum(r[0] is want for r in rows_in) for want in (True, False)]
            if not all(total):
                break
            best = None
            for k in range(6):
                for t in edges[k]:
                    for above in (False, True):
                        p, n = (sum(r[0] is want and holds((k, above, t), r[2]) for r in rows_in) for want in (True, False))
                        if p:
                            gain = p * (math.log2(p / (p + n)) - math.log2(total[0] / sum(total)))
                            if best is None or gain > best[0] + 1e-9:
                                best = gain, (k, above, t)
            if best is None or best[0] <= 1e-9:
                break
            grown.append(best[1])
            rows_in = [r for r in rows_in if holds(best[1], r[2])]
        if not grown:
            break

        def tally(rows, conditions):
            hit = [r for r in rows if all(holds(c, r[2]) for c in conditions)]
            return sum(r[0] for r in hit), sum(not r[0] for r in hit)

        worth = []
        for k in range(1, len(grown) + 1):
            bad, good = tally([r for r in left if r[1]], grown[:k])
            worth.append(((bad - good) / max(bad + good, 1), -k))
        rule = grown[: -max(worth)[1]]
        bad, good = tally(left, rule)
        if bad < least or bad < precision * (bad + good):
            break
        found.append(rule)
        left = [r for r in left if not all(holds(c, r[2]) for c in rule)]
    return found


def _int_hash(d, k):
    """xxhash64 of a long and an int, as Spark has them."""
    h = xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(k.to_bytes(4, "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def good(text, rules):
    f = features(text)
    return not base_failed(text) and not any(all((f[k] > t) if above else (f[k] <= t) for k, above, t in rule) for rule in rules)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def similar(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def roots(n, linked):
    """For n items the least item reachable over linked(i, j)."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(k) for k in range(n)]


def first_of_near_copies(rows):
    """rows (doc_id, text, ...) without near copies: of each group the one with the least doc_id, null ids last."""
    sets = [shingles(r[1]) for r in rows]
    groups = defaultdict(list)
    for row, root in zip(rows, roots(len(rows), lambda i, j: similar(sets[i], sets[j])), strict=True):
        groups[root].append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def all_spans(text, ratios, threshold, alphabet):
    base, added = base_spans(text), []
    for m in RUN.finditer(text or ""):
        at = [alphabet.index(c) for c in m[0]]
        mean = sum(round(ratios[a * len(alphabet) + b], 4) for a, b in zip(at, at[1:], strict=False)) / (len(at) - 1)
        if mean > threshold and not any(s < m.end() and m.start() < e for s, _, e in base):
            added.append((m.start(), 3, m.end()))
    return sorted(base + added)


def masked(text, spans, mask="[SECRET]"):
    if text is None:
        return None
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + mask
        at = max(at, end)
    return out + text[at:]


def n_words(text):
    return len(re.findall(WORD, text or ""))


def mix(rows, most=3):
    """Copies of each of rows (doc_id, text, source); rows alike share what is over in any way."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    size = Counter()
    for _, t, s in rows:
        size[s] += n_words(t)
    whole, target, full = sum(size.values()), {}, set()
    while True:
        left = [s for s in sources if s not in full]
        level = (whole - sum(most * size[s] for s in full)) / max(sum(weight[s] for s in left), 1)
        over = {s for s in left if weight[s] * level >= most * size[s]}
        if not over:
            break
        full |= over
    target = {s: most * size[s] if s in full else weight[s] * level for s in sources}
    copies = {}
    for s in sources:
        cells = defaultdict(list)
        for k, (d, t, source) in enumerate(rows):
            if source == s:
                cells[n_words(t)].append((hash_of(d, t), k))
        mean = size[s] / max(sum(map(len, cells.values())), 1)
        rate = lambda n, tilt: min(most, math.exp(min(tilt * n / mean, 50)))  # noqa: B023, E731
        low, high = -1e3, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            if sum(len(c) * n * rate(n, mid) for n, c in cells.items() if n) < target[s]:
                low = mid
            else:
                high = mid
        carry = 0.0
        for n in sorted(cells, reverse=True):
            if n == 0:
                copies |= {k: 1 for _, k in cells[n]}
                continue
            wanted = len(cells[n]) * (most if s in full else rate(n, high)) * n + carry
            whole_copies = min(max(math.floor(wanted / n + 0.5), 0), most * len(cells[n]))
            carry = wanted - whole_copies * n
            base, more = divmod(whole_copies, len(cells[n]))
            for place, (_, k) in enumerate(sorted(cells[n])):
                copies[k] = base + (place < more)
    return [copies[k] for k in range(len(rows))], target, size
