"""Plain versions of the operators, one text at a time or all pairs, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def dedup_lines(rows, run=3):
    """Texts after removal; rows are (id, text) with different ids."""
    seen, cut = set(), {}
    for key, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(full) - run + 1):
            window = tuple(lines[i] for i in full[k : k + run])
            if window in seen:
                gone |= set(full[k : k + run])
            seen.add(window)
        cut[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return {key: cut.get(key) for key, _ in rows}


def repeated_words(texts, run):
    """For each text the kept words, by counting all windows."""
    split = [words(t) for t in texts]
    windows = Counter(tuple(w[i : i + run]) for w in split for i in range(len(w) - run + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - run + 1) if windows[tuple(w[i : i + run])] > 1 for k in range(run)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def components(rows, n, percent):
    """id -> (set size, least id reachable) by all pairs."""
    sets = {}
    for key, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """Base spans, by start, then kind as listed."""
    text, found = text or "", []
    for k, (kind, p) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def secrets(text):
    text, found = text or "", []
    for k, (kind, p, least) in enumerate(
        [
            ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
            ("access", r"AKIA[A-Z0-9]+", 20),
            ("hex", r"[0-9a-f]+", 24),
        ]
    ):
        for m in re.finditer(p, text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaks(docs, items, shingle=5):
    """(doc, item) -> the greatest weighted similarity of a window of the item's size, by all windows.

    Only pairs of 0.5 or more; docs and items are (id, text).
    """
    from math import log

    cut = lambda t: [x for x in re.split(r"[^\w]+|_+", (t or "").lower()) if x]
    grams = lambda w: [tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)]
    listed = [(i, t, len(cut(t)), set(grams(cut(t)))) for i, t in {(i, t) for i, t in items if t} if len(cut(t)) >= shingle]
    df = Counter(g for _, _, _, s in listed for g in s)
    weight = lambda g: int(100 * (1 + log(max(1, len(listed)) / df.get(g, 1))) + 0.5)
    out = {}
    for d, t in docs:
        gs = grams(cut(t))
        known = {g for g in gs if g in df}
        for i, _, size, s in listed:
            if sum(map(weight, known & s)) < 0.5 * sum(map(weight, s)):
                continue
            for start in range(len(gs)):
                window = set(gs[start : start + size - shingle + 1])
                both = sum(map(weight, window & s))
                alike = both / (sum(map(weight, window)) + sum(map(weight, s)) - both)
                if alike >= 0.5 and alike > out.get((d, i), 0):
                    out[d, i] = alike
    return out


def quality_rates(text):
    n_words, chars, symbols, dup, repeat, failed = base_counts(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    rates = {
        "symbol_rate": symbols * 1000 // max(chars, 1),
        "dup_line_rate": dup * 1000 // max(lines, 1),
        "repeat_rate": repeat * 1000 // max(n_words, 1),
        "char_rate": chars * 100 // max(n_words, 1),
        "line_rate": lines * 1000 // max(n_words, 1),
    }
    return rates, failed


def quality_verdicts(rows, prior=100, reach=6):
    """Whether each (lang, source, text) is kept: fences of blended counts of rounded rates."""
    from math import floor

    margins = {"symbol_rate": 50, "dup_line_rate": 400, "repeat_rate": 400, "char_rate": 300, "line_rate": 500}

    def rounded(x):
        e = max(x.bit_length() - 7, 0)
        return x >> e << e

    unit = 1 << 20
    measured = [(*quality_rates(t), lang, source) for lang, source, t in rows]
    good = [m for m in measured if not m[1]]

    def blended(own, parent):
        total = sum(parent.values())
        return {x: own.get(x, 0) * unit + floor(prior * unit * (w / total)) for x, w in parent.items()}

    def fence(lang, source, rate):
        counts = lambda keep: Counter(rounded(m[0][rate]) for m in good if keep(m))
        corpus = {x: n * unit for x, n in counts(lambda m: True).items()}
        w = blended(counts(lambda m: m[2:] == (lang, source)), blended(counts(lambda m: m[2] == lang), corpus))
        total, below, cut = sum(w.values()), 0, {}
        for x in sorted(w):
            below += w[x]
            for q in (1, 3):
                if below * 4 >= total * q:
                    cut.setdefault(q, x)
        width = reach * (cut[3] - cut[1]) if cut[1] < cut[3] else margins[rate]
        return (cut[1] - width if rate == "char_rate" else float("-inf")), cut[3] + width

    known, out = {}, []
    for rates, failed, lang, source in measured:
        kept = not failed
        for rate, x in rates.items() if kept else ():
            at = (lang, source, rate)
            if at not in known:
                known[at] = fence(*at)
            kept &= known[at][0] <= x <= known[at][1]
        out.append(kept)
    return out


def tree_place(key_hash, topology):
    """The shard of a key by descending region, rack and shard; key_hash(node) is the 64-bit hash of key and node."""
    from math import log

    def draw(children):
        best = None
        for node, weight, value in children:
            u = ((key_hash(node) % 2**64 >> 11) + 0.5) / 2.0**53
            best = min(x for x in (best, (-log(u) / weight, value)) if x is not None)
        return best[1]

    live = sorted((x for x in topology if x.weight > 0), key=lambda x: x.shard)
    sums = lambda level: [(n, sum(x.weight for x in live if level(x) == n), n) for n in dict.fromkeys(map(level, live))]
    region = draw(sums(lambda x: x.region))
    live = [x for x in live if x.region == region]
    rack = draw(sums(lambda x: x.rack))
    return draw([(f"{rack}/s{x.shard}", x.weight, x.shard) for x in live if x.rack == rack])
