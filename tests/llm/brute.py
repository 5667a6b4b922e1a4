"""Plain sequential versions of the operators, for small tables."""

import collections
import hashlib
import html
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


class Classes:
    def __init__(self, items):
        self.above = {i: i for i in items}

    def root(self, x):
        while self.above[x] != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.above[b] = a


def repeats(texts):
    """(n_bytes, n_removed, n_spans, digest of the rest) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return out


def statistics(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    twice = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(twice)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def near_duplicates(rows):
    """{id: (n_shingles, component)}."""
    sets = {i: shingles(t) for i, t in rows}
    classes, ids = Classes(sets), sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                classes.join(i, j)
    return {i: (len(sets[i]), classes.root(i)) for i in ids}


def dropped_lines(rows, size, percent):
    """Line places (id, number) that are not the first of their component; lines below ``size`` bytes are linked by equality."""
    lines = [((i, n), x.encode()) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if WORD.search(x)]
    sets = {p: frozenset(x[k : k + size] for k in range(len(x) - size + 1)) or frozenset([x]) for p, x in lines}
    classes, places = Classes(sets), sorted(sets)
    holders = collections.defaultdict(list)
    for place in places:
        shared = collections.Counter(other for s in sets[place] for other in holders[s])
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[place]) + len(sets[other]) - n):
                classes.join(place, other)
        for s in sets[place]:
            holders[s].append(place)
    return {p for p in places if classes.root(p) != p}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    """Base spans (kind, start, end)."""
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inside))
    return "\n".join(b for b in blocks if b)
