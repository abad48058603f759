"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re
import zlib

SF = "/root/testdata/sf0.001"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def shingles(text, k):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def groups(rows, k, percent):
    """Smallest id reachable from each row, by place."""
    sets = [set(shingles(t, k)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known, default=None)
    return [least[find(i)] if sets[i] else rows[i][0] for i in range(len(rows))], [len(s) for s in sets]


def leaks(rows, items, threshold=0.8, k=5):
    """Items that a window of their own size holds, by place of the row."""
    parsed = {i: shingles(t, k) for i, t in items if words(t)}
    holders = collections.Counter(s for x in parsed.values() for s in set(x))
    weigh = lambda s: 1 / holders.get(s, 1)
    out = []
    for _, text in rows:
        s = shingles(text, k)
        found = []
        for i, item in parsed.items():
            a = collections.Counter(item)
            if not set(s) & set(a):
                continue
            for at in range(len(s)):
                b = collections.Counter(s[at : at + len(item)])
                both = sum(min(a[x], b[x]) * weigh(x) for x in a)
                every = sum(max(a[x], b[x]) * weigh(x) for x in a | b)
                if both >= threshold * every:
                    found.append(i)
                    break
        out.append(sorted(found))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secret_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(joined.encode()).hexdigest()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def crc32(text):
    return zlib.crc32(text.encode())
