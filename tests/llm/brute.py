"""Plain versions of the operators, for comparison on small data."""

import re
from collections import Counter, defaultdict


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def lines(docs, min_docs=3, min_chars=20):
    """{index: (n_lines, n_dropped, text)} of rows (id, text)."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    has = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                has[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(has.get(key(x), ())) >= min_docs and max(has[key(x)]) != (-1 if i is None else i))]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(docs, k, percent=80):
    """{id: (n_shingles, component)}; ids must be unique."""
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def contamination(docs, items):
    """[(id, n_words, n_hit, items)]"""
    wins = defaultdict(set)
    for item, t in items:
        w = item_words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add(str(item))
    out = []
    for d, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), sorted(found)))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (n, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": n == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[n]
            if ok:
                out.append((m.start(), k, m.end(), n))
    return sorted(out)


def statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, cov = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            cov |= {i, i + 1, i + 2}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cov)


def repeats(docs, n=51):
    """{id: places of words in ``n`` words in a row that another document has}."""
    where = defaultdict(set)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for i, t in docs}
    for i, w in split.items():
        for at in range(len(w) - n + 1):
            where[tuple(w[at : at + n])].add(i)
    out = {}
    for i, w in split.items():
        for at in range(len(w) - n + 1):
            if len(where[tuple(w[at : at + n])]) > 1:
                out.setdefault(i, set()).update(range(at, at + n))
    return out
