"""Plain rewrites of the operators' definitions."""

import collections
import math
import re
import zlib

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW) if lower else text or "")


def simhash(text):
    import xxhash

    w = words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints, ids, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(prints)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(prints))]


def kept_lines(rows, threshold=0.8):
    """By (id, text): numbers of the lines that stay, and how many lines have words."""
    import xxhash

    def order(x):
        h = xxhash.xxh64_intdigest(x[1].encode(), 42)
        return x[0] is None, x[0] if x[0] is not None else 0, h - (h >> 63 << 64)

    texts = sorted({(i, t or "") for i, t in rows}, key=order)
    first = {}
    for number, (_, text) in enumerate(texts):
        for no, line in enumerate(text.split("\n")):
            if s := frozenset(words(line)):
                first.setdefault(s, (number, no))
    kept = collections.defaultdict(list)
    for s, place in first.items():
        if not any(p < place and len(s & o) >= threshold * len(s | o) - 1e-9 for o, p in first.items() if o is not s):
            kept[texts[place[0]]].append(place[1])
    return {k: (sorted(kept[k]), sum(bool(words(x)) for x in k[1].split("\n"))) for k in texts}


def quality(text):
    w, lines = words(text, False), [x for x in (text or "").split("\n") if words(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def language_model(rows, fold=lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2, d=0.75):
    """Scores of (id, text) rows as the trie's definition gives them, without quantisation."""
    tokens = [["<s>", *words(t), "</s>"] for _, t in rows]
    one, two, three, size, n = (collections.Counter() for _ in range(3)), None, None, 0, 0
    one, two, three = one
    for (i, t), w in zip(rows, tokens):
        if not fold(i):
            n += 1
            size += len((t or "").encode())
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    least = 2
    total, v = sum(one.values()), len(one)
    count = {**one, "<s>": n}
    k2, k3 = ({g: c for g, c in x.items() if c >= least} for x in (two, three))
    l1, l2 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (a, b), c in k2.items():
        l1[a] -= (c - d) / count[a]
    for (a, b, e), c in k3.items():
        l2[a, b] -= (c - d) / two[a, b]
    p1 = lambda w: (one.get(w, 0) + 1) / (total + v + 1)
    p2 = lambda a, w: ((k2[a, w] - d) / count[a] if (a, w) in k2 else 0) + l1[a] * p1(w)
    p3 = lambda a, b, w: ((k3[a, b, w] - d) / two[a, b] if (a, b, w) in k3 else 0) + l2[a, b] * p2(b, w)
    out = []
    for (i, _), w in zip(rows, tokens):
        base = sum(math.log10(p1(x)) for x in w[1:])
        score = math.log10(p2(w[0], w[1])) + sum(math.log10(p3(*g)) for g in zip(w, w[1:], w[2:]))
        out.append((i, fold(i), len(w) - 1, sum(x in one for x in w[1:]), total, base, score))
    return out
