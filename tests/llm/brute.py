"""Plain Python versions to compare with."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def words(text):
    return WORD.findall(lower((text or "").encode()))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def ngram(docs, percent=75):
    """id -> (shingles, component)"""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    edges = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    comp = components(ids, edges)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def lines(docs):
    """id -> text without the lines that are nearly an earlier one"""
    every = [((i, k), frozenset(words(x))) for i, t in sorted(docs, key=lambda d: d[0]) if t is not None for k, x in enumerate(t.split("\n"))]
    gone = defaultdict(set)
    for n, (place, s) in enumerate(every):
        for _, e in every[:n]:
            both = len(s & e)
            near = 4 * both >= 3 * (len(s) + len(e) - both)
            if s and near:
                gone[place[0]].add(place[1])
                break
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def repeats(docs, width=100):
    """id -> (bytes, removed, spans, sha256)"""
    first, data = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        data[i] = b
        for s in range(len(b) - width + 1):
            first.setdefault(b[s : s + width], (i, s))
    out = {}
    for i, b in data.items():
        covered = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < (i, s):
                covered[s : s + width] = b"\x01" * width
        spans = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def best_alignments(codes, every, overlap, error):
    """id -> (match id, offset, bit error, links): every offset of every pair, scored bit by bit."""
    out = {}
    for i, a in codes.items():
        found = []
        for q, b in codes.items():
            if q % every or q == i:
                continue
            best = None
            for off in range(overlap - len(b), len(a) - overlap + 1):
                x, y = max(0, off), max(0, -off)
                k = min(len(a) - x, len(b) - y)
                e = sum(bin(s ^ t).count("1") for s, t in zip(a[x : x + k], b[y : y + k])) / (32 * k) if k >= overlap else 1
                if e <= error and (best is None or (e, off) < best):
                    best = (e, off)
            if best:
                found.append((best[0], q, best[1]))
        e, q, off = min(found, default=(None, None, None))
        out[i] = (q, off, e, len(found))
    return out


def toxic_words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", lower((text or "").encode()))


def toxicity(docs, labels, folds=5, held=0, k=15, soften=0.05):
    """id -> (score, nearest ids): every example scored for every text, by plain sums; ``docs`` has one row per id."""
    from lipika.llm import isotonic

    bags = {i: Counter(toxic_words(t)) for i, t in docs}
    known = sorted(i for i in bags if labels.get(i) is not None and zlib.crc32(str(i).encode()) % folds != held)
    y = {i: labels[i] for i in known}
    found = Counter(w for b in bags.values() for w in b)
    idf = {w: math.log(1 + len(bags) / n) for w, n in found.items()}
    has = {label: Counter(w for i in known if y[i] == label for w in bags[i]) for label in (0, 1)}

    def phi(w, but=None):
        all0, all1 = (sum(y[i] == label for i in known if i != but) for label in (0, 1))
        n0, n1 = (has[label][w] - (but is not None and y[but] == label and w in bags[but]) for label in (0, 1))
        spread = all0 * all1 * (n0 + n1) * (all0 + all1 - n0 - n1)
        return abs(n1 * (all0 - n0) - n0 * (all1 - n1)) / math.sqrt(spread) if spread > 0 else 0.0

    every = {w: phi(w) for i in known for w in bags[i]}

    def weights(i, but=None):
        v = {w: (1 + math.log(c)) * idf[w] * (every[w] if but is None else phi(w, but)) for w, c in bags[i].items() if w in every}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else v

    index = {i: weights(i) for i in known}

    def nearest(v, but=None):
        sims = [(-round(sum(x * index[j].get(w, 0.0) for w, x in v.items()), 12), j) for j in known if j != but]
        return [(j, -s) for s, j in sorted(sims) if s < 0][:k]

    def vote(near):
        w = [1 / (1 - min(s, 1) + soften) for _, s in near]
        return sum(x * y[j] for x, (j, _) in zip(w, near)) / sum(w)

    own = {i: nearest(weights(i, i), i) for i in known}
    bare = [y[i] for i in known if not own[i]]
    empty = (sum(bare) + sum(y.values()) / len(y)) / (len(bare) + 1)
    raw = sorted((round(vote(n), 3), y[i]) for i, n in own.items() if n)
    xs = sorted({r for r, _ in raw})
    import numpy as np

    curve = isotonic.pool_adjacent(np.array(xs), np.array([float(sum(v for r, v in raw if r == x)) for x in xs]), np.array([float(sum(r == x for r, _ in raw)) for x in xs]))
    out = {}
    for i in bags:
        near = nearest(weights(i))
        out[i] = (float(isotonic.probability(curve, np.array([vote(near)]))[0]) if near else empty, [j for j, _ in near[:3]])
    return out


def quality(docs, labels, folds=3, held=1):
    """id -> score, by one matrix of all rows; ``docs`` has one row per id."""
    import numpy as np

    from lipika.llm import isotonic
    from lipika.llm import quality as q

    ids = [i for i, _ in docs]
    x = np.array([q.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for _, t in docs])
    rng, d = np.random.default_rng(q.SEED), x.shape[1]
    w, b = rng.normal(0, 1 / np.sqrt(d), (d, q.FEATURES)), rng.uniform(0, 2 * np.pi, q.FEATURES)
    std = x.std(axis=0)
    z = np.clip((x - x.mean(axis=0)) / np.where(std > 1e-9, std, 1.0), -8, 8)
    z = np.hstack([np.sqrt(2 / q.FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))])
    known = [k for k, i in enumerate(ids) if labels.get(i) is not None and zlib.crc32(str(i).encode()) % folds != held]
    aside = [k for k in known if zlib.crc32(f"calibration:{ids[k]}".encode()) % q.CALIBRATION == 0]
    fit = [k for k in known if k not in aside]
    y = np.array([float(labels[ids[k]]) for k in fit])
    gram = z[fit].T @ z[fit]
    beta = np.linalg.solve(gram + q.RIDGE * len(fit) * np.eye(len(gram)) / len(gram), z[fit].T @ y)
    raw = z @ beta
    bins = defaultdict(list)
    for k in aside:
        bins[min(max(math.floor((raw[k] + 1) / 3 * q.BINS), 0), q.BINS)].append((raw[k], labels[ids[k]]))
    rows = [bins[k] for k in sorted(bins)]
    curve = isotonic.pool_adjacent(*(np.array(c) for c in zip(*((np.mean([r for r, _ in v]), float(sum(l for _, l in v)), float(len(v))) for v in rows))))
    return dict(zip(ids, isotonic.probability(curve, raw)))
