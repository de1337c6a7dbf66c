"""Plain Python twins of the training-data operators that SQL cannot express."""

import math
import re
import struct
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash

MASK = (1 << 64) - 1


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def space_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", low(s))


def alnum_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))


def crc(text):
    return zlib.crc32((text or "").encode())


def shuffled(doc_id, text, seed=42):
    """The seeded 31-bit key by which rows are put in random order."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for x in (doc_id, crc(text)):
        if x is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return h >> 33


def source_order(source):
    return (source is None, source or "")


def _order(row):
    doc_id, text, _ = row
    return (shuffled(doc_id, text), doc_id is not None, doc_id or 0, crc(text), len(space_words(text)))


def by_source(rows):
    out = defaultdict(list)
    for row in rows:
        out[row[2]].append(row)
    return {s: sorted(out[s], key=_order) for s in sorted(out, key=source_order)}


def water_level(sizes, weights, total, most=2.0):
    """Share by weight; whoever is above ``most`` times its size stops there and the excess is shared again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(o for i, o in enumerate(out) if i not in open_)
        for i in open_:
            out[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if out[i] > most * sizes[i]}
        if not over:
            break
        for i in over:
            out[i] = most * sizes[i]
        open_ -= over
    return out


def mix(rows, most_slots, golden):
    """(doc_id, size, source_size, target, taken) of (doc_id, text, source) rows, word by word and slot by slot."""
    groups = by_source(rows)
    sizes = [sum(len(space_words(t)) for _, t, _ in g) for g in groups.values()]
    want = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes))
    blocks = max(1024, most_slots // (2 * max(1, len(sizes))))
    size_of = [max(1, math.ceil(s / blocks)) for s in sizes]
    n_blocks = [math.ceil(s / b) for s, b in zip(sizes, size_of)]
    shares = [w / b for w, b in zip(want, size_of)]
    edges, run = [], 0.0
    for s in shares:
        run += s
        edges.append(run)
    edges = [e / run for e in edges] if run else []
    times, rank = [Counter() for _ in sizes], [0] * len(sizes)
    for k in range(round(run)):
        i = min(bisect_right(edges, (k * golden & MASK) / 2.0**64), len(sizes) - 1)
        if rank[i] < 2 * n_blocks[i]:
            times[i][rank[i] % n_blocks[i]] += 1
        rank[i] += 1
    out = []
    for i, g in enumerate(groups.values()):
        at = 0
        for doc_id, text, _ in g:
            n = len(space_words(text))
            out.append((doc_id, n, sizes[i], want[i], sum(times[i][w // size_of[i]] for w in range(at, at + n))))
            at += n
    return out


def shard(rows, n_shards=40):
    """(doc_id, shard, slot) of (doc_id, text, source) rows by exact fractions."""
    placed = []
    for s, g in by_source(rows).items():
        key = "n" if s is None else "k" + s
        placed += [(Fraction(2 * r + 1, 2 * len(g)), key, _order(row), r, row[0]) for r, row in enumerate(g)]
    placed.sort(key=lambda x: x[:4])
    out, total = [], len(placed)
    for p, x in enumerate(placed):
        s = p * n_shards // total
        out.append((x[4], s, p - -(-s * total // n_shards)))
    return out


def _mixed(h):
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & MASK
    return h ^ h >> 31


def buckets(text):
    """Hashed 2- to 4-grams of the letters of a text, a space behind each run."""
    s = "".join("".join(run) + " " for run in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())))
    out = []
    for n in (2, 3, 4):
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x100000001B3 + ord(c) + 1) & MASK
            out.append(_mixed((h + (n << 56)) & MASK) >> 48)
    return out


def languages(learned, texts):
    """(language, posterior, n-grams, strangeness) of each text, from (text, language) rows."""
    counts, docs = defaultdict(Counter), Counter()
    for text, lang in learned:
        counts[lang].update(buckets(text))
        docs[lang] += 1
    total = {g: sum(counts[g].values()) + 0.5 * 65536 for g in counts}

    def log(g, b):
        return math.log((counts[g][b] + 0.5) / total[g])

    usual = {g: sum(math.exp(log(g, b)) * log(g, b) for b in range(65536)) for g in counts}
    out = []
    for text in texts:
        got = buckets(text)
        if not counts or not any(c.isalpha() for c in (text or "").lower()):
            out.append(("und", 0.0, len(got), 0.0))
            continue
        sums = {g: sum(log(g, b) for b in got) for g in sorted(counts)}
        score = {g: s + math.log(docs[g] / sum(docs.values())) for g, s in sums.items()}
        best = max(score, key=score.get)
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values()), len(got), usual[best] - sums[best] / len(got)))
    return out


def shingles(t, k=5):
    w = space_words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(texts, least=0.8):
    """Smallest row that each text reaches by links of a Jaccard similarity of ``least`` or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def windows(text, n=10):
    w = alnum_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def holds(text, wanted):
    """Whether a window of the benchmark stands in the text."""
    w = alnum_words(text)
    return any(tuple(w[i : i + n]) in wanted for n in {len(x) for x in wanted} for i in range(len(w) - n + 1))


def pipeline(rows, bench, most_slots, golden):
    """(doc_id, shard, slot) of (doc_id, text, lang, source) rows; doc_ids are distinct and ascend."""
    found = languages([(t, g) for _, t, g, _ in rows if g is not None], [r[1] for r in rows])
    rows = [r for r, (g, p, n, s) in zip(rows, found) if g != "und" and p >= 0.5 and not (n >= 300 and s > 2.25)]
    rows = [r for i, (r, c) in enumerate(zip(rows, classes([r[1] for r in rows]))) if c == i]
    wanted = set().union(*map(windows, bench))
    rows = [(i, t, s) for i, t, _, s in rows if not holds(t, wanted)]
    text = {i: (i, t, s) for i, t, s in rows}
    copies = [(i, math.floor(taken / n + 0.5) if n else 1) for i, n, _, _, taken in mix(rows, most_slots, golden)]
    return shard([text[i] for i, c in copies for _ in range(c)])
