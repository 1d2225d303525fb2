"""Plain-Python versions of the training-data operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def base_scores(docs):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    toks = {i: [*words(lower(t)), None] for i, t in docs}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    out = {}
    for i, ws in toks.items():
        out[i] = (held[i], len(ws), sum(c[w] > 0 for w in ws), n,
                  sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    return out


def exact_groups(docs):
    by = defaultdict(list)
    for i, t in docs:
        by[t or ""].append(i)
    return {i: (max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), sha(t or "")) for i, t in docs}


def shingle_set(text):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def interleaved(docs, shards=16, seed="shard-1"):
    """docs: (doc_id, text, source); doc_id -> (shard, slot)."""
    by = defaultdict(list)
    for i, _, s in docs:
        by[s].append((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    order = []
    for s, rows in by.items():
        for r, (k, i) in enumerate(sorted(rows), 1):
            order.append(((2 * r - 1) / (2 * len(rows)), s is not None, s or "", k, i))
    out, taken, n = {}, Counter(), len(order)
    for p, (*_, i) in enumerate(sorted(order)):
        shard = p * shards // n
        out[i] = (shard, taken[shard])
        taken[shard] += 1
    return out


def water_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: source -> words; the targets after clamping and sharing out."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in clamped)
        open_w = sum(w[s] for s in order if s not in clamped)
        t = {s: cap * sizes[s] if s in clamped else rest * w[s] / open_w for s in order}
        above = {s for s in order if s not in clamped and t[s] > cap * sizes[s]}
        if not above:
            return t
        clamped |= above


def text_counts(text):
    w, t = words(text), text or ""
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def binomial_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))


def repeats(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            if x in seen:
                gone[s:s + length] = [True] * length
            seen.add(x)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def secret_spans(text):
    t = text or ""
    found = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def warc_rows(pages):
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h or "", i)
    out = {}
    for i, h in pages:
        n = len((h or "").encode())
        again = n >= 100 and first[h or ""] != i
        out[i] = (n, sha(h or ""), "revisit" if again else "response", first[h or ""] if again else None)
    return out


def head_turns(c):
    return zlib.crc32(str(c).encode()) % 9


def family(c):
    """c - c % 5 with the remainder's sign of SQL."""
    return c - int(math.copysign(abs(c) % 5, c))


def rebuilt_conversations(rows):
    """(conv_id, turn, role, text) rows to conv_id -> [(role, text)] with the heads of the families."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    return {c: own.get(family(c), [])[:head_turns(c)] + v[head_turns(c):] for c, v in own.items()}


def trie(conversations):
    """Rows of every distinct prefix, as the trie's contract has them."""
    members, kids = defaultdict(list), Counter()
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    return sorted((
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
         sha(",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(k))))))
        for k, m in members.items()), key=str)


def without_repeated_windows(docs, n=50):
    """(id, text) rows to (n_words, n_removed, kept) of each row, in order."""
    first = {}
    all_words = [(-math.inf if i is None else i, words(t)) for i, t in docs]
    for i, ws in all_words:
        for a in range(len(ws) - n + 1):
            w = tuple(ws[a:a + n])
            first[w] = min(i, first.get(w, math.inf))
    out = []
    for i, ws in all_words:
        gone = {b for a in range(len(ws) - n + 1) if first[tuple(ws[a:a + n])] < i for b in range(a, a + n)}
        out.append((len(ws), len(gone), " ".join(w for b, w in enumerate(ws) if b not in gone)))
    return out
