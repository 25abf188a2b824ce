"""Plain versions of the operators, and made corpora of near copies."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from fractions import Fraction

from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain(rows, k=3, percent=90):
    """Components by comparing everything with everything."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups, size, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(2, 160))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def fill(budget, caps, weights):
    """Water filling by repeated sharing; whole tokens by the largest remainder, then by name."""
    out, open_ = {}, set(caps)
    while open_:
        left, claim = budget - sum(out.values()), sum(weights[c] for c in open_)
        full = {c for c in open_ if Fraction(caps[c], weights[c]) <= Fraction(left, claim)}
        if not full:
            exact = {c: Fraction(left * weights[c], claim) for c in open_}
            down = {c: int(exact[c]) for c in open_}
            spare = left - sum(down.values())
            for n, c in enumerate(sorted(open_, key=lambda c: (down[c] - exact[c], c))):
                out[c] = down[c] + (n < spare)
            break
        out |= {c: caps[c] for c in full}
        open_ -= full
    return out


def shared_out(rows, weights, seed, target, epochs, none="(none)"):
    """Budgets by path and the drawn (doc_id, epoch) of rows (doc_id, text, path)."""
    size_of = lambda t: len(WORD.findall(t or ""))
    rows = [(i, t, tuple(none if x is None else x for x in path)) for i, t, path in rows]
    leaves = defaultdict(int)
    for _, t, path in rows:
        leaves[path] += size_of(t)
    total = sum(leaves.values())
    budget = {(): min(total if target is None else target, total * epochs)}
    for depth in range(1, max(map(len, leaves), default=0) + 1):
        caps = defaultdict(int)
        for leaf, size in leaves.items():
            caps[leaf[:depth]] += size * epochs
        for up in {c[:-1] for c in caps}:
            mine = {c: v for c, v in caps.items() if c[:-1] == up}
            budget |= fill(budget[up], mine, {c: weights.get(c, 1) for c in mine})
    out = []
    for leaf, size in leaves.items():
        if not size:
            continue
        passes, rest = divmod(budget[leaf], size)
        key = lambda i, p=passes: hashlib.md5(f"{seed}:{p}:{none if i is None else i}".encode()).hexdigest()
        mine = [(i, size_of(t)) for i, t, path in rows if path == leaf]
        out += [(i, e) for i, _ in mine for e in range(passes)]
        by = defaultdict(int)
        for i, k in mine:
            by[key(i)] += k
        start, taken = 0, set()
        for k in sorted(by):
            if start < rest:
                taken.add(k)
            start += by[k]
        out += [(i, passes) for i, _ in mine if key(i) in taken]
    return budget, sorted(out, key=str)


def token_rows(rows, path, end=2):
    """doc_id, start, n_tokens and crc32 of every row, by the tokenizer alone."""
    tokenizer, at, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = struct.pack(f"<{len(x := [*tokenizer.encode(t or '', add_special_tokens=False).ids, end])}I", *x)
        out.append((i, at, len(x), zlib.crc32(ids)))
        at += len(x)
    return out
