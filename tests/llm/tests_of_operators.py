"""Brute-force versions of operators that more than one test compares with."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def leaf_rows(df):
    """Rows of ``brute_mix``: id, text and the leaf of the budget tree."""
    rows = []
    for r in df.collect():
        m = re.search("([0-9]+)$", r.source or "")
        leaf = ("broad" if m and int(m[1]) < 10 else "niche", r.lang or "\x00null", r.source or "\x00null")
        rows.append({"id": "\x00null" if r.doc_id is None else str(r.doc_id), "text": r.text, "leaf": leaf})
    return rows


def brute_mix(rows, weights, share, epochs, seed=11):
    def key(r, epoch):
        base = f"{r['id']}|{hashlib.md5((r['text'] or '').encode()).hexdigest()}"
        return int(hashlib.md5(f"{seed}|{epoch}|{base}".encode()).hexdigest()[:15], 16)

    tokens = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    caps = Counter()
    for r in rows:
        for d in range(4):
            caps[r["leaf"][:d]] += tokens(r) * epochs
    budgets = {(): sum(map(tokens, rows)) * share}
    for d in range(3):
        for parent in [p for p in caps if len(p) == d]:
            kids = [k for k in caps if len(k) == d + 1 and k[:d] == parent]
            left, open_, alloc = budgets[parent], set(kids), dict.fromkeys(kids, 0.0)
            w = {k: weights.get("/".join(k), 1.0) for k in kids}
            while open_:
                level = left / sum(w[k] for k in open_)
                full = {k for k in open_ if caps[k] <= level * w[k] + 1e-9}
                if not full:
                    for k in open_:
                        alloc[k] = level * w[k]
                    break
                for k in full:
                    alloc[k] = caps[k]
                    left -= caps[k]
                open_ -= full
            budgets.update(alloc)
    out = Counter()
    for leaf in [p for p in caps if len(p) == 3]:
        mine = [r for r in rows if r["leaf"] == leaf]
        total = sum(map(tokens, mine))
        whole = min(math.floor(budgets[leaf] / total), epochs) if total else 0
        rest = budgets[leaf] - whole * total
        by = defaultdict(int)
        for r in mine:
            by[key(r, whole + 1)] += tokens(r)
        so_far, taken = 0, set()
        for k in sorted(k for k in by if by[k]):
            so_far += by[k]
            if so_far > rest:
                break
            taken.add(k)
        for r in mine:
            extra = whole < epochs and rest > 0 and tokens(r) > 0 and key(r, whole + 1) in taken
            out[r["id"], tokens(r), whole + extra] += 1
    return out


def brute_links(rows, threshold):
    sets = []
    for r in rows:
        w = WORD.findall(lower(r.text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if sets[i]:
            low.setdefault(find(i), []).append(r.doc_id)
    name = lambda i: min((x for x in low[find(i)] if x is not None), default=None) if sets[i] else rows[i].doc_id
    return Counter((r.doc_id, name(i), links[i]) for i, r in enumerate(rows))


def brute_decontam(rows, items, span=10):
    wins = []
    for i in items:
        w = WORD.findall(lower(i.text))
        n = min(span, len(w))
        wins.append((str(i.item_id) if i.item_id is not None else "null", {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set(), n))
    out = Counter()
    for r in rows:
        w, hit, found = WORD.findall(lower(r.text)), set(), set()
        for name, grams, n in wins:
            for k in range(len(w) - n + 1):
                if grams and tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found.add(name)
        out[r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out
