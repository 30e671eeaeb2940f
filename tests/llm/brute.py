"""Plain, slow versions of what the operators return, over a small table."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(text):
    text = text or ""
    found = {"assign": [], "access": [], "hex": []}
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 12:
            found["assign"].append(m.span())
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)):
        found[kind] = [m.span() for m in re.finditer(pattern, text) if len(m[0]) >= least]
    order = ["assign", "access", "hex"]
    spans = sorted(((s, order.index(k), e) for k in order for s, e in found[k]))
    return {"n_assign": len(found["assign"]), "n_access": len(found["access"]), "n_hex": len(found["hex"]),
            "base": listed((order[k], s, e) for s, k, e in spans)}


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
            "n_repeat_words": len(covered), "base_failed": n < 20 or 100 * len(covered) > 30 * n}


def windows_removed(texts):
    """texts: {doc_id: text} -> {doc_id: (n_words, n_removed, sha of kept words)}"""
    first, out = {}, {}
    for d in sorted(texts):
        w = WORD.findall(texts[d] or "")
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i:i + 13]), d)
    for d, t in texts.items():
        w = WORD.findall(t or "")
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for j in range(i, i + 13)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts, k=5):
    """{doc_id: (n_shingles, component_id)} by the Jaccard links of all pairs that share a shingle."""
    sets = {d: shingles(t, k) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for d in sets:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    shared = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def personal(text):
    text = text or ""
    found = {"email": [m.span() for m in re.finditer(EMAIL, text)], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            found["phone"].append(m.span())
    return {**{f"n_{k}": len(v) for k, v in found.items()}, "base": listed((k, s, e) for k, v in found.items() for s, e in v)}


def word_model(texts, held):
    """texts, held: {doc_id: ...} -> (N, V, {doc_id: (n_tokens, n_known, base_score)})"""
    tokens = {d: WORD.findall((t or "").translate(LOWER)) + [None] for d, t in texts.items()}
    counts = Counter(x for d, ts in tokens.items() if not held[d] for x in ts)
    n, v = sum(counts.values()), len(counts)
    out = {d: (len(ts), sum(counts[x] > 0 for x in ts), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for d, ts in tokens.items()}
    return n, out
