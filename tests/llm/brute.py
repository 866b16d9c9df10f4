"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates(rows):
    """{doc_id: (n_shingles, component)} of (doc_id, text) with distinct ids."""
    sets = {}
    for i, text in rows:
        w = words(lower_ascii(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    common = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(rows, length):
    """[(n_bytes, n_removed, n_spans, sha256)] of each (doc_id, text)."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    w = words(text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []

    def scan(kind, pattern, good):
        for m in re.finditer(pattern, text):
            if good(m[0]):
                out.append((m.start(), ("email", "ip", "card", "phone").index(kind), m.end(), kind))

    def digits(x):
        return re.sub("[^0-9]", "", x)

    scan("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True)
    scan("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split(".")))
    scan("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and _luhn(digits(x)))
    scan("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15)
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def shared_words(texts, length):
    """Words of each text in sequences of ``length`` words that another text holds too."""
    each = [words(t) for t in texts]
    held = [{tuple(w[k : k + length]) for k in range(len(w) - length + 1)} for w in each]
    seen = Counter(s for h in held for s in h)
    out = []
    for w in each:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append(sum(gone))
    return out
