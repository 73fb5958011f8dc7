"""Plain single-machine versions of the operators, for small tables."""

from __future__ import annotations

import hashlib


def repeats(docs, length=50):
    """{row index: (n_bytes, spans, kept)} for (doc_id, text) rows."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for doc_id, raw in texts:
        if doc_id is not None:
            for p in range(len(raw) - length + 1):
                w = raw[p:p + length]
                if w not in first or first[w] > doc_id:
                    first[w] = doc_id
    out = []
    for doc_id, raw in texts:
        gone = bytearray(len(raw))
        if doc_id is not None:
            for p in range(len(raw) - length + 1):
                if first[raw[p:p + length]] < doc_id:
                    gone[p:p + length] = b"\x01" * length
        spans, at = [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


import re  # noqa: E402

PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    """Base spans (kind, start, end) of one text."""
    out = []
    for kind, pattern in PII:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def shingles(text, width=5):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def near_copies(docs):
    """(doc_id, n_shingles, component_id) of every (doc_id, text) row, by comparing all that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    where = {}
    for i, s in enumerate(sets):
        if docs[i][0] is not None:
            for g in s:
                where.setdefault(g, []).append(i)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        if docs[i][0] is None:
            continue
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(docs)]


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def contaminated(docs, items, width=13, share=20):
    """(doc_id, n_words, n_hit, sorted item ids, contaminated) of every document."""
    windows = {}
    for item, text in items:
        w = re.findall(WORD, low(text))
        for i in range(max(len(w) - width + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = re.findall(WORD, low(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                items_of = windows.get(tuple(w[i:i + n]))
                if items_of is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in items_of if x is not None}
        out.append((doc_id, len(w), len(hit), sorted(found), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


SECRET = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
          ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32))


def secret(text):
    out = []
    for rank, (kind, pattern, least) in enumerate(SECRET):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def pieces(word, vocabulary):
    """Greedy longest-match pieces of a byte string."""
    n = at = 0
    while at < len(word):
        end = len(word)
        while word[at:end] not in vocabulary:
            end -= 1
        at, n = end, n + 1
    return n
