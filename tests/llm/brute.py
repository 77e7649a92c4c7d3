"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def op1(docs, items, window=10):
    owners, sizes = defaultdict(set), set()
    for item, text in items:
        w = alnum(text)
        if item is None or not w:
            continue
        n = min(window, len(w))
        sizes.add(n)
        for i in range(len(w) - n + 1):
            owners[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := owners.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def op3(docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = []
    for doc, text in docs:
        w = alnum(text)
        at = [(i, p) for p in phrases for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]
        out.append((doc, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({phrases[p] for _, p in at}))))
    return out


def op7(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        w = spaced(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if spaced(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        bad = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), bad))
    return out


def op8(pages):
    rows = [(p, (h or "").encode()) for p, h in pages]
    least = {}
    for p, h in rows:
        least[h] = min(p, least.get(h, p))
    return [(p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if least[h] == p else "revisit", None if least[h] == p else least[h]) for p, h in rows]


def op9(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def shingles(text, k):
    w = spaced(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(sets, percent):
    """sets: id -> set. id -> smallest linked id, over all pairs."""
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    shared = Counter((a, b) for own in where.values() for x, a in enumerate(own) for b in own[x + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def crc32_of(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def op2(docs, labels, frame):
    """doc -> score of the machine that is fitted on the sample, every pair of terms taken one by one."""
    import math

    from nearfield.llm import toxicity

    rows, y = toxicity.training_rows(frame, labels, id_col="doc_id", text_col="text", label_col="toxic", folds=5, max_train=12_000, bits=18)
    m, out = toxicity.fit_several(rows, y, bits=18), {}
    for doc, text in docs:
        forms = set()
        for w in alnum(text):
            forms |= {"w" + w} | {"p" + w[:n] for n in (4, 5) if len(w) > n}
        terms = sorted({zlib.crc32(f.encode()) % 2**18 for f in forms})
        terms = [t for t in terms if m.picked[t]]
        total = m.bias + sum(float(m.w[t]) for t in terms)
        total += sum(float((m.v[a].astype(float) * m.v[b]).sum()) for i, a in enumerate(terms) for b in terms[i + 1 :])
        out[doc] = 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
    return out


def padding(lengths, n_buckets):
    """The least padding that n_buckets boundaries can leave, over all places of each boundary."""
    sizes = sorted(set(lengths))
    count = Counter(lengths)
    docs, tokens = [0], [0]
    for n in sizes:
        docs.append(docs[-1] + count[n])
        tokens.append(tokens[-1] + n * count[n])
    best = [0] + [None] * len(sizes)
    for _ in range(min(n_buckets, len(sizes))):
        best = [None if j == 0 else min((best[i] + sizes[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i]) for i in range(j) if best[i] is not None), default=None) for j in range(len(sizes) + 1)]
    return best[-1]
