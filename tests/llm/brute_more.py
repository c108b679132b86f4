"""Plain versions of the contracts of operators 11 to 13, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

from .brute import LICENSE_WORD, WORD, lower


def features(text, ngrams):
    words = LICENSE_WORD.findall(lower(text or ""))
    return [" ".join(words[k : k + n]) for n in range(1, ngrams + 1) for k in range(len(words) - n + 1)]


def importance(docs, target, percent=10, least=20, buckets=10_000, ngrams=1, seed=2024):
    """{row: (n_features, weight, score)} and the ids in order of rank."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s = Counter(bucket(x) for _, text in docs for x in features(text, ngrams))
    t = Counter(bucket(x) for text in target for x in features(text, ngrams))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        found = [gain(bucket(x)) for x in features(text, ngrams)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    return rows, fit[: len(fit) * percent // 100]


def thinned_words(docs, modulus=97, shortest=5, least=3):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def near(a, b):
    """Whether some single edit of a gives b, by trying all places."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts, ratio=2):
    """{word: (form, root, n, n_near, form_n)}."""
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(found[w]), form[w] and counts[form[w]])
    return out


def unigrams(docs):
    """{row number: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    tokens = [[*WORD.findall(lower(text or "")), None] for _, text in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    counts = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    n, v = counts.total(), len(counts)
    return [(h, len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for ts, h in zip(tokens, held, strict=True)]
