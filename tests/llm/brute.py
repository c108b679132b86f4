"""Plain versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secret_spans(text):
    """(start, kind, end) of the base kinds."""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(s[:3] for s in spans)


def secrets(text):
    spans = [(a, k, b, ("assign", "access", "hex")[k]) for a, k, b in secret_spans(text or "")]
    n = Counter(s[3] for s in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))


def licenses(text):
    words = LICENSE_WORD.findall(lower(text or ""))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def repeated_passages(docs, window=20):
    """docs: rows (doc_id, text), ids may be null or repeated; returns for each row (doc_id, n_words, n_removed, digest of the kept words), sorted.

    A window is repeated if it stands in a row of a smaller id (null: the largest), or before in its own row.
    """
    last = (1 << 63) - 1
    order = lambda i: last if i is None else i
    words = [WORD.findall(t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(order(i), least.get(key, last))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone, own = set(), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in own or least[key] < order(i):
                gone.update(range(k, k + window))
            own.add(key)
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


UNITS = set("kg g mg km m cm mm mi ft in lb oz l ml s sec min h hr hrs hours hour minutes days day years year % $ € £ usd eur dollars euros cents meters metres miles km/h mph".split())


def canonical(text):
    """(token, value) of each word; tokens of numbers, names and units are the same for all."""
    out, number, ended = [], False, True
    for word in (text or "").split():
        core = word
        while core and not (core[0].isalnum() or core[0] in "_$€£%+-"):
            core = core[1:]
        while core and not (core[-1].isalnum() or core[-1] in "_$€£%"):
            core = core[:-1]
        value = core[:-2] if core[-2:] in ("'s", "’s") else core
        numeric = bool(re.fullmatch(r"[+-]?[$€£]?\d[\d.,:/]*%?", core))
        if numeric:
            token = "<number>"
        elif core[:1].isupper() and not ended:
            token = "<name>"
        elif core.lower() in UNITS and number:
            token = "<unit>"
        else:
            token, value = "=" + core.lower(), None
        out.append((token, value and value.lower()))
        number, ended = numeric, word.rstrip("\"')]»”")[-1:] in tuple(".!?:")
    return out


def cover_of(text, item, window=8, least=4):
    """The share of the item's windows that stand in the text with values that agree, by trying every alignment."""
    ours, theirs = canonical(text), canonical(item)
    size = min(window, len(theirs))
    if not size:
        return 0.0
    found = set()
    for shift in range(-len(theirs), len(ours)):
        hits = [p for p in range(len(theirs) - size + 1) if 0 <= p + shift <= len(ours) - size and [t for t, _ in theirs[p : p + size]] == [t for t, _ in ours[p + shift : p + shift + size]]]
        meets = {}
        for k in {k for p in hits for k in range(p, p + size) if theirs[k][1] is not None}:
            meets.setdefault(theirs[k][1], []).append(ours[k + shift][1])
        stands = {a: min(set(bs), key=lambda b: (-bs.count(b), b != a, b)) for a, bs in meets.items()}
        for p in hits:
            pairs = [(theirs[k][1], ours[k + shift][1]) for k in range(p, p + size) if theirs[k][1] is not None]
            if all(a == b or (size >= least and stands[a] == b) for a, b in pairs):
                found.add(p)
    return len(found) / (len(theirs) - size + 1)


def similar_groups(docs, shingle=5, similarity=0.8):
    """For each row (doc_id, text) the number of its group: rows whose sets of shingles are similar, and what they lead to."""
    sets = []
    for _, t in docs:
        w = WORD.findall(lower(t or ""))
        sets.append({" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))})
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links = set()
    for k, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < k)
        links |= {(j, k) for j, n in shared.items() if n >= similarity * (len(s) + len(sets[j]) - n)}
    roots = components(range(len(docs)), links)
    return [roots[k] for k in range(len(docs))]


def license_cover(words, template, counts, least=4, gap=48):
    """The most counting runs (by their starts in the template) that a chain of matches covers: every maximal match, every chain."""
    found = []
    for d in range(len(words)):
        for t in range(len(template)):
            if words[d] == template[t] and (d == 0 or t == 0 or words[d - 1] != template[t - 1]):
                n = 0
                while d + n < len(words) and t + n < len(template) and words[d + n] == template[t + n]:
                    n += 1
                if n >= least:
                    found.append((d, t, n))
    found.sort()
    best = []
    for d, t, n in found:
        runs = range(n - least + 1)
        now = sum(counts[t + k] for k in runs)
        for (dj, tj, nj), b in zip(found, best, strict=False):
            fresh = [k for k in runs if d + k > dj + nj - least and t + k > tj + nj - least]
            if tj < t and fresh and d - dj - nj <= gap:
                now = max(now, b + sum(counts[t + k] for k in fresh))
        best.append(now)
    return max(best, default=0)


def label_model(counts, names, beliefs, pinned, rounds=200, trust=0.3):
    """Expectation-maximisation over patterns of votes, digit by digit."""
    digits = {p: [p // 3**j % 3 for j in range(len(names))] for p in counts}
    total = sum(counts.values())
    prior_rates = [[list(beliefs.get(n, beliefs[""])[y]) for n in names] for y in (0, 1)]
    good = {p: (0.95, 0.2, 0.05)[min(2, d.count(0))] for p, d in digits.items()}
    for _ in range(rounds):
        rates = []
        for y in (0, 1):
            rates.append([])
            for j, name in enumerate(names):
                row = [prior_rates[y][j][v] * trust * total for v in range(3)]
                for p, d in digits.items():
                    row[d[j]] += counts[p] * (good[p] if y else 1 - good[p])
                rates[y].append(prior_rates[y][j] if name in pinned else [x / sum(row) for x in row])
        prior = min(0.95, max(0.05, sum(counts[p] * good[p] for p in counts) / total))
        new = {}
        for p, d in digits.items():
            bad_odds, good_odds = 1 - prior, prior
            for j, v in enumerate(d):
                bad_odds, good_odds = bad_odds * rates[0][j][v], good_odds * rates[1][j][v]
            new[p] = good_odds / (good_odds + bad_odds)
        done = max(abs(new[p] - good[p]) for p in counts) < 1e-6
        good = new
        if done:
            break
    return good, rates
