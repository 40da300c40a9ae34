"""Plain Python versions of the corpus operators, for small fixtures."""

import collections
import hashlib
import math
import re
import zlib

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k, percent):
    """rows: (id, text). id -> (size, component)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        least[r] = min(least.get(r, i), i)
    return [(i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)]


def removed(rows, window):
    """rows: (id, text). (id, words, removed, sha256 of what is kept)."""
    all_words = [(i, words(t)) for i, t in rows]
    count = collections.Counter(tuple(w[j : j + window]) for _, w in all_words for j in range(len(w) - window + 1))
    out = []
    for i, w in all_words:
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def joined_sha(spans, kinds):
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(t):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", m.start(), m.end()) for m in re.finditer(pattern, t, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c)
        if i % 2:
            v = 2 * v if v < 5 else 2 * v - 9
        total += v
    return total % 10 == 0


def personal(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]


def held_out(i, mod, remainder):
    return zlib.crc32(str(i).encode()) % mod == remainder


def unigram(rows):
    """id -> (tokens, known, training tokens, score)."""
    tok = lambda t: [*words(lower(t)), None]
    count = collections.Counter(w for i, t in rows if not held_out(i, 7, 2) for w in tok(t))
    total, types = sum(count.values()), len(count)
    return {i: (len(tok(t)), sum(count[w] > 0 for w in tok(t)), total, sum(math.log10((count[w] + 1) / (total + types + 1)) for w in tok(t))) for i, t in rows}


def backoff(rows, order, discount, prior, spread):
    """rows: (id, text, held out). log10 probability of each text by pairs of words, words and spelling."""
    tok = lambda t: [*words(lower(t)), None]
    pad = b"\n" * (order - 1)
    one, two, grams = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, out in rows:
        if not out:
            ws = tok(t)
            one.update(ws)
            two.update(zip([None, *ws], ws))
            for w in ws[:-1]:
                b = pad + w.encode() + b"\n"
                grams.update(b[i - k + 1 : i + 1] for i in range(order - 1, len(b)) for k in range(1, order + 1))
    n, types = sum(one.values()), len(one)
    bytes_ = sum(c for g, c in grams.items() if len(g) == 1)
    follows = collections.defaultdict(dict)
    for g, c in grams.items():
        follows[g[:-1]][g[-1:]] = c

    def byte(context, b):
        if not context:
            return (grams[b] + 1) / (bytes_ + 256)
        seen = follows.get(context, {})
        total = sum(seen.values())
        if not total:
            return byte(context[1:], b)
        kept = {x: max(c - discount, 0) / total for x, c in seen.items()}
        return kept.get(b, 0) + (1 - sum(kept.values())) * byte(context[1:], b)

    def spelled(w):
        b = pad + w.encode() + b"\n"
        return math.prod(byte(b[i - order + 1 : i], b[i : i + 1]) for i in range(order - 1, len(b)))

    def single(w):
        if not n:
            return 0.5 * (1 if w is None else spelled(w))
        return max(one[w] - discount, 0) / n + (0 if w is None else discount * types / n * spelled(w))

    def of(t):
        ws, total = tok(t), 0.0
        for v, w in zip([None, *ws], ws):
            p = prior * (one[v] + 1) ** spread
            total += math.log10((two[v, w] + p * single(w)) / (one[v] + p))
        return total

    return [of(t) for _, t, _ in rows]


def contaminated(docs, items, k=5, least=0.8):
    """(doc, item) -> best similarity of a window as long as the item."""

    def bag(w, k):
        return collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))

    out = {}
    for d, t in docs:
        w = words(lower(t))
        for i, text in items:
            v = words(lower(text))
            if not v or not w:
                continue
            kk, n = min(k, len(v)), min(len(v), len(w))
            a = bag(v, kk)
            for s in range(len(w) - n + 1):
                b = bag(w[s : s + n], kk)
                both = sum((a & b).values())
                union = sum(a.values()) + sum(b.values()) - both
                if both and both / union >= least:
                    out[d, i] = max(out.get((d, i), 0), both / union)
    return out


def live_tokens(rows, base, max_owners, max_repos, entropy_least=3.5):
    """rows: (id, text, owner). Per row: spans beyond the base that are live, and all candidates with their verdict."""

    def entropy(s):
        return -sum(c / len(s) * math.log2(c / len(s)) for c in collections.Counter(s).values())

    found = []
    for i, t, owner in rows:
        t, mine = t or "", []
        spans = base(t)
        for k, a, b in spans:
            m = re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", t[a:b]) if k == "assign" else None
            mine.append((k, a, b, m[1] if m else t[a:b]))
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", t):
            v = m[0]
            if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and entropy(v) >= entropy_least and not any(a < m.end() and m.start() < b for _, a, b in spans):
                mine.append(("live", m.start(), m.end(), v))
        found.append((i, owner, mine))
    owners, repos = collections.defaultdict(set), collections.defaultdict(set)
    for i, owner, mine in found:
        for *_, v in mine:
            if owner is not None:
                owners[v].add(owner)
            repos[v].add(i)
    live = lambda v: len(owners[v]) <= max_owners and len(repos[v]) <= max_repos
    rank = {"assign": 0, "access": 1, "hex": 2, "live": 3}
    out = {}
    for i, _, mine in found:
        mine = sorted(mine, key=lambda x: (x[1], rank[x[0]]))
        out[i] = (
            ",".join(f"{k}:{a}:{b}" for k, a, b, v in mine if k != "live" or live(v)),
            ",".join(f"{k}:{a}:{b}:{'live' if live(v) else 'example'}" for k, a, b, v in mine),
        )
    return out


def disclosing(rows, base, support, generalise, remove, shingle=5, percent=80):
    """rows: (id, text), texts distinct. id -> spans (kind, start, end) of terms that reveal a value that base finds in the text."""
    normal = {"email": str.lower, "ip": str, "card": lambda v: re.sub("[ -]", "", v), "phone": lambda v: re.sub("[^0-9]", "", v)}
    held, terms, df = {}, {}, collections.Counter()
    for i, t in rows:
        t = t or ""
        spans = base(t)
        held[i] = {normal[k](t[a:b]) for k, a, b in spans}
        ws = [(m.start(), m.end(), lower(m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        df.update({w for *_, w in ws})
        terms[i] = [(a, b, w) for a, b, w in ws if not any(x < b and a < y for _, x, y in spans)]
    group = {i: c for (i, _), (_, _, c) in zip(rows, groups(rows, shingle, percent), strict=True)}
    of = collections.defaultdict(list)
    for i, es in held.items():
        for e in es:
            of[e].append(i)
    n, out = len(rows), collections.defaultdict(dict)
    for e, ids in of.items():
        if len({group[i] for i in ids}) < support or len(ids) >= n:
            continue
        both, proof = collections.Counter(), collections.defaultdict(set)
        for i in ids:
            for w in {w for *_, w in terms[i]}:
                both[w] += 1
                proof[w].add(group[i])
        for w, k in both.items():
            ratio = 1 - math.log2(k / df[w]) / math.log2(len(ids) / n)
            if len(proof[w]) >= support and ratio >= generalise:
                kind = "remove" if ratio >= remove else "general"
                for i in ids:
                    out[i][w] = max(out[i].get(w, ""), kind)
    return {i: sorted((out[i][w], a, b) for a, b, w in terms[i] if w in out[i]) for i, _ in rows}


def text_statistics(t):
    """The statistics of the quality classifier."""
    t = t or ""
    raw, ws = t.encode(), words(t)
    share = lambda a, b: a / b if b else 0.0
    marks = {"pipe": "|", "bang": "!", "hash": "#", "dollar": "$", "percent": "%", "and": "&", "star": "*", "stop": ".", "comma": ",", "at": "@", "less": "<", "brace": "{", "slash": "/", "under": "_", "line": "\n"}
    return {k: share(t.count(c), len(raw)) for k, c in marks.items()} | {
        "words": math.log1p(len(ws)), "word_size": share(len(raw), len(ws)), "distinct": share(len(set(ws)), len(ws)), "upper": share(sum("A" <= c <= "Z" for c in t), len(raw)),
        "digit": share(sum("0" <= c <= "9" for c in t), len(raw)), "beyond_ascii": share(len(raw) - len(t), len(raw)),
    }


def divergence(rows, least=3, top=200):
    """rows: (text, lang, source). (lang, source, part, item, value, rank)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    billion = 10**9
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t, lang, source in rows:
        terms = [lower(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (la, s), c in count.items() if la == lang}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + billion * (c[t] + 1) // total for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(some, 1) if part == "pair" or r <= top]
    return sorted(out)


def alignment(rows, tokens):
    """rows: (id, text); tokens(text) -> (ids of A, their bytes, ids of B, their bytes). (id, n_a, n_b, groups, links, best, sum, sha256)."""
    count, per = collections.Counter(), []
    for i, t in rows:
        a, a_bytes, b, b_bytes = tokens(t) if t else ([], [], [], [])
        want = f" {t}".encode()
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a = b = a_bytes = b_bytes = []
        spans = lambda bs: [(sum(map(len, bs[:k])), sum(map(len, bs[: k + 1]))) for k in range(len(bs))]
        sa, sb = spans(a_bytes), spans(b_bytes)
        links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]]
        count.update(links)
        cut = sorted({e for _, e in sa} & {e for _, e in sb})
        group = lambda ids, ss: [",".join(str(x) for x, (_, e) in zip(ids, ss, strict=True) if lo < e <= hi) for lo, hi in zip([0, *cut], cut)]
        shown = ";".join(f"{x}|{y}" for x, y in zip(group(a, sa), group(b, sb), strict=True))
        per.append((i, len(a), len(b), len(cut), links, hashlib.sha256(shown.encode()).hexdigest() if a else "", shown))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(i, n_a, n_b, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), sha) for i, n_a, n_b, g, ls, sha, _ in per]
