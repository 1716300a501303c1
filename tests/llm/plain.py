"""Plain versions of the corpus operators' results, one document at a time."""

import hashlib
import collections
import math
import re
import unicodedata

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def shingle_set(text, k=4):
    w = spaced(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(docs, percent=85, k=4):
    """{row number: (size, smallest id of its component, whether it is kept)} of (doc_id, text) rows."""
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = {}
    for i, (doc_id, _) in enumerate(docs):
        mine = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None] if sets[i] else []
        out[i] = (len(sets[i]), min(mine) if mine else doc_id)
    return out


def contaminated(docs, items, window=10):
    """[(n_words, n_hit, names)] for each text."""
    phrases = []
    for item, text in items:
        w = alnum(text)
        if item is None or not w:
            continue
        phrases += [(str(item), w[i : i + window]) for i in range(len(w) - window + 1)] or [(str(item), w)]
    out = []
    for text in docs:
        w = alnum(text)
        hit, names = set(), set()
        for name, p in phrases:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    names.add(name)
        out.append((len(w), len(hit), sorted(names)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TOKEN = r"(?<![A-Za-z0-9._@/+-])(?=[A-Za-z._@/+-]*[0-9])[A-Za-z0-9._@/+-]{5,}"


def ends_word(c):
    return unicodedata.category(c)[0] in "PS" and c not in "._@/+%-"


def units(text):
    """Words that end at white space, or after punctuation that something else follows."""
    out, now = [], ""
    for c in text:
        if c in " \t\n\x0b\f\r":
            out, now = [*out, now], ""
        else:
            if now and ends_word(now[-1]) and not ends_word(c):
                out, now = [*out, now], ""
            now += c
    return [u.lower() for u in [*out, now] if u]


def identifiers(texts, least_known=3, least_pattern=0.5, least_instance=0.8):
    """(kind, start, end) of each text, base spans and then those of instances that the bootstrap accepts."""
    edges, total, where, bases = collections.Counter(), collections.Counter(), [], []
    seeds = set()
    for t in texts:
        base = pii(t)
        bases.append(base)
        words = units(t)
        total.update(words)
        total.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        own = []
        for kind, p in [*PII.items(), ("token", TOKEN)]:
            found = [m.span() for m in re.finditer(p, t)]
            for k, (lo, hi) in enumerate(found):
                before, behind = t[found[k - 1][1] if k else 0 : lo], t[hi : found[k + 1][0] if k + 1 < len(found) else len(t)]
                instance = t[lo:hi]
                if kind == "token":
                    instance = instance.rstrip("._-/+")
                    if len(instance) < 5 or any(lo < e and s < lo + len(instance) for _, s, e in base):
                        continue
                    own.append((instance, lo, lo + len(instance)))
                elif (kind, lo, hi) not in base:
                    continue
                a, b = units(before), units(behind.lstrip("".join({" ", "\t", "\n", *(c for c in behind if ends_word(c))})))
                patterns = ["<" + " ".join(a[-n:]) for n in (1, 2) if len(a) >= n] + [">" + " ".join(b[:n]) for n in (1, 2) if len(b) >= n]
                for x in patterns:
                    edges[x, instance] += 1
                    if kind != "token":
                        seeds.add((x, instance))
        where.append(own)
    graph = collections.defaultdict(dict)
    for (x, instance), n in edges.items():
        if total[x[1:]]:
            graph[x][instance] = n
    known, accepted = set(seeds), set()
    while True:
        doubt = collections.defaultdict(lambda: 1.0)
        for x, instances in graph.items():
            hits = [n for i, n in instances.items() if (x, i) in known]
            p = min(1.0, sum(hits) / total[x[1:]])
            if len(hits) >= least_known and p >= least_pattern:
                for i in instances:
                    if (x, i) not in known:
                        doubt[i] *= max(1 - p, 1e-6)
        new = {i for i, d in doubt.items() if 1 - d >= least_instance}
        if not new:
            return [base + sorted(("id", lo, hi) for i, lo, hi in own if i in accepted) for base, own in zip(bases, where, strict=True)]
        accepted |= new
        known |= {(x, i) for x, instances in graph.items() for i in instances if i in new}


NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"


def secrets(text):
    text, out = text or "", []
    out += [("assign", *m.span()) for m in re.finditer(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def repeated(docs, length=50):
    """{row number: word places that lie in a stretch of `length` words which another row shares}."""
    where = {}
    for i, (_, text) in enumerate(docs):
        w = spaced(text)
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), []).append((i, k))
    out = {}
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                out.setdefault(i, set()).update(range(k, k + length))
    return out


def trigrams(text, bits=16):
    """[(bucket, whether the byte is of a letter)] of each byte of a text."""
    raw, b = text.encode(), []
    for k, c in enumerate(raw):
        if 65 <= c <= 90:
            c += 32
        elif not (97 <= c <= 122 or c >= 128):
            c = 32
        elif k and raw[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
            c += 32
        b.append(c)
    at = lambda k: b[k] if 0 <= k < len(b) else 32
    return [((((at(k - 1) << 16 | c << 8 | at(k + 1)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits), c != 32) for k, c in enumerate(b)]


def em(lik, weight, share, rounds):
    total = max(sum(weight), 1e-9)
    for _ in range(rounds):
        new = [0.0] * len(share)
        for row, w in zip(lik, weight, strict=True):
            r = [x * s for x, s in zip(row, share, strict=True)]
            z = max(sum(r), 1e-300)
            for k, x in enumerate(r):
                new[k] += w * x / z
        share = [x / total for x in new]
    return share, sum(math.log(max(sum(x * s for x, s in zip(row, share, strict=True)), 1e-300)) for row in lik)


def language_shares(text, log_p, segment, penalty, temper, rounds):
    """Shares of the languages of one text by the mixture with the best penalised likelihood; log_p[language][bucket]."""
    grams, k = trigrams(text), len(log_p)
    parts = [grams[i : i + segment] for i in range(0, len(grams), segment)]
    weight = [float(sum(letter for _, letter in p)) for p in parts]
    score = [[temper * sum(float(row[g]) for g, letter in p if letter) for row in log_p] for p in parts]
    tops = [max(s) for s in score]
    lik = [[math.exp(x - t) for x in s] for s, t in zip(score, tops, strict=True)]
    share, _ = em(lik, weight, [1 / k] * k, rounds)
    single = [sum(s[j] - t for s, t in zip(score, tops, strict=True)) for j in range(k)]
    best = max(range(k), key=lambda j: single[j])
    value, out = single[best], [float(j == best) for j in range(k)]
    inside = set(range(k))
    for size in range(k, 1, -1):
        start = [share[j] + 1e-6 if j in inside else 0.0 for j in range(k)]
        share, likelihood = em(lik, weight, [x / sum(start) for x in start], max(2, rounds // 2))
        likelihood -= penalty * (size - 1) * math.log(max(len(parts), 2))
        if likelihood > value:
            value, out = likelihood, share
        inside.discard(min(inside, key=lambda j: (share[j], -j)))
    return out


def boosted(x, y, cuts, trees, depth, rate, ridge, least):
    """Scores of the rows x by boosted trees on the given cuts of each feature, grown one node at a time."""
    mean = sum(y) / len(y)
    margin = [math.log(mean / (1 - mean))] * len(x)

    def grow(rows, g, h, level):
        G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                for t in c:
                    left = [i for i in rows if x[i][j] <= t]
                    if least <= len(left) <= len(rows) - least:
                        a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = a * a / (b + ridge) + (G - a) ** 2 / (H - b + ridge) - G * G / (H + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, j, t)
        if best[1] is None:
            for i in rows:
                margin[i] += -rate * G / (H + ridge)
            return
        _, j, t = best
        grow([i for i in rows if x[i][j] <= t], g, h, level + 1)
        grow([i for i in rows if x[i][j] > t], g, h, level + 1)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grow(list(range(len(x))), [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], 0)
    return [1 / (1 + math.exp(-m)) for m in margin]


def fewest_bins(sizes, capacity):
    """The least number of bins, by exhaustive search."""
    best = len(sizes)
    order = sorted(sizes, reverse=True)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(order):
            best = len(free)
            return
        for i in {f: i for i, f in enumerate(free)}.values():
            if free[i] >= order[k]:
                place(k + 1, free[:i] + [free[i] - order[k]] + free[i + 1 :])
        place(k + 1, [*free, capacity - order[k]])

    place(0, [])
    return best
