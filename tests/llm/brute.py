"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return ALNUM.findall((text or "").translate(UPPER))


def spaced(text):
    return SPACED.findall((text or "").translate(UPPER))


def exact(rows):
    """(doc_id, text) -> the rows of op8, for distinct ids."""
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids)


def simhash(text, size=4):
    ws = spaced(text)
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def hamming_components(fps, most=4):
    """fingerprint -> root, over all pairs of distinct fingerprints."""
    u = np.unique(np.array(list(fps), np.uint64))
    sets = Sets()
    for i, f in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ f) <= most):
            sets.join(i, i + 1 + int(j))
    return {int(f): sets.find(i) for i, f in enumerate(u)}


def near(rows, size=4, most=4):
    """(doc_id, text) -> the rows of op3."""
    fps = [(i, simhash(t, size)) for i, t in rows]
    root = hamming_components([f for _, f in fps], most)
    least = {}
    for i, f in fps:
        least[root[f]] = min(i, least.get(root[f], i))
    return sorted((i, f"{f:016x}", least[root[f]]) for i, f in fps)


def windows(items):
    """window -> item ids."""
    found = defaultdict(set)
    for item, text in items:
        ws = alnum(text)
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            found[tuple(ws[i:i + n])].add(str(item))
    return found


def decontaminated(rows, items):
    """(doc_id, text) and (item_id, text) -> the rows of op7."""
    wins = windows(items)
    lengths = sorted({len(w) for w in wins})
    out = []
    for i, t in rows:
        ws, hit, ids = alnum(t), set(), set()
        for n in lengths:
            for at in range(len(ws) - n + 1):
                if own := wins.get(tuple(ws[at:at + n])):
                    hit |= set(range(at, at + n))
                    ids |= own
        out.append((i, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(ws)))
    return sorted(out)


def warc(rows):
    """(page_id, html) -> the rows of op1, for distinct ids."""
    import base64

    first = {}
    for i, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        least = first[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == least else "revisit", None if i == least else least))
    return sorted(out, key=lambda r: r[0])


def licenses(rows, phrases, templates, least):
    """(doc_id, text) -> the rows of op4."""
    sets = [(label, set(alnum(t))) for label, t in templates]
    out = []
    for i, t in rows:
        ws, starts, base = alnum(t), [], set()
        for p, label in phrases.items():
            p = p.split()
            at = [k for k in range(len(ws)) if ws[k:k + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        best, labels = 0.0, set(base)
        for line in re.split(r"[\r\n]", t or ""):
            ws_ = set(alnum(line))
            found = [(label, s) for label, s in sets if len(s & ws_) / len(s) >= least - 1e-9]
            best = max([best, *(len(s & ws_) / len(s) for _, s in found)])
            labels |= {label for label, s in found if not any(s < s2 for _, s2 in found)}
        out.append((i, len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best))
    return sorted(out, key=lambda r: r[0])


def unigrams(rows):
    """(doc_id, text) -> held_out, n_tokens, n_known, train_tokens, base_score by id."""
    import math
    import zlib
    from collections import Counter

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not held[i]:
            counts.update([*spaced(t), ""])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        ws = [*spaced(t), ""]
        out[i] = (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    return out


def runs(words, least=12):
    """(start, length, period) of the maximal stretches with a period, by comparing all words."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            at = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > at and i - at + q >= max(least, 2 * q):
                found.setdefault((at, i + q), q)  # a smaller period was found before
            i += i == at
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rows):
    """(doc_id, text) -> the rows of op13."""
    out = []
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i if i is not None else "").encode()), len(ws)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            ws = [ws[j] if j < a else ws[a + (j - a) % p] for j in range(n)]
        found = runs(ws)
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def nearest(vectors, k):
    """(id, vector) -> (query_id, rank, vec_id, score) of the ids divisible by 20, by comparing all."""
    use = [(i, np.array(v, float)) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    out = []
    for q, v in use:
        if q is not None and q % 20 == 0:
            found = sorted((-(w * v).sum(), i is None, i) for i, w in use if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, _, i) in enumerate(found, 1)]
    return out


EDITS = {"K": 0, "R": 1, "D": 2, "I": 5}


def _options(initial, must_go, cut):
    """(letter, cost, initial of the result) of each edit of one turn."""
    yield "D", 2, ""
    if not must_go:
        yield "K", 5 * cut, initial
        yield "R", 1 + 5 * cut, "u"
        yield "R", 1 + 5 * cut, "a"


def every_repair(turns):
    """(cost, audit, roles) of the best repair, by trying all edits with up to two insertions at each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    def walk(at, cost, audit, roles):  # noqa: E306
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for extra in gaps:
            c, a, r = cost + 5 * len(extra), audit + "I" * len(extra), roles + extra
            if at == len(turns):
                if re.fullmatch(r"(s?(ua)+)?", r) and (best is None or (c, a) < best[:2]):
                    best = (c, a, r)
            else:
                for letter, more, initial in _options(*turns[at]):
                    if initial in ("", "s", "u", "a"):
                        walk(at + 1, c + more, a + letter, r + initial)
    walk(0, 0, "", "")
    return best


def cheapest_repair(turns):
    """The same by following the places of the pattern from left to right."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    def inserted(now):  # noqa: E306
        for _ in range(3):
            for (p, who), q in step.items():
                if who != "s" and p in now:
                    c, a, r = now[p]
                    made = (c + 5, a + "I", r + [(who, None)])
                    if q not in now or made[:2] < now[q][:2]:
                        now[q] = made
        return now
    now = inserted({0: (0, "", [])})
    for j, (initial, must_go, cut) in enumerate(turns):
        new = {}
        for p, (c, a, r) in now.items():
            for letter, more, who in _options(initial, must_go, cut):
                q = p if letter == "D" else step.get((p, who))
                if q is not None:
                    made = (c + more, a + letter, r + ([(who, j if letter == "K" else (j,))] if letter != "D" else []))
                    if q not in new or made[:2] < new[q][:2]:
                        new[q] = made
        now = inserted(new)
    return min((now[q] for q in (0, 3) if q in now), key=lambda x: x[:2])


def conversations(rows):
    """(conv_id, turn, role, text) -> the rows of op11."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(told).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0], t[1].encode(), t[2].encode()) if t[0] is not None else (False, 0, t[1].encode(), t[2].encode()))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            faults.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, result = cheapest_repair(faults)
        lines = []
        for who, at in result:
            name = {"u": "user", "a": "assistant"}.get(who)
            if at is None:
                lines.append(f"{name}:")
            elif isinstance(at, tuple):
                lines.append(f"{name}:{turns[at[0]][2]}")
            else:
                lines.append(f"{turns[at][1]}:{turns[at][2]}")
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def clause_kinds(text, lexicon, rules):
    """Weights of matches by kind, each clause read word by word and then judged."""
    found, threat = dict.fromkeys(rules.PATTERNS, 0.0), sorted(lexicon.values())[len(lexicon) // 2]
    for clause in re.split(r"[.!?;\n]", text.translate(UPPER)):
        parts = [re.findall(r"[0-9a-z\x80-\U0010ffff]+(?:'[a-z]+)?", part) for part in re.split("[,:]", clause)]
        everything = [w for part in parts for w in part if w not in lexicon]
        told = any(w in rules.REPORTED for w in everything)
        aimed = any(w in rules.TARGET or w in rules.OBJECT for w in everything)
        for part in parts:
            matches, intent, done = [], None, -1  # (place of the last word, insult?, weight, named?)
            for i, w in enumerate(part):
                before = part[i - 1] if i else ""
                verb, thing = w in rules.THREAT, w in rules.TARGET or w in rules.OBJECT
                if w in lexicon:
                    matches.append((i, True, lexicon[w], before in rules.MENTION))
                elif w in rules.INTENT:
                    intent = i
                elif w in rules.PROMISE or verb and intent is not None and i - intent <= 3 or verb and before in rules.OBJECT and done != i - 1 or thing and before in rules.THREAT and done != i - 1:
                    matches.append((i, False, threat, False))
                    intent, done = None, i
            negated, until = set(), -1
            for i, w in enumerate(part):
                if w in rules.NEGATION and w not in lexicon:
                    until = -1 if i <= until else i + 3
                if i <= until:
                    negated.add(i)
            back = bool(part) and part[-1] in rules.NEGATION and len(part) - 1 in negated
            for i, is_insult, weight, named in matches:
                kind = "insult" if is_insult else "threat"
                if told or named:
                    kind = "reported " + kind
                elif i in negated or back:
                    kind = "negated " + kind
                elif aimed:
                    kind += " at target"
                found[kind] += weight
    return list(found.values())
