"""Plain versions of the operators, for small inputs."""

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict

WHITE = " \t\n\x0b\x0c\r"


def base_metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            duplicates += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered)


def longest_increasing(values):
    """By the definition: the lengths of the longest runs that end at each place; of equal choices the one with least values."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        before.append(at[k - 1] if k else None)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else None
    while i is not None:
        out.append(i)
        i = before[i]
    return out[::-1]


def _blocks(lines, min_words):
    """{(passage of at least min_words words, occurrence): (first, last)} for the bare lines of a text: the shortest from and to each line."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    spans = set()
    for i in range(len(lines)):
        j = next((j for j in range(i, len(lines)) if sum(size[i : j + 1]) >= min_words), None)
        k = next((k for k in range(i, -1, -1) if sum(size[k : i + 1]) >= min_words), None)
        spans |= {(i, j)} if j is not None else set()
        spans |= {(k, i)} if k is not None else set()
    seen, out = Counter(), {}
    for i, j in sorted(spans):
        passage = tuple(lines[i : j + 1])
        out[passage, seen[passage]] = i, j
        seen[passage] += 1
    return out


def line_bounds(rows, min_words=5):
    """rows: (id, text), ids distinct. For each id: its bare lines, the places that must go, and those that may go.

    A line may go if an earlier document has a passage with it. It must go if the alignment with one of the earlier
    documents, each by all that the two share, takes it.
    """
    bare, out, earlier, holders = {}, {}, [], defaultdict(list)
    for ident, text in sorted(rows, key=lambda r: r[0]):
        bare[ident] = [x.strip(WHITE) for x in (text or "").split("\n") if x.strip(WHITE)]
        own = _blocks(bare[ident], min_words)
        must, may, partners = set(), set(), set()
        for passage, (i, j) in own.items():
            if holders[passage]:
                may |= set(range(i, j + 1))
                partners |= set(holders[passage])
        for p in partners:
            theirs = earlier[p]
            common = sorted((i, j, theirs[k][0]) for k, (i, j) in own.items() if k in theirs)
            for at in longest_increasing([(t, j - i) for i, j, t in common]):
                must |= set(range(common[at][0], common[at][1] + 1))
        for passage in own:
            holders[passage].append(len(earlier))
        earlier.append(own)
        out[ident] = bare[ident], must, may
    return out


def shingle_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_classes(rows, settings):
    """rows: (id, text). {id: smallest id of its class}, from all pairs: classes of the Jaccard similarity of shingle counts."""
    sets = {i: shingle_counts(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    size = {i: sum(s.values()) for i, s in sets.items()}
    for a in ids:
        for b in ids:
            if a < b and min(size[a], size[b]) >= settings.threshold * max(size[a], size[b]):
                low = (sets[a] & sets[b]).total()
                high = size[a] + size[b] - low
                if not high or low / high >= settings.threshold:
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {i: find(i) for i in ids}


def poisson_counts(rows, seed=17, temperature=0.5):
    """rows: (id, source). The number of replicas of each row."""
    sizes = Counter(s or "" for _, s in rows)
    total = sum(n**temperature for n in sizes.values())
    out = []
    for ident, source in rows:
        n = sizes[source or ""]
        rate = len(rows) * n**temperature / total / n
        u = int(hashlib.md5(f"{seed}:{ident}:1".encode()).hexdigest()[:12], 16) / 2**48
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out.append(k)
    return out


def unigram(word, scores):
    """(score, tokens) of the best segmentation of a pre-token's bytes."""
    best = [(0, 0)]
    for i in range(1, len(word) + 1):
        best.append(max((best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores))
    return best[-1][0], -best[-1][1]


def segment(word, scores):
    """The pieces of the best segmentation: highest score, then fewest tokens, then the shortest last piece at each place."""
    best = [(0, 0, 0)]
    for i in range(1, len(word) + 1):
        best.append(max((best[j][0] + scores[word[j:i]], best[j][1] - 1, j - i) for j in range(i) if word[j:i] in scores))
    out, i = [], len(word)
    while i:
        out.append(word[i + best[i][2] : i])
        i += best[i][2]
    return out[::-1]


def _histograms(text, classes, common):
    text = text or ""
    kinds = {"newline": "\n", "space": " \t\x0b\x0c\r", "stop": ".,;:", "quote": "'\"()-", "symbol": "#*$%&|<>", "exclaim": "!?"}

    def kind(ch):
        for name, members in kinds.items():
            if ch in members:
                return name
        first = ch.encode()[0]
        if first >= 0x80:
            return "accented" if first in (0xC2, 0xC3) else "wide" if first < 0xF8 else "other"
        return "lower" if ch.islower() else "upper" if ch.isupper() else "digit" if ch.isdigit() else "other"

    a, words = Counter(map(kind, text)), re.findall(r"[^\x20\x09-\x0D]+", text)
    b = Counter(w if w in common else None for w in words)
    return [a[c] for c in classes], [b[w] for w in [*common, None]], len(words)


def _divergence(counts, reference):
    """Jensen-Shannon distance of two histograms, in bits."""
    if not sum(counts):
        return 1.0
    p, q = ([x / sum(h) for x in h] for h in (counts, reference))
    total = sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x) + sum(y * math.log2(2 * y / (x + y)) for x, y in zip(p, q) if y)
    return math.sqrt(min(1, max(0, total / 2)))


def quality_verdicts(rows, rules, draft, classes, common):
    """rows: (id, text, lang). {id: (kept, class distance, word distance)}: references of each language, drafted and then made of what the draft keeps."""
    made = {i: _histograms(t, classes, common) for i, t, _ in rows}

    def references(kept):
        sums = {}
        for i, _, lang in rows:
            s = sums.setdefault(lang or "", [[0] * len(classes), [0] * (len(common) + 1), 0])
            if i in kept:
                for part, own in zip(s, made[i]):
                    if isinstance(part, list):
                        part[:] = map(sum, zip(part, own))
                s[2] += made[i][2]
        every, most = sum(s[2] for s in sums.values()), max(s[2] for s in sums.values())
        shared = [s for s in sums.values() if s[2] >= rules.min_share * every or s[2] == most]
        own = {lang: s if s[2] >= rules.lang_words else None for lang, s in sums.items() if s not in shared}
        return shared, own

    def judge(r, shared, own):
        out = {}
        for i, text, lang in rows:
            a, b, n = made[i]
            near = [*shared, *([own[lang or ""]] if own.get(lang or "") else [])]
            x, y = min(_divergence(a, s[0]) for s in near), min(_divergence(b, s[1]) for s in near)
            far = x > r.class_base + r.class_per_word / max(1, n) or y > r.word_base + r.word_per_word / max(1, n)
            metrics = base_metrics(text)
            failed = n < r.min_words or 100 * metrics[4] > r.max_repeat_percent * n
            decides = n >= r.guard_words and not ((lang or "") in own and not own[lang or ""])
            out[i] = not failed and not (far and decides), x, y
        return out

    first = judge(draft, *references({i for i, _, _ in rows}))
    return judge(rules, *references({i for i, v in first.items() if v[0]}))


def differencing(sizes, shards):
    """The loads, rising, of Karmarkar-Karp differencing: the two partial partitions of the largest spread are combined, oppositely ordered."""
    parts = [[0] * (shards - 1) + [s] for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted(x + y for x, y in zip(a, reversed(b))))
    return parts[0]
