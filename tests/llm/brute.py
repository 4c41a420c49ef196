"""Plain versions of the operators over Python rows."""
import re

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def substring(rows, width):
    """[(doc_id, n_words, n_removed, kept)] for (doc_id, text) rows."""
    words = [(i, BLANK.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=3):
    w = BLANK.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def jaccard(rows, width=3, percent=90):
    sets = [(i, shingles(t, width)) for i, t in rows]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            o = len(a & b)
            if None not in (i, j) and a and b and 100 * o >= percent * (len(a) + len(b) - o):
                links.append((i, j))
    found = components({i for i, _ in sets if i is not None}, links)
    return [(i, len(s), found.get(i)) for i, s in sets]


def contamination(rows, items, width=13):
    """[(doc_id, n_words, n_hit, items)]."""
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(item)
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got is not None:
                    found |= {str(x) for x in got if x is not None}
                    hit[k:k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(found)))
    return out


SECRETS = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
           ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))


def secrets(text):
    """[(start, rank, end, kind)] in order."""
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def redacted(text, mask="[SECRET]"):
    merged = []
    for a, _, b, _ in secrets(text):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out.append(text[at:a])
        at = b
    return mask.join([*out, text[at:]])
