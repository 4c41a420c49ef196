"""Periodic runs against brute force."""
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from patchrank.llm import periodic
from patchrank.llm import text as T

from .brute import BLANK


def brute_runs(w):
    """All (start, length, period): for each period the maximal stretches, kept if no smaller period holds for the whole stretch."""
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc, text):
    w = BLANK.findall(text or "")
    if doc is None or not w:
        return w
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute(doc, text):
    w = looped(doc, text)
    runs = brute_runs(w)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def some_words(rng, n):
    """Words with periodic stretches of all kinds, also nested and adjacent ones."""
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3:
            out += [f"r{rng.randrange(50)}" for _ in range(rng.randint(1, 30))]
        elif kind < 0.5:
            out += rng.choices("ab", k=rng.randint(1, 12))
        else:
            unit = rng.choices("abc" if rng.random() < 0.5 else [f"u{k}" for k in range(40)], k=rng.randint(1, 25))
            if rng.random() < 0.3:
                unit = unit * 2 + unit[:1]
            out += (unit * 12)[:rng.randint(2, 8 * len(unit))]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    w = some_words(rng, rng.randint(1, 260))
    assert periodic.runs_in(w, len(w)) == brute_runs(w)
    texts = [" ".join(w), None, "", " ".join(some_words(rng, 90)), " \t", " ".join(some_words(rng, 300))]
    got = periodic.runs_of(T.Words(*T.utf8(pa.array(texts)), T.BLANK))
    assert got == [brute_runs(BLANK.findall(t or "")) for t in texts]


def test_segments_are_last_occurrences():
    """Every segment of an access is the previous end of its suffixes, up to the longest."""
    rng = random.Random(7)
    w = rng.choices("abc", k=120)
    a = periodic.Automaton()
    for i in range(len(w)):
        met = a.append(w[i])
        for k, (j, longest) in enumerate(met):
            shorter = met[k + 1][1] if k + 1 < len(met) else 0
            for n in range(shorter + 1, longest + 1):
                assert max(e for e in range(n - 1, i) if w[e - n + 1:e + 1] == w[i - n + 1:i + 1]) == j
        longest = met[0][1] if met else 0
        assert not any(w[e - longest:e + 1] == w[i - longest:i + 1] for e in range(longest, i))


def test_islands_leave_prose_out():
    rng = np.random.default_rng(1)
    prose = " ".join(f"w{k}" for k in (rng.zipf(1.3, 20000) % 500).tolist())
    words = T.Words(*T.utf8(pa.array([prose])), T.BLANK)
    assert sum(b - a + 1 for a, b in periodic.islands(words.hashes(), words.first)) < 0.05 * len(words)


@pytest.fixture(scope="module")
def docs(make):
    rng = random.Random(11)
    rows = [(i, " ".join(some_words(rng, rng.randint(0, 120)))) for i in range(120)]
    return make([*rows, *rows[:5], (None, "a " * 9), (-3, "\t" + "x y z " * 8 + "\n"), (500, None), (501, ""), (502, " \n")])


def test_digests_equal_brute_force(docs, hard, make):
    got = sorted((tuple(r) for r in periodic.digests(docs).collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) and sum(r[1] for r in got) > 50
    assert periodic.digests(hard).count() == hard.count() and periodic.digests(make([])).count() == 0


def test_collapse_and_clashing_names(make):
    df = make([(1, "go a b a b a b a b\nend"), (2, " no\trun "), (3, None)]).withColumnsRenamed({"node": "runs", "blob": "collapsed"})
    out = periodic.collapse(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "go a b end", 2: " no\trun ", 3: None}
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.mark(df).collect()} == {1: [(1, 8, 2)], 2: [], 3: []}
