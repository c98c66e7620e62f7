"""Exact duplicates, spelling variants and periodic runs against brute force, and odd input."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import exact_dedup, periodic_runs, spelling

DOCS = "doc_id long, text string, `a.b` string, digest string, id long, row string"


def lowered(t):
    return (t or "").encode().lower().decode()


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    some = ["Ärger", "ärger", "ABC", "abc", "", None, "ab c", "İ", "i̇", "x" * 50_000, "X" * 50_000]
    return [(i if rng.random() > 0.1 else int(rng.integers(0, n)), some[int(rng.integers(0, len(some)))], f"r{i}", "d", 7, "w") for i in range(n)]


@pytest.mark.parametrize(("digest", "hot"), [(exact_dedup.sha256, 1000), (lambda t: F.substring(t, 1, 1), 1000), (exact_dedup.sha256, 3), (lambda t: F.lit("same"), 4)])
def test_exact_groups(spark, digest, hot):
    rows = [*texts(200), (None, "ABC", "n1", "d", 7, "w"), (None, "only", "n2", "d", 7, "w")]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS).repartition(5), digest=digest, hot=hot).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = [(i, best[lowered(t)], len(groups[lowered(t)]), i == best[lowered(t)]) for i, t, *_ in rows]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found], key=key) == sorted(expected, key=key)


def test_exact_deduplicate_keeps_columns_and_one_row(spark):
    rows = [*texts(60), (500, "Abc", "p", "d", 1, "w"), (500, "aBC", "q", "d", 2, "w")]
    docs = spark.createDataFrame(rows, DOCS)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({lowered(r[1]) for r in rows}) and set(got) <= set(rows)
    assert sum(lowered(r[1]) == "abc" for r in got) == 1 and all(r[0] == 500 for r in got if lowered(r[1]) == "abc")


def test_new_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert periodic_runs.periodic_runs(none).count() == 0 and periodic_runs.collapse(none).count() == 0
    assert spelling.variants(spelling.words(none)).count() == 0


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def word_list(n, seed, letters="anderthonéß"):
    """Words of few syllables, so that some grams are very frequent, and their neighbours."""
    rng = np.random.default_rng(seed)
    parts = ["and", "the", "tion", "er", "en", "on", "é", "ß"]
    out = set()
    while len(out) < n:
        w = "".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(3, 6))))
        k = int(rng.integers(0, len(w)))
        c = letters[int(rng.integers(0, len(letters)))]
        out.add([w, w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]][int(rng.integers(0, 4))])
    return sorted(w for w in out if len(w) >= 7)


@pytest.mark.parametrize("share", [200, 20, 3])
def test_keys_of_near_words_meet(share):
    """Whatever grams are frequent, two words at distance 1 share a key; without frequent grams the keys are most precise."""
    ws = word_list(350, share)
    for cut in (0.0, 1 / share):
        counts, places = {}, 0
        for w in ws:
            places += len(w) - 1
            for q in (2, 3):
                for p in range(len(w) - q + 1):
                    counts[w[p : p + q]] = counts.get(w[p : p + q], 0) + 1
        frequent = frozenset(g for g, n in counts.items() if cut and n > cut * places)
        endings = frozenset(g[k:] for g in frequent for k in range(1, len(g)))
        made = {w: spelling.keys(w, frequent, endings) for w in ws}
        for i, a in enumerate(ws):
            for b in ws[:i]:
                if distance_one(a, b):
                    long, short = (a, b) if len(a) >= len(b) else (b, a)
                    other = made[short][0] if len(a) == len(b) else made[short][1]
                    assert made[long][0] & other, (a, b)


def test_variants_against_brute_force(spark):
    rng = np.random.default_rng(5)
    ws = [(w, int(10 ** rng.integers(0, 5) * rng.integers(1, 4))) for w in word_list(400, 9)]
    long = "qwertzu" * 20
    ws += [(long, 3), (long + "x", 40), (long[1:], 500), ("p" * 64 + "é", 3), ("p" * 64, 30), ("p" * 63, 2)]
    n = dict(ws)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(ws, "word string, n long").repartition(3)).collect()}
    assert set(got) == set(n)
    form = {}
    for w in n:
        near = [v for v in n if distance_one(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n) == (n[w], len(near), form[w], n[form[w]] if form[w] else None), w
    depth = 0
    for w in n:
        r, steps = w, 0
        while form[r]:
            r, steps = form[r], steps + 1
        depth = max(depth, steps)
        assert got[w].root == r
    assert depth >= 2  # chains are followed


def test_words_and_disturbance(spark):
    docs = [(i, "Größeren GRÖSSEREN größeren naïveté—naïveté x1naïveté ×÷×÷×÷× Őverflow" * (1 + i % 2), "w") for i in range(60)] + [(None, "nullids nullids", "w"), (3, None, "w"), (4, " \t ", "w")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string")
    counts = {}
    for i, t, _ in docs:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                w = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[w] = counts.get(w, 0) + 1
            run = ""
    got = {r.word: r.n for r in spelling.words(frame, change=spelling.disturbed).collect()}
    assert got == {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    assert len(got) > 5


def brute_runs(x):
    out = {}
    for q in range(1, len(x) // 4 + 1):
        same = np.diff(np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(int))
        for s, e in zip(np.flatnonzero(same == 1), np.flatnonzero(same == -1)):
            if e - s + q >= max(6, 4 * q):
                out.setdefault((int(s), int(e + q)), q)
    return sorted([(s, e, q) for (s, e), q in out.items()], key=lambda r: (r[0], r[2]))


def repetitive(rng, n, letters):
    parts, size = [], 0
    while size < n:
        parts.append(np.tile(rng.integers(0, letters, int(rng.integers(1, 14))), int(rng.integers(1, 9))))
        size += len(parts[-1])
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def test_runs_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(600):
        x = repetitive(rng, int(rng.integers(0, 160)), int(rng.integers(1, 5)))
        assert periodic_runs.runs(x, len(x)) == brute_runs(x), x.tolist()
    for x in (np.zeros(3000, np.int64), np.tile(np.arange(700), 5), np.tile(np.repeat([0, 1], 40), 6)):
        assert periodic_runs.runs(x, len(x)) == brute_runs(x)


def test_block_convolution_finds_just_the_equal_blocks():
    rng = np.random.default_rng(2)
    for b in (1, 2, 8, 64):
        # sums of squares far beyond one prime: residues of one alone would not do
        x = np.concatenate([np.tile(rng.integers(0, 3, b + b // 2) * 900_000_000, 4), rng.integers(0, 2**30, 4 * b)])
        starts = np.arange(0, len(x) - 3 * b + 1, b)
        i, d = periodic_runs.mismatch_free(x, starts, b)
        expected = {(k, s) for k, at in enumerate(starts) for s in range(b, 2 * b) if (x[at : at + b] == x[at + s : at + s + b]).all()}
        assert set(zip(i.tolist(), d.tolist())) == expected and expected


def test_periodic_rows_and_collapse(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{k}" for k in repetitive(rng, 200, 3))) for i in range(50)] + [(100, None), (101, " \n "), (102, "ab " * 60_000), (102, "ab " * 60_000), (None, "x  y x y x y x y z")]
    frame = spark.createDataFrame([(i, t, "k", i) for i, t in docs], "doc_id long, text string, n_runs string, `a.b` long").repartition(3)
    got = sorted(map(tuple, periodic_runs.periodic_runs(frame).collect()), key=repr)
    expected, cut = [], []
    for i, t in docs:
        w = (t or "").split()
        own = brute_runs(np.unique(np.array(w), return_inverse=True)[1]) if len(w) and i != 102 else [(0, 60_000, 1)] if w else []
        drop = {k for s, e, q in own for k in range(s + q, e)}
        kept = " ".join(x for k, x in enumerate(w) if k not in drop)
        best = max(own, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
        four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in own)
        expected.append((i, len(own), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
        cut.append((i, kept if own else t, "k", i))
    assert got == sorted(expected, key=repr)
    out = periodic_runs.collapse(frame)
    assert out.columns == frame.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(cut, key=repr)
