"""Members of common band keys are compared once, under the first key they share."""

from collections import Counter

import numpy as np

from brindle.llm import minhash


def test_each_pair_of_templated_pages_is_compared_once():
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(300)]
    known = minhash.WordHashes()
    sets = [minhash.shingles(" ".join(base + [f"w{rng.integers(10**9)}" for _ in range(60)]), known) for _ in range(120)]
    n_rows, n_bands = minhash.shape(80)
    m = minhash.minima(sets)
    keys = [[hash(b.tobytes()) for b in row] for row in m.reshape(len(sets), n_bands, n_rows)]
    bands, sizes, part = np.array(keys), np.array([len(s) for s in sets]), np.arange(len(sets))
    compared, shared = Counter(), set()
    for slot in range(n_bands):
        for band in np.unique(bands[:, slot]):
            rows = np.flatnonzero(bands[:, slot] == band)
            shared |= {(i, j) for i in rows.tolist() for j in rows.tolist() if i < j}
            if len(rows) > 1:
                for i, js in minhash.to_compare(m[rows], bands[rows], slot, part[rows], sizes[rows], None, 80):
                    compared.update((int(rows[i]), int(rows[j])) for j in js)
    assert max(compared.values()) == 1
    share = 0.8
    limit = share - minhash.SLACK * np.sqrt(share * (1 - share) / minhash.MINIMA)
    assert set(compared) == {(i, j) for i, j in shared if (m[i] == m[j]).mean() >= limit}
    assert sum(compared.values()) <= len(sets) * (len(sets) - 1) // 2
