import numpy as np

from wordloom.llm.embedding_dedup import COSINE, near_vectors


def brute(rows):
    unit = {}
    for n, (_, e, label) in enumerate(rows):
        if label is not None and e is not None and None not in e and np.isfinite(e).all() and np.abs(e).max(initial=0) > 0:
            x = np.array(e, float)
            unit[n] = x / np.linalg.norm(x)
    links = {n: [m for m in unit if m != n and rows[m][2] == rows[n][2] and len(unit[m]) == len(unit[n]) and (unit[n] @ unit[m] >= COSINE or rows[n][1] == rows[m][1])] if n in unit else [] for n in range(len(rows))}
    comp = {}
    for n in sorted(range(len(rows)), key=lambda n: rows[n][0]):
        todo = [n]
        while todo:
            m = todo.pop()
            if m not in comp:
                comp[m] = rows[n][0]
                todo += links[m]
    return sorted((rows[n][0], len(links[n]), comp[n], comp[n] == rows[n][0]) for n in range(len(rows)))


def test_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        centre = r.standard_normal(16)
        for _ in range(int(r.choice([1, 1, 2, 5, 120]))):
            rows.append((centre + r.standard_normal(16) * 0.12).astype(np.float32).tolist())
    rows = [(i, e, int(i % 3 > 0)) for i, e in enumerate(rows)]
    rows += [(10_000 + i, rows[5][1], rows[5][2]) for i in range(200)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 16, 1), (20_002, [float("nan")] * 16, 1), (20_003, [1.0, None], 1), (20_004, rows[0][1], None), (20_005, [1.0, 2.0], 1), (20_006, [2.0, 4.0], 1), (20_007, [], 1), (20_008, [1e30, 2e30], 1)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, kept int").repartition(4)
    got = sorted(map(tuple, near_vectors(df).collect()))
    want = brute(rows)
    assert [x[0] for x in got] == [x[0] for x in want]
    found, all_ = sum(x[1] for x in got), sum(x[1] for x in want)
    assert found <= all_ and found >= 0.97 * all_
    assert np.mean([a[2] == b[2] for a, b in zip(got, want, strict=True)]) > 0.97
    tail = {x[0]: x for x in got}
    assert tail[20_005][1] == 2 and all(tail[20_000 + i][1] == 0 for i in (0, 1, 2, 3, 4, 7))
    assert near_vectors(df.limit(0)).count() == 0


def test_threshold_pairs_of_a_large_label_off_centre(spark):
    """Unlike vectors have a cosine of about 0.5; planted pairs lie just above the threshold."""
    r = np.random.default_rng(8)
    n, pairs, size = 10_000, 600, 64
    mean = np.ones(size) / np.sqrt(size)
    x = mean + r.standard_normal((n, size)) / np.sqrt(size)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((pairs, size))
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    y = 0.932 * x[:pairs] + np.sqrt(1 - 0.932**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    out = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = [out[i].component_id == out[n + i].component_id and out[n + i].n_links > 0 for i in range(pairs)]
    assert np.mean(found) >= 0.97
