import numpy as np

from tickwise.llm.embed_dedup import embedding_duplicates, keys_of

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, least=0.93):
    unit = {}
    for i, (vec_id, v, label, _) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            unit[i] = (label, x / np.linalg.norm(x))
    near = {i: [j for j in unit if j != i and unit[i][0] == unit[j][0] and len(unit[i][1]) == len(unit[j][1]) and unit[i][1] @ unit[j][1] >= least] for i in unit}
    label = {i: rows[i][0] for i in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for i, js in near.items():
            for j in js:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return {(rows[i][0], len(near.get(i, [])), label[i], label[i] == rows[i][0]) for i in range(len(rows))}


def rows_of(seed=1):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(12):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 14)):
            v = base + rng.normal(size=64) * rng.choice([0, 0.05, 0.15])
            rows.append((n, v.astype(np.float32).tolist(), int(rng.integers(0, 2)), "x"))
            n += 1
    nan = [float("nan")] + [1.0] * 63
    rows += [(n, None, 1, "x"), (n + 1, [], 1, "x"), (n + 2, [0.0] * 64, 1, "x"), (n + 3, nan, 1, "x"), (n + 4, [1.0] * 64, None, "x"), (n + 5, [1.0, 0.0], 1, "x"), (n + 6, [2.0, 0.0], 1, "x"), (n + 7, [None] + [1.0] * 63, 1, "x")]
    return rows


def collected(df):
    return {(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = rows_of()
    assert collected(embedding_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_blocks_do_not_change_the_result(spark):
    rows = rows_of(2)
    assert collected(embedding_duplicates(spark.createDataFrame(rows, SCHEMA), block=3)) == brute(rows)


def test_no_rows(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    group = np.zeros(len(a), dtype=np.uint64)
    ka, kb = keys_of(a, group, 10), keys_of(b, group, 10)
    found = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=(1, 2, 3))
    assert found.mean() > 0.99


def test_repeated_ids(spark):
    """A vec_id of two vectors joins both sides; many repeats and many vectors of one id cost no more than other rows."""
    rng = np.random.default_rng(7)
    u, v = rng.normal(size=64), rng.normal(size=64)
    near = lambda x: (x + 0.01 * rng.normal(size=64)).tolist()
    rows = [(5, u.tolist(), 1, "x"), (5, v.tolist(), 1, "x"), (3, near(u), 1, "x"), (9, near(v), 1, "x"), (2, near(u), 0, "x")]
    assert sorted(collected(embedding_duplicates(spark.createDataFrame(rows, SCHEMA)))) == [(2, 0, 2, True), (3, 1, 3, True), (5, 1, 3, False), (9, 1, 3, False)]
    many = [(7, rng.normal(size=64).tolist(), 1, "x") for _ in range(400)] + [(8, u.tolist(), 1, "x")] * 3000
    got = embedding_duplicates(spark.createDataFrame(many, SCHEMA)).collect()
    assert {(r.vec_id, r.component_id) for r in got} == {(7, 7), (8, 8)} and {r.n_links for r in got if r.vec_id == 8} == {2999}
