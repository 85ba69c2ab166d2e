import json
import random
import uuid

from tickwise.llm import common
from tickwise.llm.components import connected_components
from tickwise.llm.near_dup import _blocked, near_duplicates, shingle_hashes, sketch_of

SCHEMA = "doc_id long, text string, component_id string, kept int"


def brute(rows, words, percent):
    """doc_id -> smallest doc_id reachable, by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        if w:
            sets.setdefault(doc_id, []).append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    label = {d: d for d, _ in rows if d is not None}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    label[b] = label[a]
                    changed = True
    return label


def texts(n, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if i % 3 and out:
            words = out[rng.randrange(len(out))].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 20, 40]))]
        out.append(" ".join(words))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], SCHEMA)
    return near_duplicates(df, **kw).collect()


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(120)))
    got = run(spark, rows, words=2)
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 2, 80)


def test_blocks_and_depth_do_not_change_the_result(spark):
    """A leaf and a block of a few documents force deep trees, blocks, anchors and the rounds after them."""
    base = " ".join(f"a{i}" for i in range(40))
    rows = list(enumerate(texts(60, seed=9)))
    for i in range(40):
        words = base.split()
        words[i] = "b"
        rows.append((1000 + i, " ".join(words)))
    got = run(spark, rows, words=2, leaf=4, block=8, set_block=8, trees=8, depth=4)
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 2, 80)


def pair_groups(n):
    """Row i and row i + n / 2 link, no others."""

    def near_of(batch):
        ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
        return (ids[:, None] % (n // 2)) == (ids[None, :] % (n // 2))

    return near_of


def recording(near_of, folder):
    def seen(batch):
        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            json.dump(batch.column(batch.schema.get_field_index("id")).to_pylist(), f)
        return near_of(batch)

    return seen


def test_pairs_of_blocks_meet_all_and_keep_tasks_small(spark, tmp_path):
    """Without levels, all cross-class pairs meet once at least, in tasks of two blocks at most."""
    n, block = 240, 16
    members = spark.createDataFrame([(5, n / block, i, 1 / block) for i in range(n)], "grp long, fill double, id long, w double")
    got = _blocked(members, lambda dealt: dealt, recording(pair_groups(n), str(tmp_path)), 4)
    assert {tuple(sorted((r.a, r.b))) for r in got.collect()} == {(i, i + n // 2) for i in range(n // 2)}
    seen = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert max(map(len, seen)) <= 3 * block  # two blocks, uneven by the hash
    met = {frozenset((a, b)) for ids in seen for a in ids for b in ids if a < b}
    assert len(met) == n * (n - 1) // 2


def template_group(n, shared=60, own=30, seed=3):
    """n texts of one template, below 80 % of each other, and each even one with a partner above it."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        mine = [f"o{i}x{j}" for j in range(own)] if i % 2 == 0 or not rows else list(mine)
        if i % 2:
            mine[rng.randrange(own)] = f"p{i}"
        rows.append((i, " ".join([f"t{j}" for j in range(shared)] + mine)))
    return rows


def test_rows_stay_in_proportion_where_most_of_a_group_is_unlinked(spark, tmp_path):
    """Members dealt for 16 and for 64 blocks: four times as many and some levels, not sixteen; every link is found."""
    dealt = {}
    for n in (256, 1024):
        rows = template_group(n)
        reps = spark.createDataFrame([(i, sketch_of(shingle_hashes(t, 1, {})).astype("uint16").tobytes()) for i, t in rows], "id long, sketch binary")
        members = spark.createDataFrame([(5, n / 16, i, 1 / 16) for i in range(n)], "grp long, fill double, id long, w double")
        folder = tmp_path / str(n)
        folder.mkdir()

        def near_of(batch):
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            return (ids[:, None] // 2) == (ids[None, :] // 2)

        got = {tuple(sorted((r.a, r.b))) for r in _blocked(members, lambda x: x, recording(near_of, str(folder)), 4, reps=reps, levels=12).collect()}
        assert got == {(i, i + 1) for i in range(0, n, 2)}
        seen = [json.loads(f.read_text()) for f in folder.iterdir()]
        assert max(map(len, seen)) <= 4 * 16  # two blocks, uneven by the hash
        dealt[n] = sum(map(len, seen))
    assert dealt[1024] <= 8 * dealt[256] and dealt[1024] <= 20 * 1024, dealt  # levels grow with the logarithm


def test_large_groups_below_the_similarity(spark):
    """A template group of unlinked members and partners above 80 %, through all stages with small blocks."""
    rows = template_group(240)
    got = {r.doc_id: r.component_id for r in run(spark, rows, words=1, leaf=8, block=16, set_block=16, depth=3)}
    assert got == {i: i - i % 2 for i in range(240)}


def test_many_repeats_of_rows_and_of_ids(spark):
    """10,000 repeats of one row, and one doc_id with many texts, cost no more than other rows."""
    same = [(7, "one two three four five six seven eight")] * 10_000
    several = [(9, f"text number {i} of the same id alpha beta gamma{i} delta{i}") for i in range(300)]
    other = [(3, "text number 5 of the same id alpha beta gamma5 delta5"), (12, "quite another text in this place")]
    got = run(spark, same + several + other, words=2)
    assert len(got) == len(same) + len(several) + len(other)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(7, 7, True), (9, 3, False), (3, 3, True), (12, 12, True)}


def test_deep_nodes_keep_pairs_at_the_threshold(spark):
    """Pairs at exactly 80 % whose nodes branch to the last level (no leaf before it), with the default trees."""
    rows = []
    for pair in range(1500):
        same = [f"s{pair}x{i}" for i in range(80)]
        rows += [(2 * pair + side, " ".join(same + [f"o{pair}x{side}x{i}" for i in range(10)])) for side in (0, 1)]
    got = run(spark, rows, words=1, leaf=1)
    assert {r.component_id % 2 for r in got if r.kept and r.doc_id % 2 == 0} == {0}
    assert sum(r.kept for r in got if r.doc_id % 2) <= 4  # 0.1 % would be 1.5


def test_nulls_empty_copies_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "one two"), (None, None), (7, "x " * 30_000), (8, "x " * 30_000)]
    got = run(spark, rows, words=2)
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert by == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 7, True), 8: (1, 7, False)}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_only_sets_of_large_groups_are_kept(spark, tmp_path, monkeypatch):
    """Sets go from the texts to their groups once; a table holds those of groups over a block alone, for the rounds after."""
    rows = [(2 * p + side, " ".join(f"p{p}x{i}" for i in range(30 + side))) for p in range(20) for side in (0, 1)]
    rows += [(1000 + i, " ".join([f"g{j}" for j in range(60)] + [f"own{i}"])) for i in range(12)]
    held = {}
    for block in (256, 8):
        folder = tmp_path / str(block)
        monkeypatch.setattr(common, "shared_dir", lambda _, at=folder: str(at))
        got = run(spark, rows, words=2, set_block=block)
        assert {r.doc_id: r.component_id for r in got} == brute(rows, 2, 80)
        tables = [spark.read.parquet(str(t)) for t in folder.glob("cut-*") if list(t.glob("part-*"))]
        assert len(tables) > 5
        held[block] = sum(t.count() for t in tables if "members" in t.columns)
    assert held == {256: 0, 8: 12}


def test_no_rows(spark):
    assert run(spark, [], words=5) == []


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (8, 8), (None, 3), (20, 21), (21, 20), *[(100 + i, 101 + i) for i in range(30)]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, 20: 20, 21: 20} | {100 + i: 100 for i in range(31)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_with_hubs(spark):
    """Nodes of many links meet them by broadcast; the result is the same."""
    links = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(150, 400)] + [(1000 + i, 1001 + i) for i in range(9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), hub=20).collect()}
    assert got == {i: 0 for i in [*range(400), 500]} | {1000 + i: 1000 for i in range(10)}
