import numpy as np
import pytest

from quarrymill.llm import neighbours as N


def brute(ids, x, k=5, least=0.85):
    x = np.asarray(x, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-g[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if g[i, j] >= least}
    return out


def data(n, dims, seed, noise=0.35):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((n // 20, dims))
    x = np.concatenate([centers[r.integers(len(centers), size=n // 2)] + noise * r.standard_normal((n // 2, dims)), r.standard_normal((n - n // 2, dims))])
    return [f"v{i:05d}" for i in range(n)], x * r.uniform(0.1, 9, (n, 1))


def frame(spark, ids, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x)], "id string, vector array<float>")


#: One leaf; cells with trees of their own; cells in parts, each with a tree of its own.
SIZES = [(1 << 18, 4096), (1 << 18, 16), (150, 16)]


@pytest.mark.parametrize("cell, leaf", SIZES)
def test_recall_against_brute_force(spark, monkeypatch, cell, leaf):
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    monkeypatch.setattr(N, "MAX_DEPTH", 3)
    monkeypatch.setattr(N, "LEAF_ROWS", leaf)
    ids, x = data(3000, 64, 4)
    want = brute(ids, x.astype(np.float32))
    got = {(r["id_a"], r["id_b"]) for r in N.p4_found(frame(spark, ids, x)).collect()}
    assert len(want) > 1000 and len(want & got) / len(want) > 0.97 and len(want & got) / len(got) > 0.97


def test_a_dense_group_of_half_the_rows(spark, monkeypatch):
    """Its cells are split, its rows find their own nearest, and those of the other half are not lost."""
    monkeypatch.setattr(N, "CELL_ROWS", 128)
    monkeypatch.setattr(N, "MAX_DEPTH", 3)
    monkeypatch.setattr(N, "LEAF_ROWS", 64)
    r = np.random.default_rng(8)
    ids, x = data(2000, 64, 7)
    x = np.concatenate([x, np.eye(64)[0] + 0.002 * r.standard_normal((2000, 64))])
    ids += [f"w{i:05d}" for i in range(2000)]
    want = brute(ids, x.astype(np.float32))
    got = {(r["id_a"], r["id_b"]) for r in N.p4_found(frame(spark, ids, x)).collect()}
    assert len(want & got) / len(want) > 0.9 and len(want & got) / len(got) > 0.9
    points = frame(spark, ids, x).selectExpr("id", "monotonically_increasing_id() as row", "vector").rdd.map(lambda t: (t["id"], t["row"], bytearray(np.array(t["vector"], np.float32) / np.float32(np.linalg.norm(t["vector"]))))).toDF("id string, row long, vec binary")
    plan = N.plan_cells(points, 4000, 64)
    assert plan.begin[-1] > 2**plan.tree.depth


def test_an_unbounded_search_stops_by_the_kth_distance(spark, monkeypatch):
    """Without a least similarity, rows whose neighbours are near visit fewer cells than rows that have none near."""
    r = np.random.default_rng(9)
    y = r.standard_normal((64, 64)).astype(np.float32)
    y = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ N.projections(64)
    tree = N.Tree.fit(y, 4)
    near = np.bincount(tree.visits(y, np.full(64, 0.1), 0.9)[0], minlength=64)
    far = np.bincount(tree.visits(y, np.full(64, 1.2), 0.9)[0], minlength=64)
    assert (near <= far).all() and near.mean() * 2 < far.mean() < 16


def test_codes_of_visitors():
    r = np.random.default_rng(10)
    x = r.standard_normal((500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    again, error, kth = N.decode(N.encode(x, np.linspace(-1, 1, 500)))
    assert (np.linalg.norm(again - x, axis=1) <= error).all() and error.max() < 0.02
    assert np.allclose(kth, np.linspace(-1, 1, 500))


def test_residents_come_first():
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in rows], pa.int32()), "row": pa.array([n for _, n in rows], pa.int64()), "vec": pa.array([b"x"] * len(rows), pa.binary())})
    stream = [batch((0, 5), (0, 4)), batch((0, 3), (0, -1), (0, -2), (1, 9), (2, -4)), batch((2, -5), (3, 7)), batch((3, -1))]
    got = [(p, t["row"].to_pylist(), [n for b in v for n in b.column(1).to_pylist()]) for p, t, v in N._residents_first(iter(stream))]
    assert got == [(0, [5, 4, 3], [-1, -2]), (1, [9], []), (3, [7], [-1])]
    assert [(p, t["row"].to_pylist()) for p, t, _ in N._residents_first(iter(stream))] == [(0, [5, 4, 3]), (1, [9]), (3, [7])]  # visitors left unread


def test_chi_square():
    assert abs(N.chi_square_quantile(0.95, 8) - 15.507) < 0.05 and abs(N.chi_square_quantile(0.999, 24) - 51.18) < 0.2


def test_dirty_rows_and_copies(spark):
    e = [1.0] + [0.0] * 63
    rows = [(f"c{i:02d}", e) for i in range(9)] + [("c00", e), ("near", [1.0, 0.1] + [0.0] * 62), ("zero", [0.0] * 64), ("short", [1.0]), ("null", None), ("nan", [float("nan")] * 64), ("hole", [None] * 64), ("empty", []), (None, e), ("inf", [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").selectExpr("*", "1 as row", "2 as cell", "3 as rank")
    out = N.nearest(df, 5, 0.85)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    hubs = [f"c{i:02d}" for i in range(6)]
    assert set(got) == {f"c{i:02d}" for i in range(9)} | {"near"}
    assert [n for _, n in sorted(got["c08"])] == hubs[:5] and [n for _, n in sorted(got["near"])] == hubs[:5]
    assert [n for _, n in sorted(got["c02"])] == [h for h in hubs if h != "c02"]
    assert N.p4_found(df.where("false")).count() == 0


def _mass(t, y, radius, cells):
    """The mass that cells hold of one query's neighbours at a radius."""
    total = 0.0
    for cell in set(map(int, cells)):
        node, m = 0, 1.0
        for d in range(t.depth):
            left = N._normal(np.array([(t.thresholds[node] - y[t.coordinate[node]]) / radius]))[0]
            right = cell >> (t.depth - 1 - d) & 1
            m *= 1 - left if right else left
            node = 2 * node + 1 + right
        total += m
    return total


@pytest.mark.parametrize("depth, radius", [(10, 0.5477), (14, 0.5477), (14, 1.2)])
def test_visited_cells_hold_their_mass_in_deep_trees(depth, radius):
    r = np.random.default_rng(3)
    level = np.floor(np.log2(np.arange(2**depth - 1) + 1)).astype(np.int64)
    t = N.Tree(level, np.zeros(2**depth - 1, np.float32), depth)
    x = r.standard_normal((12, 64))
    y = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) @ N.projections(64)
    q, c = t.visits(y, np.full(12, radius), 0.9)
    assert all(_mass(t, y[i], radius, c[q == i]) >= 0.9 - 1e-6 for i in range(len(y)))
    assert len(set(zip(q, c))) == len(q)


def test_no_coordinate_is_cut_twice_on_a_path():
    y = np.random.default_rng(5).standard_normal((4000, N.PROJECTIONS)).astype(np.float32)
    t = N.Tree.fit(y, 6, taken=(3, 4))
    for cell in range(64):
        own = t.path(cell)
        assert len(set(own)) == 6 and not {3, 4} & set(own)
    assert np.bincount(t.home(y), minlength=64).min() > 40


def test_nearest_without_a_least_similarity(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 64)
    monkeypatch.setattr(N, "MAX_DEPTH", 3)
    ids, x = data(1500, 64, 6)
    got = {(min(r["id"], r["neighbour"]), max(r["id"], r["neighbour"])) for r in N.nearest(frame(spark, ids, x), 5, None).collect()}
    want = brute(ids, x.astype(np.float32), least=-1.0)
    assert len(want & got) / len(want) > 0.9
