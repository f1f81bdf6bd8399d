import math

import numpy as np
import pytest

from tidemark.llm import vectors


def direction(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def slow(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    near = [[] for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if direction(a) and direction(b) and len(a) == len(b):
                a_, b_ = np.array(a, float) / max(map(abs, a)), np.array(b, float) / max(map(abs, b))
                if a_ @ b_ / math.sqrt((a_ @ a_) * (b_ @ b_)) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            front = [k for k in {k for j in front for k in near[j]} if k not in seen]
            seen |= set(front)
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((vec_id, len(near[i]), least, vec_id == least))
    return out


key = lambda r: tuple(map(str, r))


def found(spark, rows, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    out = vectors.near_duplicate_vectors(df, **more)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(key, out.collect()))


def cloud(rng, groups, each, dim, noise):
    centres = rng.normal(size=(groups, dim))
    made = np.concatenate([c + noise * np.linalg.norm(c) / math.sqrt(dim) * rng.normal(size=(each, dim)) for c in centres])
    return made[rng.permutation(len(made))].astype(np.float32)


def test_bounds_hold():
    """The cosine lies within the bound of the codes' product, also for one large component and for many dimensions."""
    rng = np.random.default_rng(1)
    for dim in (1, 2, 64, 1500):
        full = rng.normal(size=(300, dim)) * rng.choice([1e-30, 1, 1e200], (300, 1))
        full[:50, 0] *= 1000
        full[100:200] = full[:100] * (1 + 0.2 * rng.normal(size=(100, dim)))
        units = vectors.unit(full)
        codes, scale, error = vectors.quantised(units)
        near = vectors.products(codes, codes) * scale[:, None].astype(float) * scale
        bound = error[:, None] + error * (1 + error[:, None])
        assert (np.abs(near - units @ units.T) <= bound + 1e-12).all()
        assert (vectors.products(codes, codes) == codes.astype(int) @ codes.T.astype(int)).all()


def tile(full, node):
    codes, scale, error = vectors.quantised(vectors.unit(full))
    return vectors.Tile(np.array(node, np.int64).tobytes(), np.ones(len(full), np.int64).tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes(), full.tobytes(), full.dtype == np.float64)


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(2)
    for dim in (8, 64, 1100):
        full = cloud(rng, 12, 50, dim, 0.33)  # cosines around 0.9
        units = vectors.unit(full)
        want = units @ units.T >= 0.9
        a, b = tile(full[:350], range(350)), tile(full[350:], range(350, 600))
        got = np.zeros((350, 250), bool)
        for i, j in vectors.linked_pairs(a, b):
            got[i, j] = True
        assert (got == want[:350, 350:]).all() and got.any() and not got.all()
        node, links, _ = vectors.tile_links(a, None)
        inside = want[:350, :350].sum(axis=1) - 1
        assert dict(zip(node.tolist(), links.tolist())) == {i: n for i, n in enumerate(inside.tolist()) if n}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whole_against_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    full = np.concatenate([cloud(rng, 8, 25, 16, 0.36), cloud(rng, 1, 60, 16, 0.05), cloud(rng, 40, 1, 16, 0)])
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(full)), full.tolist())]
    rows += [(1000 + i, full[3].tolist()) for i in range(30)] + [(2000, (2 * full[3]).tolist()), (2001, (-full[3]).tolist())]
    rows += [(1, full[7].tolist()), (1, full[7].tolist()), (None, full[9].tolist()), (None, [1.0] * 5), (3000, [1.0] * 5), (3001, [1.0, 2.0])]
    want = sorted(map(key, slow(rows)))
    assert found(spark, rows, kind) == want
    assert found(spark, rows, kind, tile=20) == want  # many cells and tiles


def test_vectors_without_direction(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [0.0, -0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [-inf, inf], [1e-40, 0.0], [1.0, 0.0], [3e38, 3e38], [1.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(odd + odd)] + [(None, [0.0]), (None, [5.0])]
    assert found(spark, rows) == sorted(map(key, slow([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])))


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3, "x"), (2, [1.0, 0.1], 4, "y")], "vec_id long, embedding array<float>, node int, dim string")
    assert sorted(map(tuple, vectors.near_duplicate_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_far_cells_never_meet(spark, monkeypatch):
    """Clustered data: tiles of cells beyond reach aren't multiplied, and nothing is lost."""
    rng = np.random.default_rng(4)
    full = cloud(rng, 6, 40, 64, 0.1)
    rows = [(i, v) for i, v in enumerate(full.tolist())]
    made = []
    monkeypatch.setattr(vectors, "saved", lambda df, name, f=vectors.saved: made.append((name, f(df, name))) or made[-1][1])
    assert found(spark, rows, tile=40) == sorted(map(key, slow(rows)))
    pairs = dict(made)["tile_pairs"].count()
    tiles = dict(made)["tiles"].count()
    assert tiles >= 6 and pairs < tiles * (tiles + 1) / 4
