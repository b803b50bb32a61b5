"""Statistics against numpy and plain Python: inflation, thinning, quantiles, tails, fluctuations, densities."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import collinear, quantiles, stats, undersample
from strandframe.plans import plots, standins
from strandframe.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def by_least_squares(x, names):
    """Variance inflation of each column on all others; the constant's about zero."""
    out = {}
    for i, n in enumerate(names):
        rest = np.delete(x, i, 1)
        left = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        has = "const" in names and n != "const"
        total = ((x[:, i] - x[:, i].mean()) ** 2).sum() if has else (x[:, i] ** 2).sum()
        out[n] = total / (left @ left) if left @ left > 1e-9 * total else math.inf
    return out


def test_inflation_of_vectors(spark):
    """All 64 components of the vectors with three columns made of them, against one regression for each column."""
    got = {r["parameter"]: r for r in QUERIES["m07_vif_vectors"](spark, FOLDER).collect()}
    v = np.array([r["aev"] for r in standins.vectors(spark, FOLDER).orderBy("vec_id").collect()])
    x = np.column_stack([np.ones(len(v)), v, v[:, 0] + v[:, 1], v[:, 2] + v[:, 3] / 20])
    names = ["const", *[f"aev_{i}" for i in range(64)], "both", "near"]
    want = by_least_squares(x, names)
    assert set(got) == set(names)  # the column of zeros is left out
    for n in names:
        assert got[n]["vif"] == (pytest.approx(want[n], rel=1e-6) if math.isfinite(want[n]) else math.inf)
    gone = []
    while len(names) > 2:
        found = by_least_squares(x, names)
        worst = max(names, key=lambda n: (found[n], n))
        if found[worst] < 5:
            break
        gone.append((worst, found[worst]))
        x = np.delete(x, names.index(worst), 1)
        names.remove(worst)
    assert len(gone) >= 2 and [(r["parameter"]) for r in sorted(got.values(), key=lambda r: r["dropped"] or 99) if r["dropped"]] == [n for n, _ in gone]
    for n, f in gone:
        assert got[n]["vif_dropped"] == (pytest.approx(f, rel=1e-6) if math.isfinite(f) else math.inf)


def test_elimination_by_downdates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 30)) @ rng.normal(size=(30, 30))
    x = np.column_stack([np.ones(300), x, x[:, 4] - 2 * x[:, 7], x[:, :3] + 0.01 * rng.normal(size=(300, 3))])
    names = ["const", *(f"c{i:02}" for i in range(x.shape[1] - 1))]
    gone = collinear.eliminate(x.T @ x, names, 5.0)
    want, left = [], list(names)
    while True:
        found = by_least_squares(x, left)
        worst = max(left, key=lambda n: (found[n], n))
        if found[worst] < 5 or len(left) == 2:
            break
        want.append(worst)
        x = np.delete(x, left.index(worst), 1)
        left.remove(worst)
    assert [n for n, _ in gone] == want and len(want) > 5


def test_incomplete_rows_have_no_part(spark):
    rows = [(1.0, [1.0, 5.0]), (2.0, [0.5, 4.0]), (None, [1.0, 2.0]), (3.0, None), (4.0, [1.0, None]), (5.0, [7.0, 1.0]), (6.0, [2.0, 2.5]), (1.5, [1.0])]
    g, names = collinear.gram(spark.createDataFrame(rows, "a double, v array<double>"), ["a", "v"])
    x = np.array([[1, a, *v] for a, v in rows if a and v and len(v) == 2 and None not in v])
    assert names == ["a", "v_0", "v_1"] and g == pytest.approx(x.T @ x)
    assert collinear.gram(spark.createDataFrame([], "a double"), ["a"])[1] == []


def lloyd(x, centres, most):
    for _ in range(most):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        fresh = np.array([x[label == j].mean(0) if (label == j).any() else c for j, c in enumerate(centres)])
        if abs(fresh - centres).max() <= 1e-12:
            break
        centres = fresh
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def clusters(x, radius):
    """Components of the points at most a radius apart, by flooding."""
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= radius**2
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if label[i] < 0:
            front = [i]
            label[i] = i
            while front:
                for j in np.flatnonzero(near[front.pop()] & (label < 0)):
                    label[j] = i
                    front.append(j)
    return label


def test_starts_advance_together(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.4, (40, 5)) for c in ([0] * 5, [4] * 5, [0, 4, 0, 4, 0], [8, 0, 0, 0, 0])])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    centres, cost = undersample.k_means(rows, 4, starts=20, most=50)
    want, least = lloyd(x, np.stack([x[i * 40 : i * 40 + 40].mean(0) for i in range(4)]), 50)
    assert cost == pytest.approx(least) and sorted(map(tuple, centres.round(6))) == sorted(map(tuple, want.round(6)))
    label = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert {r["cluster"]: r["id"] for r in undersample.nearest_rows(rows, centres).collect()} == {j: min(np.flatnonzero(label.argmin(1) == j), key=lambda i: (label[i, j], i)) for j in range(4)}
    few = undersample.k_means(spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [3.0])], "id long, v array<double>"), 3, starts=3, most=5)
    assert few[1] == 0


@pytest.mark.parametrize(("width", "radius", "most"), [(1, 0.02, 8), (2, 0.08, 10), (3, 0.2, 12), (6, 0.5, 20), (6, 0.5, 4000), (2, 3.0, 10)])
def test_density_clusters_in_any_dimension(spark, width, radius, most):
    """Small parts force cuts with margins and, where everything is near, pairs of blocks; repeated points and a dense cell are joined by their cell."""
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.random((120, width)), np.repeat(rng.random((1, width)), 30, 0), 0.5 + 1e-4 * rng.random((30, width))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["label"] for r in undersample.density_labels(points, radius, most).collect()}
    assert got == dict(enumerate(clusters(x, radius).tolist()))


def test_undersample_by_brute_force(spark):
    """The query on all 64 components with 100 starts, against numpy; the best cost is no worse than what 100 own starts find."""
    got = {k: set() for k in ("common", "outlier")}
    for r in QUERIES["m09_undersample"](spark, FOLDER).collect():
        got[r["kind"]].add(r["vec_id"])
    rows = standins.vectors(spark, FOLDER).orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["aev"] for r in rows])
    a, b = np.percentile(x, [25, 75], axis=0)
    far = ((x < a - 1.5 * (b - a)) | (x > b + 1.5 * (b - a))).any(1)
    common, rare = ((y - y.mean(0)) / y.std(0) for y in (x[~far], x[far]))
    rng, least = np.random.default_rng(1), np.inf
    for _ in range(100):
        least = min(least, lloyd(common, undersample.first_centres(common, 8, rng), 500)[1])
    z = undersample.standardised(standins.vectors(spark, FOLDER).filter(~F.col("vec_id").isin(ids[far].tolist())), "vec_id", F.col("aev"))
    centres, cost = undersample.k_means(z, 8)
    assert cost == pytest.approx(lloyd(common, centres, 1)[1]) and cost <= least * 1.01
    d = ((common[:, None] - centres[None]) ** 2).sum(2)
    assert got["common"] == {ids[~far][min(np.flatnonzero(d.argmin(1) == j), key=lambda i: (d[i, j], i))] for j in range(8)}
    label = clusters(rare, 0.6 * np.sqrt(cost / len(common)))
    want = set()
    for k in set(label):
        members = np.flatnonzero(label == k)
        want.add(ids[far][members[((rare[members] - rare[members].mean(0)) ** 2).sum(1).argmin()]])
    assert got["outlier"] == want


def test_quantiles_of_hot_groups(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if i % 2 else [None, "a", "b"][i % 3], float(rng.integers(0, 50)) if i % 5 else None, float(x)) for i, x in enumerate(rng.normal(size=4000))] + [("one", 3.0, 4.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    qs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {(r["k"], r["feature"]): r["q"] for r in quantiles.quantiles(df, ["k"], ["x", "y"], qs).collect()}
    assert set(got) == {(k, f) for k in ("hot", None, "a", "b", "one") for f in "xy"}
    for (k, f), q in got.items():
        assert q == pytest.approx(np.quantile([r["xy".index(f) + 1] for r in rows if r[0] == k and r["xy".index(f) + 1] is not None], qs))
    assert quantiles.quantiles(df, [], ["y"], [0.5]).first()["q"] == pytest.approx([np.median([r[2] for r in rows if r[2] is not None])])
    assert quantiles.quantiles(df.limit(0), ["k"], ["x"], [0.5]).count() == 0


def test_fisher_tail_is_exact(spark):
    rng = np.random.default_rng(9)
    tables = [tuple(int(x) for x in rng.integers(0, m, 4)) for m in (2, 5, 30, 300) for _ in range(20)] + [(0, 0, 0, 0), (0, 900, 800, 5), (700, 3, 2, 900)]
    got = stats.fisher_greater(spark.createDataFrame([(i, *t) for i, t in enumerate(tables)], "i int, a long, b long, c long, d long")).collect()
    for r in got:
        a, b, c, d = tables[r["i"]]
        tail = sum(Fraction(math.comb(a + b, a + k) * math.comb(c + d, c - k), math.comb(a + b + c + d, a + c)) for k in range(min(b, c) + 1))
        assert r["p"] == pytest.approx(float(tail), rel=1e-10)


def fit(p, q):
    u, _, vt = np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    return lambda x: (x - p.mean(0)) @ turn + q.mean(0)


def test_fluctuations_of_found_ensembles(spark):
    """Both kinds of superposition, on ensembles found by their CA atoms, against numpy."""
    got = {(r["align"], r["signature"], r["resid"]): (r["rmsf"], r["members"]) for r in QUERIES["m12_rmsf_ensembles"](spark, FOLDER).collect()}
    a = standins.atoms(spark, FOLDER).withColumn("resid", F.col("resid") % 25).toPandas()
    groups = {}
    for s, g in a.groupby("structure"):
        groups.setdefault(tuple(sorted(zip(g[g["name"] == "CA"]["resid"], g[g["name"] == "CA"]["resname"]))), []).append((s, g))
    assert len(groups) == len({k[1] for k in got})
    want = Counter()
    for members in groups.values():
        members.sort(key=lambda x: x[0])
        at = {"backbone": {}, "local": {}}
        backbone = [g[g["name"].isin(["N", "CA", "C", "O"])].set_index(["resid", "name"])[["x", "y", "z"]] for _, g in members]
        for (_, g), own in zip(members, backbone, strict=True):
            both = own.join(backbone[0], rsuffix="_q", how="inner")
            whole = fit(both.to_numpy()[:, :3], both.to_numpy()[:, 3:])
            for resid, xyz in zip(g[g["name"] == "NZ"]["resid"], g[g["name"] == "NZ"][["x", "y", "z"]].to_numpy(), strict=True):
                near = both.loc[resid].to_numpy()
                at["backbone"].setdefault(resid, []).append(whole(xyz))
                at["local"].setdefault(resid, []).append(fit(near[:, :3], near[:, 3:])(xyz))
        for align, values in at.items():
            for resid, v in values.items():
                want[(align, resid, round(float(np.sqrt(np.var(np.array(v), axis=0).sum())), 4) if len(members) > 1 else None, len(members))] += 1
    assert Counter((align, resid, round(x, 4) if x is not None else None, n) for (align, _, resid), (x, n) in got.items()) == want
    with pytest.raises(ValueError):
        stats.rmsf(None, None, "sideways")


def test_density_by_bins(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(40, 0.5, 100), [5.0] * 50])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    h = x.std(ddof=1) * len(x) ** -0.2
    assert plots.bandwidth_rule(df, "x") == pytest.approx(h)
    for given in (None, 0.3):
        got = [tuple(r) for r in plots.density(df, "x", given, points=60).orderBy("at").collect()]
        grid = np.linspace(x.min(), x.max(), 60)
        b = given or h
        want = np.exp(-(((grid[:, None] - x[None]) / b) ** 2) / 2).sum(1) / (len(x) * b * np.sqrt(2 * np.pi))
        assert [g[0] for g in got] == pytest.approx(grid) and [g[1] for g in got] == pytest.approx(want, abs=1e-4 * want.max())
    assert plots.density(df.filter("x = 5"), "x").count() == 0 and plots.density(df.limit(0), "x").count() == 0
