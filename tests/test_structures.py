"""Large networks, neighbourhood exclusion, nulls, boxes, sub-ensembles, panels, bundles and kept members, restated plainly."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.operators import assembly, ensemble, geometry, integrity, joins, panel, periodic, resampling, ridge, sparse, statistics, windows
from axisframe.plans import registry, structures
from axisframe.sources import binary, replay

SF = "/root/testdata/sf0.001"


def _globule(n, seed=0):
    random, side = np.random.default_rng(seed), int(np.ceil(n ** (1 / 3) - 1e-9))
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)[:n] * 3.8
    return grid + random.normal(0, 0.4, grid.shape)


# sparse modes --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n,cutoff,power,split", [(60, 7.0, 0.0, False), (150, 8.0, 2.0, False), (40, 5.0, 0.0, True), (5, 20.0, 0.0, False), (3, 1.0, 0.0, False), (2, 9.0, 0.0, False)])
def test_sparse_modes_equal_the_dense_solver(n, cutoff, power, split):
    points = _globule(n, n)
    if split:
        points[n // 2 :] += 500
    dense = ensemble.hessian(points, cutoff, power)
    own = sparse.Stiffness(points, cutoff, power)
    probe = np.random.default_rng(1).normal(size=(3 * n, 2))
    assert np.allclose(own.times(probe), dense @ probe)
    assert np.allclose(dense @ own.solve(probe) + own.shift * own.solve(probe), probe, atol=1e-6)
    values, vectors = np.linalg.eigh(dense)
    at = np.flatnonzero(values > ensemble.ZERO_MODE)[:8]
    found, modes, residuals = sparse.slowest(own, 8)
    assert np.allclose(found, values[at], atol=1e-8) and residuals.max(initial=0) <= sparse.MOST_RESIDUAL
    assert np.allclose(modes.T @ modes, np.eye(len(at)), atol=1e-8)
    whole = vectors[:, values < (found[-1] if len(found) else 0) * (1 + 1e-6) + 1e-9]
    assert np.allclose(np.linalg.norm(whole.T @ modes, axis=0), 1, atol=1e-5)


def test_sparse_modes_of_a_large_assembly():
    """4,452 rows; their dense matrix would hold 20 million numbers."""
    own = sparse.Stiffness(_globule(1484), 8.0)
    assert sum(x.size for x in own.inverse) + sum(x.size for x in own.carry if x is not None) < 4452**2 / 3
    values, modes, residuals = sparse.slowest(own, 6)
    assert len(values) == 6 and residuals.max() <= sparse.MOST_RESIDUAL
    assert np.allclose(np.linalg.norm(own.times(modes) - modes * values, axis=0), 0, atol=1e-6)


def test_sparse_query_equals_dense_modes(spark):
    atoms = structures._globules(spark, SF)
    some = sparse.sparse_network_modes(atoms, "structure", "vec_id", 7.0, 5).toPandas()
    dense = ensemble.network_modes(atoms, "structure", "vec_id", 7.0, 5).toPandas()
    both = some.merge(dense, on=["structure", "mode"])
    assert len(both) == len(dense) == len(some) and np.allclose(both["eigenvalue_x"], both["eigenvalue_y"], atol=1e-8)
    assert all(abs(np.dot(a, b)) > 1 - 1e-5 for a, b in zip(both["vector_x"], both["vector_y"]))


# ridge ---------------------------------------------------------------------------------------------------------------
def _refit(rows, edges, cutoff, alpha, least, least_of_domain, domains):
    """Every row's model from its training rows, fitted anew."""
    sets = {r["id"]: tuple(sorted({e for i, e in edges if i == r["id"]})) for r in rows}
    out = {}
    for t in rows:
        train = {}
        for c in sorted((c for c in rows if c["kind"] == t["kind"]), key=lambda c: c["id"]):
            far = np.hypot(t["x"] - c["x"], t["y"] - c["y"]) > cutoff
            if far and not set(sets[t["id"]]) & set(sets[c["id"]]):
                train.setdefault(sets[c["id"]], c)
        train = list(train.values())
        same = sum(c["domain"] == t["domain"] for c in train)
        if len(train) < least or same < least_of_domain:
            out[t["id"]] = ("insufficient", len(train), same, None, None, None)
            continue
        flags = lambda r: [float(r["domain"] == d) for d in domains]
        x = np.array([[r["f"], r["g"]] for r in train], float)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd[sd < 1e-9] = 1
        design = np.column_stack((np.ones(len(train)), (x - mean) / sd, [flags(r) for r in train]))
        y = np.array([r["t"] for r in train])
        penalty = alpha * np.eye(design.shape[1])
        penalty[0, 0] = 0
        b = np.linalg.solve(design.T @ design / len(train) + penalty, design.T @ y / len(train))
        guess = float(np.concatenate(([1.0], (np.array([t["f"], t["g"]]) - mean) / sd, flags(t))) @ b)
        out[t["id"]] = ("fit", len(train), same, guess, t["t"] - guess, float(((design @ b - y) ** 2).mean()))
    return out


def test_downdated_ridge_equals_refitting(spark):
    random = np.random.default_rng(5)
    domains = ["p", "q", "r"]
    rows = [{"id": i, "kind": "ab"[i % 7 == 0], "domain": domains[i % 3], "x": float(random.integers(0, 12)), "y": float(random.integers(0, 12)), "f": 1000 + float(random.normal()), "g": 3.0 if i % 2 else 4.0, "t": float(random.normal() + i % 3)} for i in range(90)]
    edges = [(i, int(random.integers(0, 60))) for i in range(0, 60) for _ in range(2)]
    edges += [(i, 1000 + (i - 60) // 4) for i in range(60, 80)] * 2  # four rows a set; rows from 80 on have no edges
    for r in rows[60:64]:
        r["x"], r["y"] = 0.0, float(r["id"] - 60)  # and near one another in turn
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, kind string, domain string, x double, y double, f double, g double, t double").repartition(3)
    pairs = spark.createDataFrame([*edges, (5, None)], "id long, edge long")
    got = ridge.ridge_without_neighbours(frame, pairs, key="id", kind="kind", domain="domain", target="t", features=["f", "g"], domains=domains, coordinates=["x", "y"], cutoff=2.5, alpha=0.1, least=12, least_of_domain=2)
    want = _refit(rows, edges, 2.5, 0.1, 12, 2, domains)
    found = {r.id: tuple(r)[1:] for r in got.collect()}
    assert found.keys() == want.keys() and {v[0] for v in want.values()} == {"fit", "insufficient"}
    for i, w in want.items():
        assert found[i][:3] == w[:3], i
        assert (found[i][3:] == (None,) * 3) if w[3] is None else np.allclose(found[i][3:], w[3:], atol=1e-8), i


def test_rows_of_one_place_do_not_meet_row_by_row(spark):
    """F3, F8: rows near one another are left out by their places; pairs of them would be 8 million rows in the shuffle."""
    frame = spark.range(4000).selectExpr("id", "'k' kind", "'p' domain", "id % 2 * 100D x", "0D y", "id % 10 * 1D f", "id % 10 * 2D + 1 t")
    edges = frame.selectExpr("id", "id div 4 edge").union(frame.selectExpr("id", "id + 10000 edge"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(True).head().totalShuffleWrite()
    before = written()
    got = ridge.ridge_without_neighbours(frame, edges, key="id", kind="kind", domain="domain", target="t", features=["f"], domains=["p"], coordinates=["x", "y"], cutoff=3.0, alpha=0.1, least=10, least_of_domain=2)
    # the other place's 2,000 rows, less the two of the row's own edge
    assert [tuple(r) for r in got.groupBy("status", "training_n", "same_domain_n").count().collect()] == [("fit", 1998, 1998, 4000)]
    assert written() - before < 8 << 20


# nulls ---------------------------------------------------------------------------------------------------------------
def _turned(vector, rotation, shift):
    return (np.asarray(vector).reshape(-1, 3) @ rotation.T + shift).ravel().tolist()


def test_rotation_null_turns_with_the_frame(spark):
    random = np.random.default_rng(2)
    points, along, axis, point = random.normal(0, 8, 45), random.normal(size=45), random.normal(size=3), random.normal(size=3)
    rotation = np.linalg.qr(random.normal(size=(3, 3)))[0]
    rotation *= np.linalg.det(rotation)
    shift, none = np.array([5.0, -3.0, 11.0]), np.zeros(3)
    rows = [
        (1, points.tolist(), axis.tolist(), point.tolist(), along.tolist()),
        (2, _turned(points, rotation, shift), _turned(axis, rotation, none), _turned(point, rotation, shift), _turned(along, rotation, none)),
        (3, np.outer(np.arange(15.0), axis).ravel().tolist(), axis.tolist(), [0.0, 0.0, 0.0], along.tolist()),
        (4, points.tolist(), axis.tolist(), point.tolist(), np.tile([1.0, 2.0, 3.0], 15).tolist()),
    ]
    frame = spark.createDataFrame(rows, "k int, v array<double>, a array<double>, p array<double>, d array<double>")
    moving = list(range(6, 15))
    got = resampling.rotation_null(frame, "k", "v", moving, "a", "p", "d", 40, 7).toPandas()
    one, two = (got[got.k == k].sort_values("draw") for k in (1, 2))
    assert len(one) == 41 and np.allclose(one["overlap"], two["overlap"]) and np.allclose(np.stack(one["coefficients"]), np.stack(two["coefficients"]))
    basis = resampling.rotation_basis(points.reshape(-1, 3), np.array(moving), axis, point)
    rigid = geometry.rigid_directions(points.reshape(-1, 3))
    assert np.allclose(basis.T @ basis, np.eye(3)) and np.allclose(rigid.T @ basis, 0)
    inside = along - rigid @ (rigid.T @ along)
    drawn = one[one.draw >= 0]
    assert np.allclose(drawn["overlap"], np.abs(np.stack(drawn["coefficients"]) @ basis.T @ inside) / np.linalg.norm(inside))
    assert np.allclose(np.linalg.norm(np.stack(one["coefficients"]), axis=1), 1)
    # draw -1 is the rotation about the axis itself
    field = np.zeros((15, 3))
    field[moving] = np.cross(axis, points.reshape(-1, 3)[moving] - point)
    field = field.ravel() - rigid @ (rigid.T @ field.ravel())
    away = basis @ np.array(one["coefficients"].iloc[0])
    assert np.allclose(away, field / np.linalg.norm(field))
    status = {r.k: r.status for r in got.itertuples() if r.k > 2}
    assert status[3].startswith("three moving points") and status[4] == "no direction inside"


def test_permuted_null_keeps_the_marginals(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=12).tolist()) for i in range(6)] + [(6, [0.0] * 12)]
    along = random.normal(size=12).tolist()
    frame = spark.createDataFrame(rows, "k int, v array<double>")
    got = resampling.permuted_null(frame, "k", "v", along, 600, 9)
    table = got.toPandas().set_index(["k", "draw"])["overlap"].sort_index()
    again = resampling.permuted_null(frame.repartition(5, "k"), "k", "v", along, 600, 9).toPandas().set_index(["k", "draw"])["overlap"].sort_index()
    assert table.equals(again) and table[6].isna().all()
    fixed = np.array(along) / np.linalg.norm(along)
    for k, v in rows[:6]:
        assert np.isclose(table[k, -1], abs(np.dot(v, fixed)) / np.linalg.norm(v))
    # a vector of distinct values against a unit axis shows which value a draw put there: each its own, all about as often
    axis = [0.0] * 11 + [1.0]
    values = [float(i + 1) for i in range(12)]
    seen = resampling.permuted_null(spark.createDataFrame([(1, values)], "k int, v array<double>"), "k", "v", axis, 1200, 9).where("draw >= 0").toPandas()
    dealt = np.rint(seen["overlap"] * np.linalg.norm(values)).astype(int)
    assert set(dealt) == set(range(1, 13)) and dealt.value_counts().between(60, 145).all()


def test_marginal_null_follows_its_law(spark):
    got = resampling.marginal_null(spark.createDataFrame([("one", 1), ("three", 3), ("many", 300)], "k string, d int"), "k", "d", 20_000, 4).toPandas()
    by = {k: g["overlap"].to_numpy() for k, g in got.groupby("k")}
    assert np.allclose(by["one"], 1)
    assert abs(by["three"].mean() - 0.5) < 0.01 and abs(np.quantile(by["three"], 0.2) - 0.2) < 0.02  # uniform in three dimensions
    assert abs((by["many"] ** 2).mean() * 300 - 1) < 0.03


# boxes ---------------------------------------------------------------------------------------------------------------
def _loop(chain, box):
    out, back = np.array(chain, float), np.linalg.inv(box)
    for i in range(1, len(out)):
        out[i] -= np.round((out[i] - out[i - 1]) @ back) @ box
    return out


def test_chains_in_a_skew_box_equal_a_loop(spark):
    random = np.random.default_rng(8)
    boxes = {1: np.array([[10.0, 0, 0], [3, 9, 0], [-2, 1, 8]]), 2: np.array([[7.0, 1, 2], [0, 6, -1], [1, 1, 9]]), 3: None, 4: np.zeros((3, 3)), 5: np.full((3, 3), np.nan)}
    rows, want = [], {}
    for frame, box in boxes.items():
        laid = {c: random.normal(0, 20, (n, 3)) for c, n in (("a", 12), ("b", 7), ("c", 1))}
        for c, points in laid.items():
            rows += [(frame, c, i, *map(float, p), None if box is None else box.ravel().tolist()) for i, p in enumerate(points)]
        usable = box is not None and np.isfinite(box).all() and abs(np.linalg.det(box)) >= 1e-6
        whole = {c: _loop(p, box) if usable else p for c, p in laid.items()}
        want |= {(frame, c, i): p for c, points in whole.items() for i, p in enumerate(points)}
    frame = spark.createDataFrame(rows, "frame int, chain string, at int, x double, y double, z double, box array<double>").repartition(4)
    got = periodic.unwrapped_chains(frame, ["frame"], "chain", "at", ["x", "y", "z"], "box")
    assert got.columns == frame.columns
    found = {(r.frame, r.chain, r["at"]): (r.x, r.y, r.z) for r in got.collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)
    met = periodic.bodies_together(got, ["frame"], ["x", "y", "z"], "box", F.col("chain") == "b", F.col("chain") == "a").collect()
    for number, box in boxes.items():
        own = {c: np.array([want[k] for k in sorted(want) if k[:2] == (number, c)]) for c in "ab"}
        shift = np.zeros(3)
        if number < 3:
            shift = np.round((own["b"].mean(axis=0) - own["a"].mean(axis=0)) @ np.linalg.inv(box)) @ box
        laid = np.array([(r.x, r.y, r.z) for r in sorted((r for r in met if r.frame == number and r.chain == "b"), key=lambda r: r["at"])])
        assert np.allclose(laid, own["b"] - shift)
        assert np.allclose(sorted((r.x, r.y, r.z) for r in met if r.frame == number and r.chain == "a"), sorted(map(tuple, own["a"])))


# sub-ensembles -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n,d", [(9, 40), (40, 9), (6, 6)])
def test_both_ways_of_components_agree(spark, n, d):
    x = np.random.default_rng(n).normal(size=(n, d)) * np.linspace(3, 1, d) + 50
    frame = spark.createDataFrame([(f"id{i:02}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").repartition(3)
    got = ensemble.subensemble_scores(frame, "id", "v", 3, block=7).toPandas().pivot(index="id", columns="component", values="score").to_numpy()
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = u[:, :3] * s[:3]
    want = want * np.where(want[0] < 0, -1, 1)
    assert np.allclose(got, want) and (got[0] >= 0).all()
    ratio = ensemble.subensemble_scores(frame, "id", "v", 3, block=7).select("component", "variance_ratio").distinct().orderBy("component").toPandas()["variance_ratio"]
    assert np.allclose(ratio, s[:3] ** 2 / (s**2).sum())


def test_components_of_few_and_no_rows(spark):
    frame = spark.createDataFrame([("b", [1.0, 2.0, 5.0]), ("a", [2.0, 0.0, 1.0])], "id string, v array<double>")
    rows = {(r.id, r.component): r.score for r in ensemble.subensemble_scores(frame, "id", "v", 3).collect()}
    half = np.linalg.norm([1.0, -2.0, -4.0]) / 2
    assert rows.keys() == {("a", 1), ("b", 1)} and np.isclose(rows["a", 1], half) and np.isclose(rows["b", 1], -half)
    assert ensemble.subensemble_scores(frame.where("false"), "id", "v", 3).count() == 0


@pytest.mark.parametrize("by", ["id", "study"])
def test_left_out_axes(spark, by):
    random = np.random.default_rng(6)
    rows = [(i, i % 5, ["open", "closed", "other"][i % 4 % 3], random.normal(size=6).tolist()) for i in range(23)]
    rows.append((23, 99, "open", random.normal(size=6).tolist()))
    frame = spark.createDataFrame(rows, "id int, study int, state string, v array<double>").repartition(3)
    fixed = np.ones(6) / np.sqrt(6)
    along = spark.createDataFrame([(fixed.tolist(),)], "axis array<double>")
    got = {r[by]: r for r in ensemble.leave_one_out_axes(frame, by, "v", F.col("state") == "open", F.col("state") == "closed", along).collect()}
    at = 0 if by == "id" else 1
    axis = lambda keep: (lambda g: g / np.linalg.norm(g))(np.mean([r[3] for r in keep if r[2] == "open"], axis=0) - np.mean([r[3] for r in keep if r[2] == "closed"], axis=0))
    whole = axis(rows)
    assert set(got) == {r[at] for r in rows if r[2] != "other"}
    for key, r in got.items():
        keep = [x for x in rows if x[at] != key]
        assert np.allclose(r.axis, axis(keep)) and np.isclose(r.to_whole, axis(keep) @ whole) and np.isclose(r.to_along, abs(axis(keep) @ fixed))
        assert (r.n_first, r.n_second) == tuple(sum(x[2] == s for x in keep) for s in ("open", "closed"))
    lone = frame.where("id = 23 or state = 'closed'")
    assert {r.id: r.status for r in ensemble.leave_one_out_axes(lone, "id", "v", F.col("state") == "open", F.col("state") == "closed").collect()}[23] == "one state"


# modes that nearly share an eigenvalue -------------------------------------------------------------------------------
def test_mixing_near_modes_changes_nothing(spark):
    points = _globule(18, 4)
    values, vectors = np.linalg.eigh(ensemble.hessian(points, 9.0))
    values, vectors = values[6:14], vectors[:, 6:14]
    values = np.array([1.0, 2.0, 2.1, 2.2, 3.5, 5.0, 5.2, 9.0])
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    mixed = vectors.copy()
    mixed[:, 1:4] = vectors[:, 1:4] @ turn
    axis = (vectors[:, 2] + 0.1 * np.sin(np.arange(54)))[:27]
    rows = [(k, m + 1, float(values[m]), v[:, m].tolist()) for k, v in (("plain", vectors), ("mixed", mixed)) for m in range(8)]
    modes = spark.createDataFrame(rows, "k string, mode int, eigenvalue double, vector array<double>")
    where = spark.createDataFrame([(k, points.ravel().tolist()) for k in ("plain", "mixed")], "k string, v array<double>")
    got = {r.k: r for r in assembly.near_best(modes, where, "k", "v", 9, axis.tolist(), ratio=1.2, primary=4).collect()}
    assert got["plain"].near_modes == got["mixed"].near_modes == [2, 3, 4] and np.isclose(got["plain"].near_overlap, got["mixed"].near_overlap)
    assert got["plain"].best_mode == 3 and got["plain"].near_rank == 3
    rigid = geometry.rigid_directions(points[:9])
    inside = lambda v: v - rigid @ (rigid.T @ v)
    basis = np.linalg.qr(inside(vectors[:27, 1:4]))[0]
    assert np.isclose(got["plain"].near_overlap, np.linalg.norm(basis.T @ inside(axis)) / np.linalg.norm(inside(axis)))
    raw = np.abs(axis @ vectors[:27]) / np.linalg.norm(vectors[:27], axis=0) / np.linalg.norm(axis)
    assert np.isclose(got["plain"].best_overlap, raw[2])
    clustered = assembly.eigenvalue_clusters(modes, "k", 1.2)
    assert [r.cluster for r in clustered.where("k = 'plain'").orderBy("mode").collect()] == [1, 2, 2, 2, 3, 4, 4, 5]
    full = np.concatenate((axis, np.zeros(27)))
    one = spark.createDataFrame([((full / np.linalg.norm(full)).tolist(),)], "axis array<double>")
    table = assembly.cluster_overlaps(clustered, "k", one).toPandas().pivot(index="cluster", columns="k", values="overlap")
    assert np.allclose(table["plain"], table["mixed"])


# panels --------------------------------------------------------------------------------------------------------------
def test_panels_without_a_class_or_values(spark):
    rows = [("both", True, 0.9, 1), ("both", True, 0.8, 4), ("both", False, 0.3, 1), ("both", None, 5.0, 1), ("both", True, None, 1), ("mixed", True, 0.2, 2), ("mixed", False, 0.5, 1), ("mixed", True, 0.5, 1), ("lone", True, 0.5, 3), (None, False, 0.1, 1)]
    frame = spark.createDataFrame(rows, "panel string, pos boolean, m double, k int").withColumn("goal", F.lit(0.85))
    got = {r.panel: r for r in panel.separation(frame, ["panel"], F.col("pos"), "m", "k", "goal").collect()}
    both, mixed, lone = got["both"], got["mixed"], got["lone"]
    assert np.isclose(both.threshold, 0.55) and not both.classes_overlap and both.n_positive_below == 0 and both.rank1_fraction == both.target_percentile / 100 == 0.5
    assert mixed.threshold is None and mixed.classes_overlap and mixed.n_positive_below == 1 and mixed.rank3_fraction == 1
    assert lone.threshold is None and not lone.classes_overlap and lone.n_positive_below is None and lone.negative_max is None
    assert got[None].n_positive == 0 and got[None].n_negative == 1 and got[None].rank1_fraction is None


def test_confounds_use_mean_ranks(spark):
    random = np.random.default_rng(9)
    rows = [("p", float(random.integers(0, 6)), float(random.integers(0, 4)), 1.0 if i % 3 else None) for i in range(40)] + [("q", 1.0, 2.0, None)]
    frame = spark.createDataFrame(rows, "panel string, m double, a double, b double")
    got = {(r.panel, r.confound): (r.n, r.rho) for r in panel.confounds(frame, ["panel"], "m", ["a", "b"]).collect()}
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    m, a = (np.array([r[i] for r in rows[:40]]) for i in (1, 2))
    assert got["p", "a"][0] == 40 and np.isclose(got["p", "a"][1], np.corrcoef(ranks(m), ranks(a))[0, 1])
    assert got["p", "b"][0] == 26 and got["p", "b"][1] is None and got["q", "a"] == (1, None) and ("q", "b") not in got


# kept members --------------------------------------------------------------------------------------------------------
def test_only_new_and_changed_members_are_computed(spark, tmp_path):
    folder, seen = str(tmp_path / "kept"), []

    def sums(rows):
        return rows.groupBy("k").agg(F.sum("v").alias("s"))

    def run(rows, fingerprint="one"):
        frame = spark.createDataFrame(rows, "k string, v long").repartition(3)
        results, computed = replay.replayed(spark, folder, frame, "k", sums, fingerprint)
        seen.append({r.k for r in computed.collect()})
        return {r.k: r.s for r in results.collect()}

    first = [("a", 1), ("a", 2), ("b", 5), (None, 7)]
    assert run(first) == {"a": 3, "b": 5, None: 7} and seen[-1] == {"a", "b", None}
    assert run(first[::-1]) == {"a": 3, "b": 5, None: 7} and seen[-1] == set()
    assert run([("a", 1), ("a", 2), ("b", 6), ("c", 1)]) == {"a": 3, "b": 6, "c": 1} and seen[-1] == {"b", "c"}
    assert run(first) == {"a": 3, "b": 5, None: 7} and seen[-1] == set()  # what it was before is still there
    assert run([("a", 1), ("a", 2), ("a", 2)]) == {"a": 5} and seen[-1] == {"a"}
    assert run(first, "two") == {"a": 3, "b": 5, None: 7} and seen[-1] == {"a", "b", None}
    # a run that died after its results and before its manifest leaves nothing that counts
    spark.createDataFrame([("d", 666, "run-dead")], "k string, s long, run string").write.mode("append").partitionBy("run").parquet(f"{folder}/results")
    assert run([("d", 4)]) == {"d": 4} and seen[-1] == {"d"}


# bundles -------------------------------------------------------------------------------------------------------------
def _npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def _zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, raw in files:
            z.writestr(name, raw)
    return out.getvalue()


def test_both_layouts_give_one_table(spark, tmp_path):
    one, two = np.arange(6.0).reshape(2, 3), np.arange(4)
    packed = io.BytesIO()
    np.savez(packed, left=one, right=two)
    files = [("data/one.npy", _npy(one)), ("data/more.npz", packed.getvalue()), ("data/readme.txt", b"no array")]
    for name, raw in files:
        target = tmp_path / "plain" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(raw)
    (tmp_path / "packed.zip").write_bytes(_zipped(files))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "content")
    got = {(r.bundle, r["member"], r["name"]): (r.shape, r["values"]) for r in binary.bundle_arrays(found, ["one.npy", "more.npz"]).collect()}
    parts = {("one.npy", "one"): ([2, 3], one.ravel().tolist()), ("more.npz", "left"): ([2, 3], one.ravel().tolist()), ("more.npz", "right"): ([4], two.astype(float).tolist())}
    assert got == {(b, *k): v for b in ("plain", "packed") for k, v in parts.items()}


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_faulty_bundles_are_errors(spark):
    raw = _npy(np.zeros(2))
    flagged = bytearray(_zipped([("data/a.npy", raw)]))
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        flagged[flagged.find(mark) + at] |= 1
    faults = {
        "missing": [("s/x.zip", _zipped([("data/b.npy", raw)]))],
        "twice": [("s/x.zip", _zipped([("data/a.npy", raw), ("data/a.npy", raw)]))],
        "encrypted": [("s/x.zip", bytes(flagged))],
        "both layouts": [("s/x.zip", _zipped([("data/a.npy", raw)])), ("s/x/data/a.npy", raw)],
        "plain twice": [("s/x/data/a.npy", raw), ("t/x/data/a.npy", raw)],
    }
    for name, files in faults.items():
        frame = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
        with pytest.raises(Exception, match="holds|encrypted|bundle x has"):
            binary.bundle_arrays(frame, ["a.npy"]).collect()
            pytest.fail(name)


def test_queries_without_sql_have_rows_by_structure(spark):
    for name in ("sparse_network_modes", "ridge_shared_edges"):
        frame = registry.queries()[name](spark, SF)
        assert frame.count() > 0
    assert registry.queries()["sparse_network_modes"](spark, SF).where("not settled").count() == 0


# chains, contacts and series -----------------------------------------------------------------------------------------
def test_extra_springs_are_added_once():
    points = _globule(30, 2)
    points[:10] += 40
    chain = [(i, i + 1) for i in range(29)] + [(5, 4), (20, 20)]
    near = {(i, j) for i in range(30) for j in range(i + 1, 30) if np.linalg.norm(points[i] - points[j]) <= 6.0}
    plain = np.zeros((90, 90))
    for i, j in near | {(i, i + 1) for i in range(29)}:
        gap = points[j] - points[i]
        block = np.outer(gap, gap) / (gap @ gap) * (6.0 / np.linalg.norm(gap)) ** 2
        for a, b, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
            plain[3 * a : 3 * a + 3, 3 * b : 3 * b + 3] += sign * block
    assert np.allclose(ensemble.hessian(points, 6.0, 2.0, extra=chain), plain)
    assert np.allclose(sparse.Stiffness(points, 6.0, 2.0, extra=chain[:-1]).times(np.eye(90)), plain)


def test_blocks_equal_the_longest_match_rule(spark):
    import difflib

    random = np.random.default_rng(12)
    rows = []
    for k in range(60):
        a = "".join(random.choice(list("ABC"), random.integers(0, 60)))
        b = "".join(a[i : i + n] for i, n in zip(random.integers(0, max(1, len(a)), 6), random.integers(1, 14, 6))) + "".join(random.choice(list("ABC"), 8))
        rows.append((k, a, b))
    rows += [(100, None, "AAAA"), (101, "AAA", "AAA"), (102, "ABCDE" * 12, "ABCDE" * 9)]
    frame = spark.createDataFrame(rows, "k int, a string, b string").repartition(4)
    got = sorted(tuple(r) for r in integrity.sequence_blocks(frame, "k", "a", "b", least=4, anchor=9).collect())
    want = []
    for k, a, b in rows:
        blocks = [m for m in difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_matching_blocks() if m.size >= 4]
        if blocks and max(m.size for m in blocks) >= 9:
            want += [(k, m.a + 1, m.b + 1, m.size) for m in blocks]
    assert got == sorted(want) and len({r[0] for r in got}) > 20


def test_nearest_of_far_off_rows_and_groups(spark):
    random = np.random.default_rng(13)
    left = [(i, "g" if i % 2 else "h", *map(float, random.normal(0, 30 if i % 5 else 3000, 3))) for i in range(80)] + [(90, "alone", 1.0, 1.0, 1.0), (91, "g", None, 0.0, 0.0)]
    right = [(i, "g" if i % 3 else "h", *map(float, random.normal(0, 20, 3))) for i in range(70)] + [(70, "g", 1.0, 2.0, 3.0), (71, "g", 1.0, 2.0, 3.0)]
    a = spark.createDataFrame(left, "id int, k string, x double, y double, z double").repartition(3)
    b = spark.createDataFrame(right, "to int, k string, x double, y double, z double")
    for groups in ([], ["k"]):
        got = {r.id: (r.nearest_id, r.min_distance, r.n_within) for r in joins.nearest(a, b, "id", "to", [(c, c) for c in "xyz"], 8.0, groups=groups).collect()}
        assert set(got) == {r[0] for r in left} - {91}
        for i, k, *p in left[:-1]:
            met = [(float(np.linalg.norm(np.subtract(p, q))), to) for to, g, *q in right if not groups or g == k]
            if not met:
                assert got[i] == (None, None, 0)
                continue
            assert got[i][0] == min(met)[1] and np.isclose(got[i][1], min(met)[0]) and got[i][2] == sum(d <= 8.0 for d, _ in met)
    assert joins.nearest(a, b.where("false"), "id", "to", [("x", "x")], 8.0).count() == 0


@pytest.mark.parametrize("block", [4, 1 << 12])
def test_crowded_cells_meet_in_tiles(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "_BLOCK", block)
    random = np.random.default_rng(4)
    p, q = random.integers(0, 3, (30, 2)).astype(float), random.integers(0, 3, (40, 2)).astype(float)
    a, b = (spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], f"{name} long, x double, y double") for rows, name in ((p, "id"), (q, "to")))
    got = {r.id: (r.nearest_id, r.min_distance, r.n_within) for r in joins.nearest(a, b, "id", "to", [(c, c) for c in "xy"], 5.0).collect()}
    r = np.linalg.norm(p[:, None] - q[None], axis=2)
    assert got == {i: (int(x.argmin()), x.min(), int((x <= 5).sum())) for i, x in enumerate(r)}


def test_tiles_hold_no_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(joins, "_BLOCK", 16)
    cell = spark.range(200).selectExpr("id as _id", "0L as c0", "cast(id as double) as a_x0"), spark.range(100).selectExpr("id as _to", "0L as c0", "cast(id as double) as b_x0")
    sizes = spark.createDataFrame([(0, 200, 100)], "c0 long, _na long, _nb long")
    found = joins._crowded(*cell, sizes, ["c0"], 1, 5.0).collect()
    assert len(found) == 200 * 7 and sum(r["_k"] for r in found) == sum(abs(i - j) <= 5 for i in range(200) for j in range(100))


def test_series_correlation_by_plain_sums(spark):
    random = np.random.default_rng(14)
    x = np.cumsum(random.normal(size=50))
    y = x * 0.5 + np.cumsum(random.normal(size=50))
    rows = [("walk", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("walk", 99, None, 1.0)]
    rows += [("flat", i, 1.0, float(i)) for i in range(5)] + [("same", i, float(i * i % 7), float(i * i % 7)) for i in range(9)] + [("one", 0, 1.0, 2.0)]
    got = {r.k: r for r in statistics.series_correlation(spark.createDataFrame(rows, "k string, i int, x double, y double").repartition(3), ["k"], ["i"], "x", "y").collect()}
    ranks = lambda v: np.argsort(np.argsort(v)).astype(float)
    lag = lambda v: float(((v - v.mean())[:-1] * (v - v.mean())[1:]).sum() / ((v - v.mean()) ** 2).sum())
    rho, a, b = np.corrcoef(ranks(x), ranks(y))[0, 1], lag(x), lag(y)
    n = 50 * (1 - a * b) / (1 + a * b)
    t = rho * np.sqrt((n - 2) / (1 - rho**2))
    r = got["walk"]
    assert r.n == 50 and np.allclose([r.rho, r.lag_x, r.lag_y, r.n_effective, r.t], [rho, a, b, n, t])
    grid = np.linspace(abs(t), abs(t) + 4000, 4_000_001)  # the tail by plain integration
    density = (1 + grid**2 / (n - 2)) ** (-(n - 1) / 2)
    whole = np.linspace(0, abs(t) + 4000, 4_000_001)
    assert abs(r.p - np.trapezoid(density, grid) / np.trapezoid((1 + whole**2 / (n - 2)) ** (-(n - 1) / 2), whole)) < 1e-4
    assert got["flat"].t is None and got["flat"].p is None and got["one"].p is None
    assert got["same"].t is None and got["same"].p == 0.0


def test_census_of_absent_and_far_partners(spark):
    receptor = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 1.0, 0.0)], "s string, id int, x double, y double")
    partners = spark.createDataFrame([("s", "near", 10, 0.0, 2.0), ("s", "near", 11, 0.0, 90.0), ("s", "far", 12, 500.0, 0.0), ("t", "alone", 13, 0.0, 0.0)], "s string, role string, id int, x double, y double")
    got = {r.role: tuple(r)[2:] for r in joins.partner_census(receptor, partners, ["s"], "role", "id", ["x", "y"], 2.5).collect()}
    assert got["near"] == (2, 2.0, 2, True) and got["far"] == (1, 499.0, 0, False) and got["alone"] == (1, None, 0, False)


def test_gaps_in_a_chain_are_no_pairs(spark):
    rows = [("f", "a", i, float(x)) for i, x in ((1, 0.0), (2, 3.8), (4, 4.0), (5, 6.0), (6, 20.0))] + [("f", "b", 1, 0.0)]
    got = {r.chain: tuple(r)[2:] for r in windows.adjacent_distances(spark.createDataFrame(rows, "f string, chain string, i int, x double"), ["f"], "chain", "i", ["x"]).collect()}
    assert got["a"] == (3, 2.0, 14.0, 1, 1) and got["b"] == (0, None, None, 0, 0)


def test_all_rotations_of_a_chain(spark):
    random = np.random.default_rng(15)
    rows = [("a", i, float(random.normal()) if i != 4 else None, bool(i in (2, 3, 4, 9))) for i in range(17)] + [("none", i, 1.0, False) for i in range(3)] + [("all", i, 1.0, True) for i in range(3)]
    got = {r.k: tuple(r)[1:] for r in windows.circular_shift(spark.createDataFrame(rows, "k string, i int, v double, m boolean").repartition(2), ["k"], "i", "v", F.col("m")).collect()}
    v = np.array([np.nan if r[2] is None else r[2] for r in rows[:17]])
    m = np.array([r[3] for r in rows[:17]])
    gaps = [np.nanmean(v[np.roll(m, s)]) - np.nanmean(v[~np.roll(m, s)]) for s in range(17)]
    assert np.allclose(got["a"], (gaps[0], 17, np.mean(np.abs(gaps) >= abs(gaps[0]) - 1e-12))) and "none" not in got and got["all"] == (None, 3, None)


# assemblies, restated from springs -----------------------------------------------------------------------------------
def _matrix(points, cutoff, kept):
    """Springs between points within reach, one by one, where ``kept(i, j)``."""
    out = np.zeros((3 * len(points), 3 * len(points)))
    for i in range(len(points)):
        for j in range(i + 1, len(points)):
            gap = points[j] - points[i]
            if gap @ gap <= cutoff**2 and kept(i, j):
                u = gap / np.linalg.norm(gap)
                column = np.zeros(3 * len(points))
                column[3 * i : 3 * i + 3], column[3 * j : 3 * j + 3] = u, -u
                out += np.outer(column, column)
    return out


def _modes(matrix, k):
    values, vectors = np.linalg.eigh(matrix)
    at = np.flatnonzero(values > 1e-9)[:k]
    return values[at], vectors[:, at]


def _rigid(points, bodies):
    """Translations and rotations of each body, orthonormal."""
    columns = []
    for body in bodies:
        for e in np.eye(3):
            for field in (np.tile(e, (len(body), 1)), np.cross(points[body] - points[body].mean(axis=0), e)):
                whole = np.zeros_like(points)
                whole[body] = field
                columns.append(whole.ravel())
    return np.linalg.qr(np.array(columns).T)[0]


def test_assembly_measures_restated(spark):
    points, n, cutoff, k = _globule(26, 21), 15, 8.0, 12
    axis = np.sin(np.arange(3 * n) + 1.0)
    axis /= np.linalg.norm(axis)
    frame = spark.createDataFrame([(1, points.ravel().tolist())], "k int, v array<double>")
    joint = _matrix(points, cutoff, lambda i, j: True)
    values, vectors = _modes(joint, k)
    # what each joint mode is made of
    bodies, own = _rigid(points, [np.arange(n), np.arange(n, 26)]), _rigid(points[:n], [np.arange(n)])
    got = assembly.mode_character(frame, "k", "v", n, axis.tolist(), cutoff, k).orderBy("mode").collect()
    for r, value, v in zip(got, values, vectors.T, strict=True):
        part = v[: 3 * n]
        inner = part - own @ (own.T @ part)
        rigid = np.linalg.norm(bodies.T @ v)
        want = [value, rigid, np.sqrt(1 - rigid**2), np.linalg.norm(part), abs(part @ axis) / np.linalg.norm(part), abs(inner @ axis) / np.linalg.norm(inner)]
        assert np.allclose([r.eigenvalue, r.rigid_content, r.internal, r.amplitude, r.raw_overlap, r.internal_overlap], want, atol=1e-8)
    # ranks of the mode that follows the axis: alone, with the partner out of contact, and in contact
    _, free = _modes(_matrix(points[:n], cutoff, lambda i, j: True), k)
    _, decoy = _modes(_matrix(points, cutoff, lambda i, j: (i < n) == (j < n)), k)
    rank = lambda v: int(np.argmax(np.round(np.abs(v[: 3 * n].T @ axis), 12))) + 1
    ranks = [rank(x) for x in (free, decoy, vectors)]
    shift = assembly.rank_shifts(frame, "k", "v", n, axis.tolist(), cutoff, k).first()
    assert [shift.free_rank, shift.decoy_rank, shift.joint_rank, shift.size_effect, shift.contact_effect] == [*ranks, ranks[1] - ranks[0], ranks[2] - ranks[1]]
    assert shift.displacing == sum(np.abs(decoy.T @ vectors[:, m]).max() < 0.5 for m in range(ranks[2] - 1))
    # compliance along the axis, the partner condensed by hand, against directions drawn without a basis
    cut = 3 * n
    small = joint[:cut, :cut] - joint[:cut, cut:] @ np.linalg.inv(joint[cut:, cut:]) @ joint[cut:, :cut]
    inside = np.eye(cut) - own @ own.T
    give = np.linalg.pinv(inside @ small @ inside, rcond=1e-9)
    mean = np.trace(give) / (cut - 6)
    along = lambda d: (d @ give @ d) / (d @ inside @ d) / mean
    drawn = np.array([along(x) for x in np.random.default_rng(3).standard_normal((800, cut))])
    stats = assembly.directional_statistics(frame, "k", "v", n, axis.tolist(), cutoff, 800, 3).first()
    assert np.isclose(stats.specificity, along(axis))
    assert np.allclose([stats.p05, stats.p50, stats.p95], np.quantile(drawn, [0.05, 0.5, 0.95]))
    assert np.isclose(stats.percentile, 100 * (drawn < along(axis)).mean())


def test_contacts_of_two_plans_differ_where_they_should(spark):
    """A plan that loses a contact shows."""
    rows = [(1, i, float(x), 0.0, 0.0) for i, x in enumerate((0.0, 1.0, 2.04, 3.04))]
    frame = spark.createDataFrame(rows, "f int, p int, x double, y double, z double")
    found = joins.contacts(frame, "p", ["x", "y", "z"], 1.02, groups=["f"]).select("f", "i", "j")
    again = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "f int, i int, j int")
    assert [tuple(r) for r in integrity.recomputed_differences(found, again).collect()] == [(1, 1, 2, "second")]


def test_signed_angles_of_known_turns(spark):
    from axisframe.functions import vectors

    axis = np.array([1.0, -2.0, 0.5])
    axis /= np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    turns = [0.0, 30.0, -75.0, 179.0, -179.0]
    rows = [(t, (np.eye(3) + np.sin(np.radians(t)) * k + (1 - np.cos(np.radians(t))) * k @ k).ravel().tolist(), axis.tolist()) for t in turns]
    frame = spark.createDataFrame(rows, "t double, r array<double>, a array<double>")
    assert all(abs(r.t - r.angle) < 1e-9 for r in frame.withColumn("angle", vectors.signed_angle_about(F.col("r"), F.col("a"))).collect())


def test_curation_rules_by_sets(spark):
    from axisframe.operators import rules

    window = list(range(20))
    seen = {("whole", "A"): window, ("whole", "B"): window[:3], ("ends", "A"): window[2:18], ("hole", "A"): [p for p in window if p != 9], ("other", "A"): window[:15], ("other", "B"): window, ("poor", "A"): window, ("none", "A"): [99]}
    residues = spark.createDataFrame([(s, c, p) for (s, c), own in seen.items() for p in own] + [("whole", "A", 0)], "structure string, chain string, position int")
    structures = spark.createDataFrame([("whole", 1.0, "A"), ("ends", 1.0, "A"), ("hole", 1.0, "A"), ("other", 1.0, "A"), ("poor", None, "A"), ("none", 1.0, "A")], "structure string, resolution double, primary string")
    asked = [{"name": "plain", "ceiling": 2.0}, {"name": "share", "coverage": 0.95, "ceiling": 2.0}, {"name": "drop", "drop": (9,)}, {"name": "ends", "terminal": True, "ceiling": 2.0}, {"name": "best", "chain": "best", "ceiling": 2.0}, {"name": "any"}, {"name": "nothing", "ceiling": 0.5}]
    kept = rules.curated(residues, structures, window, asked, slack=2)
    got = {}
    for r in kept.collect():
        got.setdefault(r.variant, set()).add((r.structure, r.chain))
    assert got == {
        "plain": {("whole", "A")},
        "share": {("whole", "A"), ("hole", "A")},
        "drop": {("whole", "A"), ("hole", "A"), ("poor", "A")},
        "ends": {("whole", "A"), ("ends", "A")},
        "best": {("whole", "A"), ("other", "B")},
        "any": {("whole", "A"), ("poor", "A")},
    }
    common = {r.variant: (r.n_structures, r.n_positions) for r in rules.common_positions(kept, residues, asked).collect()}
    assert common == {"plain": (1, 20), "share": (2, 19), "drop": (3, 19), "ends": (2, 16), "best": (2, 20), "any": (2, 20)}


# how work is passed on ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name,slow", [("mapped_ranges", "MapInPandas"), ("near_best_modes", "FlatMapCoGroupsInPandas")])
def test_structures_and_texts_are_rows_of_batches(spark, name, slow):
    frame = registry.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # parsed texts come from a written table; a structure's modes are one row, not a group of its own
    assert slow not in plan
    assert frame.count() > 0


def test_files_of_a_batch_leave_together(spark):
    raw = structures._members(np.arange(64.0))
    files = spark.createDataFrame([(f"s/b{i}/{n}", x) for i in range(40) for n, x in raw.items()], "path string, content binary").coalesce(1)
    got = binary.bundle_arrays(files, ["half.npy", "table.npz"])
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 120
    assert {(r.name, sum(r["values"])) for r in got.collect()} == {("half", 496.0), ("square", 2016.0), ("first", 0.0)}
    made = registry.queries()["density_voxels"](spark, SF)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString() and made.count() == 22 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


@pytest.mark.parametrize("block", [4, 1 << 12])
def test_census_of_one_table_with_itself(spark, monkeypatch, block):
    """receptor and partners are rows of one table, whose group's column is then the same on both sides."""
    monkeypatch.setattr(joins, "_BLOCK", block)
    random = np.random.default_rng(21)
    rows = [(s, i + 12 * s, i, *map(float, random.uniform(0, 9, 2))) for s in range(5) for i in range(12)]
    points = spark.createDataFrame(rows, "s int, id int, p int, x double, y double")
    partners = points.where("p >= 5").withColumn("role", F.when(F.col("p") < 8, "near").otherwise("far"))
    got = {(r.s, r.role): tuple(r)[2:] for r in joins.partner_census(points.where("p < 5"), partners, ["s"], "role", "id", ["x", "y"], 3.0).collect()}
    for s in range(5):
        at = np.array([r[3:] for r in rows if r[0] == s])
        apart = np.linalg.norm(at[5:, None] - at[None, :5], axis=2)
        for role, d in (("near", apart[:3]), ("far", apart[3:])):
            assert got.pop((s, role)) == (len(d), pytest.approx(d.min()), int((d <= 3.0).sum()), bool(d.min() <= 3.0))
    assert not got
