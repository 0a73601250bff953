"""Numeric operators against plain numpy restatements and invariances."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.operators import assembly as A
from axisframe.operators import ensemble as E
from axisframe.operators import geometry as G
from axisframe.operators import mechanics as M
from axisframe.operators import resampling as R
from axisframe.operators import statistics as N
from axisframe.plans import numeric, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def points(v):
    return np.append(v * 20, [0.0, 0.0]).reshape(-1, 3)


def answer(spark, name):
    return registry.queries()[name](spark, SF).collect()


def spin(axis, degrees):
    a, t = np.asarray(axis, float) / np.linalg.norm(axis), math.radians(degrees)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def springs(p, near):
    """Plain double loop: [(i, j, r)]."""
    out = []
    for i, j in itertools.combinations(range(len(p)), 2):
        r = float(np.sqrt(((p[i] - p[j]) ** 2).sum()))
        if 1e-6 < r <= near:
            out.append((i, j, r))
    return out


def network(p, edges, weights):
    h = np.zeros((3 * len(p), 3 * len(p)))
    for (i, j, r), w in zip(edges, weights):
        u = (p[i] - p[j]) / r
        b = w * np.outer(u, u)
        for a, c, s in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
            h[3 * a : 3 * a + 3, 3 * c : 3 * c + 3] += s * b
    return h


# ensembles -----------------------------------------------------------------------------------------------------------
def test_components_and_scores(spark, vectors):
    x = np.stack([vectors[i] for i in sorted(vectors)])
    w, v = np.linalg.eigh(np.cov(x.T))
    got = answer(spark, "principal_components")
    assert np.allclose([r.eigenvalue for r in got], w[::-1][:10], atol=2e-6) and np.allclose([r.variance_ratio for r in got], w[::-1][:10] / w.sum(), atol=2e-6)
    scores = {(r.vec_id, r.component): r.score for r in answer(spark, "component_scores")}
    for c in range(3):
        mine = (x - x.mean(axis=0)) @ v[:, -1 - c]
        theirs = np.array([scores[i, c + 1] for i in sorted(vectors)])
        assert min(np.abs(theirs - mine).max(), np.abs(theirs + mine).max()) < 1e-6


def least_rmsd(a, b):
    """From singular values alone, without building a rotation."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
    return math.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a)))


def test_superposition(spark, vectors):
    first = points(vectors[min(vectors)])
    for r in answer(spark, "superposition"):
        assert abs(r.rmsd - least_rmsd(points(vectors[r.vec_id]), first)) < 2e-6


def test_iterative_superposition_settles(spark, vectors):
    frame = spark.createDataFrame([(i, [float(x) for x in (points(vectors[0]) @ spin([1, 2, 3], 7 * i)).ravel()]) for i in range(12)], "vec_id long, v array<double>")
    laid, mean = E.iterative_superposition(frame, "v", rounds=20)
    assert max(r.rmsd for r in laid.collect()) < 1e-6 and least_rmsd(np.reshape(mean, (-1, 3)), points(vectors[0])) < 1e-6
    assert len(answer(spark, "iterative_superposition")) == len(vectors)


def test_network_modes(spark, vectors):
    anm, gnm = ({}, {})
    for name, into in (("network_modes", anm), ("gaussian_network_modes", gnm)):
        for r in answer(spark, name):
            into.setdefault(r.vec_id, []).append((r.mode, r.eigenvalue))
    overlap = {(r.vec_id, r.mode): r.overlap for r in answer(spark, "mode_overlaps")}
    shared = {r.vec_id: r.rmsip for r in answer(spark, "subspace_overlap")}
    moves = {(r.vec_id, r.residue): r.fluctuation for r in answer(spark, "square_fluctuations")}
    label = {r.vec_id: r.label for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()}
    gap = np.mean([vectors[i] for i in vectors if label[i] == 0], axis=0) - np.mean([vectors[i] for i in vectors if label[i]], axis=0)
    axis = np.append(gap / np.linalg.norm(gap), [0, 0])
    for i in sorted(vectors)[:12]:
        p = points(vectors[i])
        slow = []
        for near in (8.0, 9.0):
            edges = springs(p, near)
            w, v = np.linalg.eigh(network(p, edges, [1.0] * len(edges)))
            slow.append((w[w > 1e-9], v[:, w > 1e-9]))
        (w, v), (_, u) = slow
        assert np.allclose([x for _, x in sorted(anm[i])], w[:6], atol=2e-6)
        if np.diff(w[:6]).min() > 1e-4:
            assert np.allclose([overlap[i, m] for m in range(1, 6)], np.abs(v[:, :5].T @ axis), atol=2e-6)
            assert abs(shared[i] - math.sqrt(((v[:, :5].T @ u[:, :5]) ** 2).sum() / 5)) < 2e-6 or np.diff(slow[1][0][:6]).min() < 1e-4
            ten = (v[:, :10] ** 2 / w[:10]).sum(axis=1).reshape(-1, 3).sum(axis=1)
            assert np.allclose([moves[i, k] for k in range(22)], ten, rtol=1e-4, atol=1e-4) or np.diff(w[:11]).min() < 1e-4
        k = np.zeros((22, 22))
        for a, b, _ in springs(p, 6.0):
            k[a, b] = k[b, a] = -1
        k -= np.diag(k.sum(axis=1))
        values = np.linalg.eigvalsh(k)
        assert np.allclose([x for _, x in sorted(gnm[i])], values[values > 1e-9][:4], atol=2e-6)


def test_modes_of_arrays_equal_modes_of_atoms(spark):
    frame = spark.range(3).select(F.col("id").alias("vec_id")).join(numeric._conformers(spark, SF), "vec_id")
    atoms = numeric._atoms(spark, SF).where("vec_id < 3")
    a = E.vector_modes(frame, "vec_id", "v", 8.0, 5).orderBy("vec_id", "mode").collect()
    b = E.network_modes(atoms, "vec_id", "res", 8.0, 5).orderBy("vec_id", "mode").collect()
    assert np.allclose([r.eigenvalue for r in a], [r.eigenvalue for r in b])


# mechanics -----------------------------------------------------------------------------------------------------------
def _cloud(spark, seed=3, n=(8, 7), flat=False):
    random = np.random.default_rng(seed)
    p = random.uniform(0, 6, (sum(n), 3))
    if flat:
        p[: n[0], 1:] = 0
    rows = [("s", i, "receptor" if i < n[0] else "partner", *map(float, p[i]), 1.0, 0.1 * i, math.sin(i)) for i in range(len(p))]
    nodes = spark.createDataFrame(rows, "system string, node int, body string, x double, y double, z double, dx double, dy double, dz double")
    grid = spark.createDataFrame([("s", 7.0, "inverse_square", "c")], "system string, cutoff double, weighting string, condition string")
    return p, nodes, grid


def _plain_ln_s(p, n, edges, weights, state, direction):
    """ln S from dense matrices: the receptor's compliance is a block of the inverse over all free motions."""
    if state == "isolated":
        keep = [k for k, (i, j, _) in enumerate(edges) if i < n and j < n]
        edges, weights = [edges[k] for k in keep], [weights[k] for k in keep]
    h = network(p, edges, weights)
    centred = p[:n] - p[:n].mean(axis=0)
    rigid = np.array([np.tile(e, n) for e in np.eye(3)] + [np.cross(e, centred).ravel() for e in np.eye(3)]).T
    inner = np.linalg.svd(rigid, full_matrices=True)[0][:, 6:]
    other = p[n:] - p[n:].mean(axis=0)
    free = {"isolated": np.zeros((3 * len(other), 0)), "fixed": np.zeros((3 * len(other), 0)), "flexible": np.eye(3 * len(other))}.get(state)
    if free is None:
        free = np.array([np.tile(e, len(other)) for e in np.eye(3)] + [np.cross(e, other).ravel() for e in np.eye(3)]).T
    t = np.zeros((3 * len(p), inner.shape[1] + free.shape[1]))
    t[: 3 * n, : inner.shape[1]], t[3 * n :, inner.shape[1] :] = inner, free
    g = np.linalg.inv(t.T @ h @ t)[: inner.shape[1], : inner.shape[1]]
    q = inner.T @ direction
    q /= np.linalg.norm(q)
    return math.log(q @ g @ q / (np.trace(g) / len(g)))


def test_states_effects_and_derivatives_against_reassembly(spark):
    p, nodes, grid = _cloud(spark)
    n, table = 8, M.spring_table(nodes, grid)
    edges = springs(p, 7.0)
    weights = [(15 / r) ** 2 for *_, r in edges]
    direction = np.array([[1.0, 0.1 * i, math.sin(i)] for i in range(n)]).ravel()
    states = {r.state: r for r in M.partner_states(table, nodes, grid).collect()}
    for s in M.STATES:
        assert states[s].status == "ok" and abs(math.log(states[s].s_close) - _plain_ln_s(p, n, edges, weights, s, direction)) < 1e-8
    effects = M.group_effects(table, nodes, grid, factors=(0.5, 0.9, 1.1)).collect()
    slopes = {(r.group_id, r.state): r for r in M.group_derivatives(table, nodes, grid).collect()}
    seen = 0
    for r in effects:
        node, kind = r.group_id.split(":")
        own = [k for k, (i, j, _) in enumerate(edges) if int(node) in (i, j) and kind == ("interface" if (i < n) != (j < n) else "receptor_receptor")]
        changed = [w * r.factor if k in own else w for k, w in enumerate(weights)]
        assert r.status == "ok" and abs(r.log_s - _plain_ln_s(p, n, edges, changed, r.state, direction)) < 1e-7
        if r.factor == 0.9:
            low, high = ([w * f if k in own else w for k, w in enumerate(weights)] for f in (1 - 1e-5, 1 + 1e-5))
            slope = (_plain_ln_s(p, n, edges, high, r.state, direction) - _plain_ln_s(p, n, edges, low, r.state, direction)) / 2e-5
            assert abs(slopes[r.group_id, r.state].d_log_s - slope) < 1e-6 and slopes[r.group_id, r.state].n_springs == len(own)
            seen += 1
    assert seen == len(slopes) > 0
    assert all(r.passed and r.status == "ok" for r in M.order_checks(table, nodes, grid).collect())
    assert all(r.gap < 1e-8 for r in M.response_checks(table, nodes, grid).collect())
    d_g = M.central_difference(M.group_effects(table, nodes, grid, factors=(0.9, 1.1))).collect()
    by = {(r.group_id, r.state, r.factor): r.log_s for r in effects} | {(r.group_id, r.state, 0.9): r.log_s for r in effects if r.factor == 0.9}
    assert all(abs(r.d_g - (by[r.group_id, r.state, 1.1] - by[r.group_id, r.state, 0.9]) / 0.2) < 1e-9 for r in d_g)
    deltas = M.role_deltas(M.group_derivatives(table, nodes, grid), "d_log_s").first()
    assert abs(deltas.delta_total - (slopes[deltas.group_id, "flexible"].d_log_s - slopes[deltas.group_id, "isolated"].d_log_s)) < 1e-12
    contrast = M.role_contrasts(M.partner_states(table, nodes, grid)).first()
    assert abs(contrast.r_total - math.log(states["flexible"].s_close / states["isolated"].s_close)) < 1e-9


def test_unsolvable_conditions_keep_their_rows(spark):
    _, nodes, grid = _cloud(spark, flat=True)
    table = M.spring_table(nodes, grid)
    assert {r.status for r in M.partner_states(table, nodes, grid).collect()} == {"degenerate: points in one line"}
    assert all(r.log_s is None and r.status.startswith("degenerate") for r in M.group_effects(table, nodes, grid).collect())
    p, nodes, grid = _cloud(spark, seed=5, n=(8, 3))
    loose = M.spring_table(nodes, grid).where("edge_type <> 'partner_partner' or i % 2 = 0").where("edge_type <> 'interface' or j = 8")
    status = {r.state: r.status for r in M.partner_states(loose, nodes, grid).collect()}
    assert status["isolated"] == "ok" and status["flexible"] == "singular partner block"
    kept = {(r.state, r.status, r.log_s is None) for r in M.group_effects(loose, nodes, grid, factors=(0.9,)).collect()}
    assert ("isolated", "ok", False) in kept and ("flexible", "singular partner block", True) in kept


def test_loose_groups_of_held_atoms_are_checked_like_others(spark):
    p, nodes, grid = _cloud(spark, seed=5, n=(8, 3))
    # two atoms of three springs each, five in all: a motion of both stretches none; receptor's node 0 has no spring at all
    hinge = M.spring_table(nodes, grid.withColumn("cutoff", F.lit(1e3))).where("i > 0 and j < 10 or i in (1, 2, 3, 4) and j = 10")
    hinge = hinge.where("j < 8 or j = 10 or (i, j) in ((8, 9), (1, 8), (2, 8), (3, 9), (4, 9))")
    assert {(r.state, r.gap is not None and r.gap < 1e-9) for r in M.response_checks(hinge, nodes, grid).collect()} == {("rigid", True), ("flexible", True)}
    assert {(r.softer, r.status) for r in M.order_checks(hinge, nodes, grid).collect()} == {("isolated", "ok"), ("flexible", "ok"), ("rigid", "ok")}
    loose = hinge.where("(i, j) <> (4, 9)")
    assert {(r.state, r.gap is None) for r in M.response_checks(loose, nodes, grid).collect()} == {("rigid", False), ("flexible", True)}
    assert {(r.softer, r.status) for r in M.order_checks(loose, nodes, grid).collect()} == {("isolated", "unsolvable"), ("flexible", "unsolvable"), ("rigid", "ok")}


def test_queries_of_states(spark):
    ok = {(r.condition, r.state) for r in answer(spark, "partner_states") if r.status == "ok"}
    effects = answer(spark, "spring_effects")
    assert all((r.d_g is not None) == ((r.condition, r.state) in ok) for r in effects) and ok
    roles = answer(spark, "partner_role_contrasts")
    assert sum(r.r_total is not None for r in roles) == sum((c, "flexible") in ok and (c, "isolated") in ok for c in {r.condition for r in roles})


# statistics ----------------------------------------------------------------------------------------------------------
def test_cosine_tail_by_integration(spark):
    for d in (3, 8, 64):
        t = np.linspace(0, math.pi, 200_001)
        density = np.sin(t) ** (d - 2)
        for c in (0.0, 0.1, 0.35, 0.8):
            want = density[np.abs(np.cos(t)) >= c].sum() / density.sum()
            got = spark.range(1).select(N.cosine_tail(d, F.lit(c)).alias("p")).first().p
            assert abs(got - want) < 2e-4
    mean, sd = N.cosine_moments(64)
    x = np.abs(np.random.default_rng(1).standard_normal((200_000, 64)))
    x = x[:, 0] / np.linalg.norm(x, axis=1)
    assert abs(mean - x.mean()) < 1e-3 and abs(sd - x.std()) < 1e-3


def test_correlation_p_by_integration(spark):
    for rho, n in ((0.0, 10), (0.3, 12), (-0.7, 8), (0.05, 200)):
        t = abs(rho) * math.sqrt((n - 2) / (1 - rho**2))
        x = np.linspace(0, 1, 400_001)[:-1]  # t = x / (1 - x) covers the half line
        density = (1 + (x / (1 - x)) ** 2 / (n - 2)) ** (-(n - 1) / 2) / (1 - x) ** 2
        want = density[x / (1 - x) >= t].sum() / density.sum()
        assert abs(spark.range(1).select(N.correlation_p(F.lit(rho), F.lit(n)).alias("p")).first().p - want) < 1e-4
    assert spark.range(1).select(N.correlation_p(F.lit(1.0), F.lit(5)).alias("p")).first().p == 0
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    for r in answer(spark, "rank_correlation_p"):
        own = [(p.p_size, p.p_retailprice) for p in part if p.p_brand == r.p_brand]
        rank = lambda v: [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]
        if len(own) > 2:
            assert r.n == len(own) and abs(r.rho - np.corrcoef(rank([a for a, _ in own]), rank([b for _, b in own]))[0, 1]) < 1e-5


def test_sampled_null_against_its_distribution(spark):
    r = answer(spark, "sampled_direction_null")[0]
    mean, sd = N.cosine_moments(64)
    assert r.n_draws == 5000 and abs(r.null_mean - mean) < 4 * sd / 70 and abs(r.null_sd - sd) < 0.005


def test_rank_sum_by_enumeration(spark):
    rows = spark.read.parquet(f"{SF}/supplier.parquet").collect()
    for r in answer(spark, "rank_sum_exact"):
        values = [(x.s_acctbal, x.s_suppkey % 2 == 0) for x in rows if x.s_nationkey == r.s_nationkey]
        n1, n2 = sum(f for _, f in values), sum(not f for _, f in values)
        assert (r.n1, r.n2) == (n1, n2)
        if n1 and n2:
            rank = [sum(w < v for w, _ in values) + (sum(w == v for w, _ in values) + 1) / 2 for v, _ in values]
            seen = sum(k for k, (_, f) in zip(rank, values) if f)
            all_ = [sum(c) for c in itertools.combinations(rank, n1)]
            assert abs(r.p_greater - np.mean([s >= seen - 1e-9 for s in all_])) < 2e-6


def test_fisher_by_counting(spark):
    for r in answer(spark, "fisher_exact"):
        row, column, n = r.a + r.b, r.a + r.c, r.a + r.b + r.c + r.d
        if not 0 < row < n or not 0 < column < n:
            assert r.p_two_sided is None
            continue
        chance = lambda x: math.comb(row, x) * math.comb(n - row, column - x) / math.comb(n, column)
        low, high = max(0, row + column - n), min(row, column)
        want = sum(c for x in range(low, high + 1) if (c := chance(x)) <= chance(r.a) * (1 + 1e-7))
        assert abs(r.p_two_sided - want) < 2e-6


def test_ridge_by_normal_equations(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    for r in answer(spark, "ridge_left_out"):
        own = next(p for p in part if p.p_brand == r.p_brand and p.p_partkey == r.place)
        train = [p for p in part if p.p_brand == r.p_brand and abs(p.p_partkey - own.p_partkey) > 10]
        assert r.n == len(train) and (r.status == "ok") == (len(train) >= 5)
        if r.status != "ok":
            continue
        f = lambda p: [float(p.p_size), math.sin(p.p_partkey)]
        x, y = np.array([f(p) for p in train]), np.array([p.p_retailprice for p in train])
        mean, sd = x.mean(axis=0), np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
        m = np.column_stack((np.ones(len(x)), (x - mean) / sd, [float(p.p_size > 25) for p in train]))
        b = np.linalg.solve(m.T @ m / len(m) + 0.1 * np.diag([0.0, 1, 1, 1]), m.T @ y / len(m))
        want = np.concatenate(([1.0], (np.array(f(own)) - mean) / sd, [float(own.p_size > 25)])) @ b
        assert abs(r.predicted - want) < 1e-3


def test_bootstrap_and_set_null(spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").collect()
    for r in answer(spark, "cluster_bootstrap"):
        mean = np.mean([c.c_acctbal for c in customers if c.c_mktsegment == r.c_mktsegment])
        assert r.low < mean < r.high
    values = np.random.default_rng(4).normal(size=60)
    frame = spark.createDataFrame([*enumerate(map(float, values)), (60, None)], "i int, v double").repartition(3)
    for block_rows in (7, 4096):
        r = N.matched_set_null(frame, "i", "v", F.col("i") < 12, 2000, 7, block_rows=block_rows).first()
        assert r.n_draws == 2000 and abs(r.observed - values[:12].mean()) < 1e-9
        sd = values.std(ddof=1) * math.sqrt((1 - 12 / 60) / 12)  # without return
        assert abs(r.null_mean - values.mean()) < 5 * sd / math.sqrt(2000) and abs(r.null_sd / sd - 1) < 0.08
        assert np.allclose(r, N.matched_set_null(frame.repartition(5), "i", "v", F.col("i") < 12, 2000, 7, block_rows=block_rows).first())
    assert N.matched_set_null(frame, "i", "v", F.col("i") < 60, 50, 7, block_rows=7).first().null_sd < 1e-9
    none = N.matched_set_null(frame, "i", "v", F.lit(False), 50, 7).first()
    assert none.observed is None and none.n_draws == 0


# geometry ------------------------------------------------------------------------------------------------------------
def test_screw_of_a_known_motion(spark):
    p = np.random.default_rng(1).uniform(-5, 5, (9, 3))
    axis, point = np.array([2.0, -1, 3]) / math.sqrt(14), np.array([1.0, 2, 0.5])
    for degrees, rise in ((35.0, 1.5), (179.999, -2.0), (0.01, 0.3), (0.0, 0.0)):
        q = (p - point) @ spin(axis, degrees).T + point + rise * axis
        frame = spark.createDataFrame([(1, p.ravel().tolist(), q.ravel().tolist())], "k int, v array<double>, w array<double>")
        r = G.body_motions(frame, "v", "w").first()
        assert r.rmsd < 1e-6 and abs(r.angle_deg - degrees) < 1e-4
        if degrees:
            assert np.allclose(r.axis, axis, atol=1e-5) and abs(r.rise - rise) < 1e-4
            away = np.array(r.point) - point
            assert np.linalg.norm(away - (away @ axis) * axis) < 1e-2
        cosines = [x.cosine for x in G.chord_against_tangent(frame, "k", "v", "w").collect()]
        if degrees == 0.01:
            assert min(cosines) > 0.9999
        if degrees == 35.0:
            assert 0.9 < min(cosines) <= 1.0 + 1e-12


def test_rigid_content_domains_and_constraints(spark):
    random = np.random.default_rng(2)
    p = random.uniform(0, 9, (10, 3))
    move = np.where(np.arange(10)[:, None] < 4, np.cross([0.1, 0.2, 0.3], p), [1.0, 0, 0.5])
    frame = spark.createDataFrame([(1, p.ravel().tolist(), move.ravel().tolist()), (2, p.ravel().tolist(), [0.0] * 30)], "k int, v array<double>, m array<double>")
    got = {r.k: r.rigid_content for r in G.rigid_content(frame, "v", "m", [4]).collect()}
    assert abs(got[1] - 1) < 1e-12 and got[2] is None
    assert G.rigid_content(frame, "v", "m", []).first().rigid_content < 0.99
    q = p.copy()
    q[4:] += [8.0, 0, 0]
    both = spark.createDataFrame([(1, p.ravel().tolist(), q.ravel().tolist())], "k int, v array<double>, w array<double>")
    domains = [r.domain for r in G.dynamic_domains(both, "k", "v", "w", 2).orderBy("residue").collect()]
    assert domains == [0] * 4 + [1] * 6
    basis = G.rigid_directions(p, [np.arange(5), np.arange(5, 10)])
    tied, kept = G.equal_displacement(basis, 4, 5), G.equal_distance(basis, p, 4, 5)
    assert np.allclose(tied[12:15], tied[15:18]) and np.allclose((kept[15:18] - kept[12:15]).T @ (p[5] - p[4]), 0)
    assert (basis.shape[1], tied.shape[1], kept.shape[1]) == (12, 9, 11)
    with pytest.raises(ValueError):
        G.equal_distance(basis, np.zeros((10, 3)), 4, 5)


def test_principal_angles_of_known_planes(spark):
    a, t = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]], math.radians(30)
    b = [[math.cos(t), 0.0, math.sin(t), 0.0], [0.0, 0.0, 0.0, 1.0]]
    frame = spark.createDataFrame([(a, b), (a, a)], "a array<array<double>>, b array<array<double>>")
    got = [r.angles_deg for r in G.principal_angles(frame, "a", "b").collect()]
    assert np.allclose(got[0], [30, 90]) and np.allclose(got[1], [0, 0], atol=1e-5)


def test_frame_metrics_of_a_turning_body(spark):
    random = np.random.default_rng(4)
    mean = random.uniform(0, 9, (12, 3))
    rows = []
    for t in range(4):
        p = mean.copy()
        centre = p[8:].mean(axis=0)
        p[8:] = (p[8:] - centre) @ spin([1, 0, 1], 10 * t).T + centre + [0, 0.5 * t, 0]
        rows.append(("a", t, (p @ spin([0, 1, 2], 33 * t).T + t).ravel().tolist()))
    frame = spark.createDataFrame(rows, "k string, t int, v array<double>").repartition(3)
    got = G.frame_metrics(frame, "k", "t", "v", mean.ravel().tolist(), [1 / 6] * 36, 0.0, 2.0, (4, 8)).orderBy("t").collect()
    for t, r in enumerate(got):
        assert abs(r.anchor_rmsd) < 1e-6 and abs(r.rotation_deg - 10 * t) < 1e-4 and abs(r.translation - 0.5 * t) < 1e-6 and r.internal_rmsd < 1e-6
    assert abs(got[0].closure) < 1e-9 and got[0].core_rmsd < 1e-6


# assemblies and resamples --------------------------------------------------------------------------------------------
def test_assignment_is_the_best_of_all():
    random = np.random.default_rng(6)
    for n in (1, 2, 5, 6):
        for _ in range(5):
            gain = random.uniform(size=(n, n))
            best = max(sum(gain[i, c[i]] for i in range(n)) for c in itertools.permutations(range(n)))
            to = A.assignment(gain)
            assert sorted(to) == list(range(n)) and abs(gain[np.arange(n), to].sum() - best) < 1e-12


def test_assemblies_against_plain_matrices(spark):
    p = np.random.default_rng(9).uniform(0, 7, (14, 3))
    n, near, axis = 8, 8.0, np.linspace(-1, 1, 24) / np.linalg.norm(np.linspace(-1, 1, 24))
    frame = spark.createDataFrame([(1, p.ravel().tolist())], "k int, v array<double>")
    edges = springs(p, near)
    across = [(i < n) != (j < n) for i, j, _ in edges]
    slow = lambda s: (lambda w: w[w > 1e-9][:5])(np.linalg.eigvalsh(network(p, edges, [s if c else 1.0 for c in across])))
    got = A.continuation(frame, "k", "v", n, near, [1.0, 0.5, 0.5], 5).collect()
    for s in (1.0, 0.5):
        assert np.allclose(sorted({round(r.eigenvalue, 9) for r in got if r.strength == s}), slow(s), atol=1e-8)
    assert all(abs(r.overlap - 1) < 1e-6 for r in got[10:]) and [r.branch for r in got[5:10]] == [r.branch for r in got[10:]]
    assert A.two_level_condensation(frame, "k", "v", 5, n, near).first().gap < 1e-8
    ladder = A.partner_ladder(frame, "k", "v", [n, 14], axis.tolist(), near, 5).orderBy("step").collect()
    h = network(p, edges, [1.0] * len(edges))
    w = np.linalg.eigvalsh(h[:24, :24] - h[:24, 24:] @ np.linalg.pinv(h[24:, 24:]) @ h[24:, :24])
    assert ladder[0].stiffening == 1.0 and abs(ladder[1].soft - w[w > 1e-9][0]) < 1e-8
    character = A.mode_character(frame, "k", "v", n, axis.tolist(), near, 4).collect()
    assert all(abs(r.rigid_content**2 + r.internal**2 - 1) < 1e-9 and 0 <= r.amplitude <= 1 for r in character)
    shift = A.rank_shifts(frame, "k", "v", n, axis.tolist(), near, 8).first()
    assert shift.size_effect == shift.decoy_rank - shift.free_rank and shift.contact_effect == shift.joint_rank - shift.decoy_rank
    stats = A.directional_statistics(frame, "k", "v", n, axis.tolist(), near, 400, 3).first()
    assert stats.p05 <= stats.p50 <= stats.p95 and 0 <= stats.percentile <= 100


def test_draws_do_not_depend_on_the_basis(spark):
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((9, 4)))[0]
    turned = basis @ np.linalg.qr(np.random.default_rng(2).standard_normal((4, 4)))[0]
    a, b = (np.array([r.direction for r in R.subspace_draws(spark, x, 30, 8, parts=k).orderBy("draw").collect()]) for x, k in ((basis, 3), (turned, 7)))
    assert np.allclose(a, b)
    with pytest.raises(ValueError):
        R.subspace_draws(spark, 2 * basis, 3, 1)
    for r in answer(spark, "random_subspace_null"):
        assert r.n == 400 and abs(r.mean - math.sqrt(8 / 64)) < 0.01
    sizes = spark.createDataFrame([("all", 4, 4), ("line", 3, 1)], "name string, d int, k int")
    got = {}
    for r in R.random_subspace_overlaps(sizes, "name", "d", "k", 4000, 2).collect():
        got.setdefault(r.name, []).append(r.rmsip)
    assert np.allclose(got["all"], 1) and abs(np.mean(got["line"]) - 0.5) < 0.02  # of a direction in space: uniform


def test_resamples_know_clusters_by_order(spark):
    random = np.random.default_rng(3)
    rows = [(f"{c}{i}", c, bool(i % 2), [float(x) for x in random.standard_normal(4) + i % 2]) for c in "abcdef" for i in range(3)]
    frame = spark.createDataFrame(rows, "id string, c string, open boolean, v array<double>")
    renamed = frame.withColumn("c", F.concat(F.lit("z"), "c")).repartition(5)
    one, two = (sorted(map(tuple, R.axis_resamples(f, "c", "v", "open", 100, 5).collect())) for f in (frame, renamed))
    assert [r[:2] for r in one] == [r[:2] for r in two] and np.allclose([r[2] for r in one], [r[2] for r in two])
    cut = sorted(map(tuple, R.axis_resamples(frame, "id", "v", "open", 4000, 5, block_rows=4).collect()))
    v, first = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    gap = lambda w: (v * (w * first)[:, None]).sum(0) / (w * first).sum() - (v * (w * ~first)[:, None]).sum(0) / (w * ~first).sum()
    whole, plain = gap(np.ones(18)), []
    for i in range(4000):  # plain draws of ids with return: the same law
        w = np.bincount(np.random.default_rng([1, i]).integers(0, 18, 18), minlength=18).astype(float)
        if (w * first).sum() and (w * ~first).sum():
            plain.append(gap(w) @ whole / np.linalg.norm(gap(w)) / np.linalg.norm(whole))
    drawn = [r[2] for r in cut if r[1] == "ok"]
    assert abs(np.mean(drawn) - np.mean(plain)) < 0.02 and abs(np.quantile(drawn, 0.1) - np.quantile(plain, 0.1)) < 0.06
    every = R.axis_resamples(frame.where("id not like '%2'"), "id", "v", "open", 20, 5, balanced=6, block_rows=4).collect()
    assert all(r.status == "ok" and abs(r.overlap - 1) < 1e-12 for r in every)  # six of six of each state
    alone = frame.where("not open or c = 'a'")
    assert {r.status for r in R.axis_resamples(alone, "id", "v", "open", 200, 5).collect()} == {"ok", "one state"}
    assert {r.status for r in R.axis_resamples(alone, "id", "v", "open", 20, 5, balanced=5).collect()} == {"one state"}
    got = {r.subset: r for r in answer(spark, "subset_overlap")}
    assert abs(got["all"].rmsip - 1) < 1e-6 and 0 < got["even"].rmsip < 1


def test_guinier_stretch_ends_at_the_limit_itself(spark):
    q = [0.004 + 0.001 * i for i in range(1, 97)]
    rows = [(0, x, 0.42 * math.exp(-((x * 20) ** 2) / 3), 0.001) for x in q] + [(0, 0.2, 0.0, 0.001), (0, 0.3, None, 0.001)]
    frame = spark.createDataFrame(rows, "k int, q double, i double, s double")
    (got,) = N.guinier(frame, ["k"], "q", "i", "s", most_qrg=1.3, least_points=5).collect()
    assert got.n_points == 61 and abs(got.q_max - 0.065) < 1e-12 and abs(got.rg - 20) < 1e-6 and abs(got.i0 - 0.42) < 1e-9
    assert N.guinier(frame.limit(0), ["k"], "q", "i", "s", most_qrg=1.3, least_points=5).count() == 0


def test_groups_of_springs_solved_side_by_side():
    """Groups of several sizes, filled up to the largest, equal a full solution with the scaled springs; also a factor of one."""
    from axisframe.operators import mechanics as M

    r = np.random.default_rng(4)
    points = r.normal(size=(10, 3)) * 4
    i, j = np.triu_indices(10, 1)
    weight = r.uniform(0.5, 2.0, len(i))
    c = M.Condition(points, 6, i, j, weight, r.normal(size=18))
    groups = [np.array([0]), np.array([3, 9, 30]), np.array([1, 2, 5, 40, 44])]
    for state in M.STATES:
        got = c.updated(c.prepared(state), groups, (0.5, 1.0, 2.0))
        for row, at in zip(got, groups, strict=True):
            for found, factor in zip(row, (0.5, 1.0, 2.0), strict=True):
                scaled = weight.copy()
                scaled[at] *= factor
                assert found == pytest.approx(np.log(c.compliance(c.stiffness(state, scaled))[2]), abs=1e-9)
    assert c.updated(c.prepared("rigid"), [], (0.5, 2.0)).shape == (0, 2)


def test_matched_controls_of_null_values_and_many_values(spark):
    """Against every pair of rows; a null value is a control under nobody and stands over none, and isn't its own control."""
    from axisframe.operators import statistics as N

    rows = [(i, "ab"[i % 2], (i * 7) % 12, None if i % 13 == 0 else float((i * 5) % 9)) for i in range(80)] + [(80, "c", 3, 1.0), (81, None, 3, 1.0)]
    got = {r["id"]: r for r in N.matched_controls(spark.createDataFrame(rows, "id long, label string, n int, v double"), "id", "label", "n", "v", caliper=0.2, least=4).collect()}
    assert len(got) == len(rows)
    for i, label, n, v in rows:
        near = [r for r in rows if label is not None and r[1] == label and r[0] != i and abs(r[2] - n) <= 0.2 * n]
        exact = [r for r in near if r[2] == n]
        tier, use = ("exact", exact) if len(exact) >= 4 else ("caliper", near) if len(near) >= 4 else ("insufficient", near)
        under = sum(0.0 if v is None or r[3] is None or r[3] > v else 0.5 if r[3] == v else 1.0 for r in use)
        assert (got[i]["tier"], got[i]["n_controls"]) == (tier, len(use))
        assert got[i]["percentile"] == (None if tier == "insufficient" else pytest.approx(100 * under / len(use)))


def test_ridge_left_out_goes_by_blocks(spark):
    """No task gets a group: rows of several blocks, at their edges and at one place, equal a fit of each row's training rows."""
    from axisframe.operators import statistics as N

    r = np.random.default_rng(3)
    places = [*r.integers(0, 9000, 60).tolist(), 2047, 2048, 2050, 2050, 4096, 4098]
    rows = [("g", float(p), float(r.normal() + 50), float(r.normal()), 1.0) for p in places] + [("g", None, 1.0, 2.0, 1.0), ("h", 1.0, 2.0, 3.0, 1.0)]
    frame = spark.createDataFrame(rows, "g string, place double, y double, x double, d double")
    found = N.ridge_left_out(frame, ["g"], "y", ["x"], ["d"], "place", radius=2.0, alpha=0.1, least=5)
    assert "_block" in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((o["g"], o["place"], o["status"], o["n"], o["predicted"]) for o in found.collect() if o["status"] == "ok"))
    assert sorted((o["g"], o["place"], o["n"]) for o in found.where("status <> 'ok'").collect() if o["place"] is not None) == [("h", 1.0, 0)]
    want = []
    for g, p, y, x, d in rows[:-2]:
        t = np.array([q[2:] for q in rows[:-2] if abs(q[1] - p) > 2.0])
        mean, sd = t[:, 1].mean(), t[:, 1].std()
        a = (t[:, 1] - mean) / sd
        c = (a * (t[:, 0] - t[:, 0].mean())).mean() / ((a * a).mean() + 0.1)
        want.append((g, p, "ok", len(t), pytest.approx(t[:, 0].mean() + c * (x - mean) / sd)))
    assert len(got) == len(want)
    for one, other in zip(got, sorted(want, key=lambda w: (w[1], w[4].expected)), strict=True):
        assert one == other


@pytest.mark.parametrize("block", [4096, 7])
def test_pairs_of_vectors_by_blocks(spark, monkeypatch, block):
    """One block and several: copies, near copies, a null, a hole and a shorter vector; only bits and values leave a task."""
    from axisframe.operators import joins as J

    monkeypatch.setattr(J, "_BLOCK", block)
    r = np.random.default_rng(8)
    vectors = [(i, r.normal(size=5).tolist()) for i in range(40)]
    vectors += [(40, vectors[3][1]), (41, [x + 1e-9 for x in vectors[4][1]]), (42, [x * 1.5 for x in vectors[3][1]])]
    frame = spark.createDataFrame([*vectors, (50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [1.0, 2.0])], "id long, v array<double>")
    apart = {(i, j): math.dist(v, w) for i, v in vectors for j, w in vectors if i < j}
    got = {(p.i, p.j): p.r for p in J.vector_contacts(frame, "id", "v", 2.0, least=-1.0).collect()}
    assert got == {k: pytest.approx(d, rel=1e-7, abs=1e-13) for k, d in apart.items() if d <= 2.0}
    s = J.vector_pair_statistics(frame, "id", "v").first()
    assert (s["n"], s["median"], s["max"], s["mean"]) == (len(apart), pytest.approx(np.median(list(apart.values()))), pytest.approx(max(apart.values())), pytest.approx(np.mean(list(apart.values()))))
    assert J.vector_pair_statistics(frame.where("id < 1"), "id", "v").first().asDict() == {"median": None, "max": None, "mean": None, "n": 0}


def test_pairs_are_worked_out_once(spark, monkeypatch):
    """bounds from a sample hold the median, so one round over all pairs does; bounds that don't hold it are drawn anew."""
    from axisframe.operators import joins as J

    monkeypatch.setattr(J, "_BLOCK", 64)
    monkeypatch.setattr(J, "_FEW", 100, raising=False)
    rounds, pairs, bounds = [], J._vector_pairs, []
    monkeypatch.setattr(J, "_vector_pairs", lambda *a: rounds.append(1) or pairs(*a))
    r = np.random.default_rng(9)
    vectors = [*r.normal(size=(300, 6)), *[np.ones(6)] * 30, *r.normal(size=(20, 3)) * 2, np.full(6, 1e200), np.full(6, np.nan)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    with np.errstate(over="ignore"):
        apart = np.array([np.sqrt(((v - w) ** 2).sum()) for i, v in enumerate(vectors) for w in vectors[:i] if len(v) == len(w)])
    apart = apart[~np.isnan(apart)]
    want = (len(apart), pytest.approx(np.median(apart), rel=1e-12), np.inf, np.inf)
    got = J.vector_pair_statistics(frame, "id", "v").first()
    assert (got["n"], got["median"], got["max"], got["mean"]) == want and len(rounds) == 1
    found = J._about_the_median(frame, "id", "v", 12.0)
    assert found[0] < np.median(apart) < found[1] and np.mean((apart >= found[0]) & (apart <= found[1])) < 0.4
    monkeypatch.setattr(J, "_about_the_median", lambda *a: bounds.append(a[-1]) or [(0.0, 0.5), (9.0, np.inf), (-np.inf, np.inf)][len(bounds) - 1])
    got = J.vector_pair_statistics(frame.where("id < 350"), "id", "v").first()
    apart = apart[np.isfinite(apart)]
    assert (got["n"], got["median"], got["max"], got["mean"]) == (len(apart), pytest.approx(np.median(apart)), pytest.approx(apart.max()), pytest.approx(apart.mean()))
    assert bounds == sorted(bounds) and len(set(bounds)) == 3


def test_row_products_by_tiles(spark, monkeypatch):
    """Several tiles of rows and blocks of components; ids that aren't their places."""
    monkeypatch.setattr(E, "_TILE", 4)
    x = np.random.default_rng(6).normal(size=(11, 10)) + 3
    frame = spark.createDataFrame([(int(100 - 7 * i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r.i, r.j): r.g for r in E.row_products(frame, "id", "v", block=3).collect()}
    y = (x - x.mean(axis=0))[::-1]
    assert got == {(i, j): pytest.approx(y[i] @ y[j], abs=1e-9) for i in range(11) for j in range(i, 11)}


def test_products_leave_their_task_whole(spark, monkeypatch):
    """no product is shuffled, only blocks of vectors are; more tiles than rows fill, and few products at once."""
    monkeypatch.setattr(E, "_TILE", 1)
    monkeypatch.setattr(E, "_OUT", 3)
    x = np.random.default_rng(16).normal(size=(13, 7)) + 5
    frame = E.row_products(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(3), "id", "v", block=2)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("InArrow")]
    got, y = frame.collect(), x.astype(np.float32).astype(float)
    y = y - y.mean(axis=0)
    assert len(got) == 13 * 14 / 2
    assert {(r.i, r.j): r.g for r in got} == {(i, j): pytest.approx(y[i] @ y[j], abs=1e-9) for i in range(13) for j in range(i, 13)}


def test_rank_sums_of_large_groups_equal_their_counts(spark):
    """120 rows, 90 with ties, and 1,000, whose table of counts would never be done and whose sum is all but normal."""
    random = np.random.default_rng(4)
    values = {"vast": random.permutation(1000) / 3, "large": random.permutation(120) / 3, "tied": random.integers(0, 12, 90) * 1.0}
    rows = [(g, float(x), bool(random.integers(0, 2) or x > 300)) for g, v in values.items() for x in v]
    got = {r.g: r for r in N.rank_sum(spark.createDataFrame(rows, "g string, v double, f boolean"), ["g"], "v", F.col("f")).collect()}
    for g, v in values.items():
        first = np.array([r[2] for r in rows if r[0] == g])
        doubled = np.array([int(2 * (v < x).sum() + (v == x).sum() + 1) for x in v])
        n1, seen = int(first.sum()), int(doubled[first].sum())
        if g == "vast":
            z = (seen / 2 - 0.5 - n1 * 1001 / 2) / math.sqrt(n1 * (1000 - n1) * 1001 / 12)
            assert abs(got[g].p_greater - math.erfc(z / math.sqrt(2)) / 2) < 1e-4
            continue
        ways = np.zeros((n1 + 1, int(np.sort(doubled)[-n1:].sum()) + 1))
        ways[0, 0] = 1
        for i, r in enumerate(doubled):
            k = min(n1, i + 1)
            ways[1 : k + 1, r:] += ways[:k, : ways.shape[1] - r].copy()
            ways /= ways.max() if i % 20 == 0 else 1  # counts to a common factor
        chance, s = ways[n1] / ways[n1].sum(), np.arange(ways.shape[1])
        middle = doubled.sum() * n1 / len(v)
        assert (got[g].n1, got[g].u) == (n1, seen / 2 - n1 * (n1 + 1) / 2)
        assert abs(got[g].p_greater - chance[seen:].sum()) < 1e-9
        assert abs(got[g].p_two_sided - chance[abs(s - middle) >= abs(seen - middle) - 1e-9].sum()) < 1e-9
