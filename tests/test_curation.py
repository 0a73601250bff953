"""Curation with reasons, panels, connectivity, signs and fitted fields against plain restatements."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from axisframe.functions import vectors as V
from axisframe.operators import ensemble, geometry, graph, resampling, rules, selection
from axisframe.operators.gates import GateError
from axisframe.sources import text


# bands ---------------------------------------------------------------------------------------------------------------
def test_bands_part_at_the_widest_of_the_first_gaps(spark):
    values = [*range(20), 40.0, 43.0, None]
    rows = [("many", float(v) if v is not None else None) for v in values] + [("one", 1.0), (None, 1.0), (None, 9.0), ("flat", 2.0), ("flat", 2.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.asDict() for r in rules.gap_bands(frame, ["g"], "v").collect()}
    assert set(got) == {"many", None, "flat"}
    low = np.arange(20.0)
    assert (got["many"]["n_closed"], got["many"]["n_open"], got["many"]["closed_max"], got["many"]["open_min"]) == (20, 2, 19.0, 40.0)
    assert np.isclose(got["many"]["closed_mean"], low.mean()) and np.isclose(got["many"]["closed_sd"], low.std())
    assert (got[None]["closed_max"], got[None]["open_min"]) == (1.0, 9.0)
    assert (got["flat"]["n_closed"], got["flat"]["n_open"]) == (0, 2)
    # with one gap looked at, the widest lies elsewhere
    assert rules.gap_bands(frame.where("g = 'many'"), ["g"], "v", first_gaps=1).first()["n_open"] == 1


def test_band_calls_state_their_reason(spark):
    bands = rules.gap_bands(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 20.0)], "g string, v double"), ["g"], "v")
    rows = [(1, "a", 4.0, True), (2, "a", 4.1, True), (3, "a", 19.0, True), (4, "a", 2.0, False), (5, "b", 2.0, True), (6, "a", None, True), (7, "a", 2.0, None), (8, None, 2.0, True)]
    got = {r.i: r for r in rules.band_calls(spark.createDataFrame(rows, "i int, g string, v double, there boolean"), bands, ["g"], "v", present=F.col("there")).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["closed", "intermediate", "open", *["indeterminate"] * 5]
    assert got[1].reason == "4.00 A is in the closed band 1.00 to 3.00, z +2.0" and got[1].z == 2.0
    assert got[2].reason == "4.10 A is between the closed band's end 3.00 and the open band's start 20.00"
    assert got[3].reason == "19.00 A is in the open band 20.00 to 20.00, z +17.0"
    assert got[4].reason == got[7].reason != got[5].reason == got[6].reason == got[8].reason


def test_fragments_leave_structures_with_a_whole_entity(spark):
    rows = [("s", "s_1", 5), ("s", "s_1", 30), ("s", "s_2", 3), ("t", "t_1", None), ("u", "u_1", 20)]
    got = sorted(map(tuple, rules.fragment_filter(spark.createDataFrame(rows, "s string, e string, n int"), "s", "e", "n", 20).collect()))
    assert got == [("s", 2, 1, 3, True), ("t", 1, 1, 0, False), ("u", 1, 0, 20, True)]


# panels and texts ----------------------------------------------------------------------------------------------------
def test_panel_records(spark):
    frame = spark.createDataFrame([(1, [1.0, None], "n"), (2, [], None), (3, None, "x")], "i int, a array<double>, notes string")
    got = selection.panel_records(frame, "p", "bar", each="a", identifier=F.col("i"), notes=F.col("notes")).collect()
    assert list(got[0].asDict()) == list(selection.PANEL) and len(selection.PANEL) == 14
    assert [(r.identifier, r["index"], r.value, r.notes) for r in got] == [("1", 0, 1.0, "n"), ("1", 1, None, "n")]
    with pytest.raises(ValueError):
        selection.panel_records(frame, "p", "bar", width=F.lit(1))


def test_table_titles(spark):
    body = "x\r\n  Table S1. Fit by SPR and ITC \nTable S2 Thermal\nTable S1. again\nTable S3.\nTable S4. other\nsee Table S5. SAXS"
    got = sorted(map(tuple, text.table_titles(spark.createDataFrame([("p", body), ("q", None), ("r", "")], "path string, text string")).collect()))
    assert got == [("p", "S1", "Table S1. Fit by SPR and ITC", "binding_spr", 1), ("p", "S2", "Table S2 Thermal", "folding_dsf", 2), ("p", "S4", "Table S4. other", "", 5)]


def test_canonical_json_is_that_of_python(spark):
    ddl = "b struct<z:double,a:array<int>>, a map<string,double>, c string"
    values = [(((1.5, [2, None])), {"y": 1.0, "x": 2.0}, 'é"'), (None, None, None)]
    frame = spark.createDataFrame([(v,) for v in values], f"v struct<{ddl.replace(' struct', ':struct').replace(' map', ':map').replace('c string', 'c:string')}>")
    got = [r[0] for r in frame.select(V.canonical_json(F.col("v"), frame.schema["v"].dataType)).collect()]
    plain = [{"a": {"x": 2.0, "y": 1.0}, "b": {"a": [2, None], "z": 1.5}, "c": 'é"'}, {"a": None, "b": None, "c": None}]
    assert got == [json.dumps(p, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for p in plain]
    bad = spark.createDataFrame([((float("nan"),),)], "v struct<x:double>")
    with pytest.raises(PySparkException):
        bad.select(V.json_hash(F.col("v"), bad.schema["v"].dataType)).collect()


# networks ------------------------------------------------------------------------------------------------------------
def test_connectivity_counts_lone_nodes_and_cut_receptors(spark):
    nodes = spark.createDataFrame([("x", i, i < 3) for i in range(5)] + [("y", 0, True), ("y", 1, True), ("z", 0, True)], "s string, node int, receptor boolean")
    edges = [("x", 0, 3, 1.0), ("x", 3, 1, 1.0), ("x", 1, 3, 2.0), ("x", 1, 2, 1.0), ("x", 4, 4, 1.0), ("y", 0, 1, None)]
    got = graph.connectivity(nodes, spark.createDataFrame(edges, "s string, a int, b int, weight double"), "s")
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("x", 3, 2, True, 2, 2, False), ("y", 1, 0, False, 1, 1, True), ("z", 0, 0, True, 1, 1, True)]
    with pytest.raises(GateError, match="x: 2 components"):
        graph.require_networks(got, "s")
    assert graph.require_networks(got.where("s <> 'x'"), "s").count() == 2
    # large networks by rounds, small ones in a row each, alike
    made = spark.createDataFrame(edges + [("x", 0, 9, -1.0), ("q", 0, 1, 1.0)], "s string, a int, b int, weight double")
    for largest in (0, 2, 1000):
        assert sorted(map(tuple, graph.connectivity(nodes, made, "s", largest=largest).collect())) == rows


def test_small_networks_need_no_rounds(spark, monkeypatch):
    nodes = spark.range(60).selectExpr("id div 6 as s", "id as node", "id % 2 = 0 as receptor")
    edges = spark.range(59).selectExpr("id div 6 as s", "id as a", "id + 1 as b", "1.0D as weight")
    monkeypatch.setattr(graph, "components", None)
    assert {tuple(r)[1:] for r in graph.connectivity(nodes, edges, "s").collect()} == {(5, 5, True, 1, 3, False)}


# components and fields -----------------------------------------------------------------------------------------------
def test_scores_turn_to_the_far_side(spark):
    x = np.random.default_rng(2).gamma(1.0, size=(40, 6)) * np.array([-5, 3, 1, 1, 1, 1])
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>")
    scores, components = ensemble.scaled_scores(frame, "i", "v", ensemble.principal_components(frame, "v", 3), 2)
    got = scores.toPandas().pivot(index="i", columns="component", values="score").to_numpy()
    centred = x - x.mean(axis=0)
    for c, loading in components.orderBy("component").select("component", "loading").collect():
        own = centred @ np.array(loading)
        assert own.max() >= abs(own.min()) and np.allclose(got[:, c - 1], own / np.sqrt(2))
        assert np.allclose(np.cov(centred.T) @ loading, np.var(own, ddof=1) * np.array(loading), atol=1e-8)


def _turned(p, q):
    """q's best rigid image of p, by the largest eigenvector of the quaternion matrix."""
    a, b = p - p.mean(axis=0), q - q.mean(axis=0)
    s = a.T @ b
    trace, skew = np.trace(s), np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    m = np.block([[np.array([[trace]]), skew[None]], [skew[:, None], s + s.T - trace * np.eye(3)]])
    w, *v = np.linalg.eigh(m)[1][:, -1]
    v = np.array(v)
    cross = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return a @ ((w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * cross).T + q.mean(axis=0)


def test_domain_fit_field_equals_fits_one_by_one(spark):
    random = np.random.default_rng(4)
    pairs = [(random.normal(size=(9, 3)), random.normal(size=(9, 3))) for _ in range(5)]
    pairs.append((pairs[0][0], pairs[0][0]))
    frame = spark.createDataFrame([(i, p.ravel().tolist(), q.ravel().tolist()) for i, (p, q) in enumerate(pairs)], "i int, p array<double>, q array<double>")
    got = {r.i: r for r in geometry.domain_fit_field(frame, "p", "q", [4]).collect()}
    assert got[5].fit_field is None and np.allclose(got[5].domain_rmsd, 0, atol=1e-7)
    for i, (p, q) in enumerate(pairs[:5]):
        laid = np.concatenate([_turned(p[:4], q[:4]), _turned(p[4:], q[4:])])
        field = (laid - p).ravel()
        assert np.allclose(got[i].fit_field, field / np.linalg.norm(field), atol=1e-7)
        assert np.allclose(got[i].domain_rmsd, [np.sqrt(((laid[s] - q[s]) ** 2).sum(axis=1).mean()) for s in (slice(0, 4), slice(4, 9))])


def test_splits_at_the_median_against_given_modes(spark):
    random = np.random.default_rng(5)
    x, r = random.normal(size=(60, 5)) * [4, 3, 2, 1, 1], [None, *np.round(random.normal(size=59), 1).tolist()]
    frame = spark.createDataFrame([(row.tolist(), b) for row, b in zip(x, r)], "v array<double>, r double")
    halves, middle = resampling.median_subsets(frame, "r")
    assert middle == np.median(r[1:])
    modes = spark.createDataFrame([(i + 1, row.tolist()) for i, row in enumerate(np.eye(5))], "component int, loading array<double>")
    got = {row.subset: row for row in resampling.subset_overlap(frame, "v", halves, 2, modes).collect()}
    for name, keep in (("better", [b is not None and b < middle for b in r]), ("worse", [b is not None and b >= middle for b in r])):
        part = x[keep]
        own = np.linalg.svd(part - part.mean(axis=0), full_matrices=False)[2][:2]
        assert got[name].n == len(part) and np.isclose(got[name].rmsip, np.sqrt((own[:, :2] ** 2).sum() / 2))
