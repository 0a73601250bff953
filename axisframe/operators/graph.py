"""Graphs given as edge tables: degrees and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisframe.operators.gates import GateError
from axisframe.store import written


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, degree) over both ends."""
    return edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node ties its larger (or smaller) neighbours to the least node that it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if larger else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "v")
    met = both.join(least, F.col("a") == F.col("v"))
    if larger:
        return met.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("v <> m").select("v", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b), root being the least node of its component.

    Alternating large and small stars; loops are ignored. Each round is written, so rounds do not pile up plans.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        edges = written(_star(_star(edges, True), False), "edges")


def component_table(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root, component_id from 1 in the order of roots, component_size)."""
    rooted = written(components(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "components")
    from axisframe.operators.order import numbered

    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("component_size"))
    ids = numbered(sizes, [F.col("root")], "component_id").withColumn("component_id", F.col("component_id") + 1)
    return rooted.join(ids, "root").select("node", "root", "component_id", "component_size")


def require_connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The edges, if they form one component."""
    roots = components(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))).select("root").distinct().count()
    if roots != 1:
        raise GateError(f"{roots} components")
    return edges


def connectivity(nodes: DataFrame, edges: DataFrame, system: str, *, largest: int = 1000) -> DataFrame:
    """(system, n_edges, n_interface_edges, positive, joint_components, receptor_components, connected) of many networks.

    ``nodes`` has (system, node, receptor), ``edges`` (system, a, b, weight); an edge counts once whichever end is first,
    and loops don't. ``receptor_components`` are those of receptor nodes without the others, ``positive`` says that no
    weight is 0, negative or null, and ``connected`` that both counts are 1. Nodes without edges are components too.

    Networks are whole in a row each, and a batch of them is solved at once; those of more than ``largest`` edges or nodes
    are solved by rounds over all of them instead, so no task holds a large one.
    """
    edges = written(edges.where("a <> b").select(system, "a", "b", F.coalesce(F.col("weight") > 0, F.lit(False)).alias("positive")), "network-edges")
    nodes = nodes.select(system, "node", "receptor")
    sizes = edges.groupBy(system).agg(F.count(F.lit(1)).alias("n")).union(nodes.groupBy(system).agg(F.count(F.lit(1)).alias("n")))
    large = written(sizes.where(F.col("n") > largest).select(F.col(system).alias("_large")).distinct(), "large-networks")
    within = lambda frame, how: frame.join(large, F.col(system) == F.col("_large"), how)
    if large.isEmpty():
        return _by_network(nodes, edges, system)
    return _by_network(within(nodes, "left_anti"), within(edges, "left_anti"), system).union(_by_rounds(within(nodes, "left_semi"), within(edges, "left_semi"), system))


#: Columns of ``connectivity``.
_COUNTS = "n_edges long, n_interface_edges long, positive boolean, joint_components long, receptor_components long, connected boolean"
_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each of n nodes' components, edges being (i, j)."""
    root = np.arange(n)
    while (root[i] != root[j]).any():
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (root[root] != root).any():
            root = root[root]
    return root


def _by_network(nodes: DataFrame, edges: DataFrame, system: str) -> DataFrame:
    """``connectivity`` of networks that a row holds each."""
    members = nodes.groupBy(system).agg(F.collect_list(F.struct("node", "receptor")).alias("nodes"))
    links = edges.groupBy(F.col(system).alias("_of")).agg(F.collect_list(F.struct("a", "b", "positive")).alias("edges"))
    whole = members.join(links, F.col(system) == F.col("_of"), "left").select(system, "nodes", F.coalesce("edges", F.array().cast(links.schema["edges"].dataType)).alias("edges"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            held, met = batch.column("nodes"), batch.column("edges")
            owner, of = (np.repeat(np.arange(n), x.value_lengths().to_numpy()) for x in (held, met))
            held, met = held.flatten(), met.flatten()
            ends = pa.chunked_array([held.field("node"), met.field("a"), met.field("b")]).combine_chunks().dictionary_encode()
            code, kinds = ends.indices.fill_null(len(ends.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), len(ends.dictionary) + 1
            own = owner * kinds + code[: len(owner)]
            order = np.argsort(own, kind="stable")
            a, b = of * kinds + code[len(owner) : len(owner) + len(of)], of * kinds + code[len(owner) + len(of) :]
            places = np.append(own[order], -1)
            at, to = (np.searchsorted(places[:-1], x) for x in (a, b))
            known = (places[at] == a) & (places[to] == b)  # ends that are nodes of the network
            at, to, of = order[at[known]], order[to[known]], of[known]
            good = met.field("positive").to_numpy(zero_copy_only=False).astype(bool)[known]
            pair, first = np.unique(np.minimum(at, to) * (len(own) + 1) + np.maximum(at, to), return_index=True)
            receptor = held.field("receptor").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            across = receptor[at] != receptor[to]
            positive = np.ones(n, bool)
            positive[of[~good]] = False
            inner = receptor[at] & receptor[to]
            counts = [np.bincount(of[first], minlength=n), np.bincount(of[first[across[first]]], minlength=n)]
            for live, i, j in ((np.ones(len(own), bool), at, to), (receptor, at[inner], to[inner])):
                root = _roots(len(own), i, j) == np.arange(len(own))
                counts.append(np.bincount(owner[live & root], minlength=n))
            connected = (counts[2] == 1) & (counts[3] == 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in counts[:2]], pa.array(positive), *[pa.array(x, pa.int64()) for x in counts[2:]], pa.array(connected)], names=[system, *_NAMES])

    return whole.mapInArrow(run, T.StructType([whole.schema[system], *T.StructType.fromDDL(_COUNTS).fields]))


def _by_rounds(nodes: DataFrame, edges: DataFrame, system: str) -> DataFrame:
    """``connectivity`` by rounds of stars over all networks together."""
    once = edges.where("a <> b").groupBy(system, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bool_and("positive").alias("positive"))
    side = lambda end: nodes.select(F.col(system).alias(f"_{end}_of"), F.col("node").alias(f"_{end}"), F.col("receptor").alias(f"{end}_receptor"))
    flagged = once
    for end in "ab":
        flagged = flagged.join(side(end), (F.col(system) == F.col(f"_{end}_of")) & (F.col(end) == F.col(f"_{end}"))).drop(f"_{end}_of", f"_{end}")
    flagged = written(flagged, "network-edges")

    def joined(frame: DataFrame, name: str) -> DataFrame:
        """How many nodes of each system hang on another one: each takes a component away."""
        ends = [F.struct(F.col(system).alias("s"), F.col(e).alias("n")).alias(e) for e in "ab"]
        return components(frame.select(*ends)).where("node <> root").groupBy(F.col("node.s").alias(f"_{name}_of")).agg(F.count(F.lit(1)).alias(f"_{name}"))

    counts = nodes.groupBy(system).agg(F.count(F.lit(1)).alias("_n"), F.count_if("receptor").alias("_r"))
    sums = flagged.groupBy(F.col(system).alias("_of")).agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("a_receptor") != F.col("b_receptor")).alias("n_interface_edges"), F.bool_and("positive").alias("positive"))
    out = counts.join(sums, F.col(system) == F.col("_of"), "left")
    for name, frame in (("joint", flagged), ("receptor", flagged.where("a_receptor and b_receptor"))):
        out = out.join(joined(frame, name), F.col(system) == F.col(f"_{name}_of"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(system, zero("n_edges").alias("n_edges"), zero("n_interface_edges").alias("n_interface_edges"), F.coalesce("positive", F.lit(True)).alias("positive"), (F.col("_n") - zero("_joint")).alias("joint_components"), (F.col("_r") - zero("_receptor")).alias("receptor_components"))
    return out.withColumn("connected", (F.col("joint_components") == 1) & (F.col("receptor_components") == 1))


def require_networks(found: DataFrame, system: str) -> DataFrame:
    """The rows of ``connectivity``, if every network is connected; the error names the first that is not."""
    bad = found.where(~F.col("connected")).orderBy(system).first()
    if bad is not None:
        raise GateError(f"{system} {bad[system]}: {bad['joint_components']} components, {bad['receptor_components']} of the receptor")
    return found
