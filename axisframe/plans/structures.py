"""Queries of large networks, neighbourhood exclusion, nulls, boxes, sub-ensembles, panels, bundles and kept members."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from axisframe.functions import vectors as V
from axisframe.operators import assembly as A
from axisframe.operators import ensemble as E
from axisframe.operators import integrity as I
from axisframe.operators import joins as J
from axisframe.operators import panel as P
from axisframe.operators import periodic as B
from axisframe.operators import resampling as R
from axisframe.operators import ridge as G
from axisframe.operators import rules as C
from axisframe.operators import sparse as S
from axisframe.operators import statistics as N
from axisframe.operators import windows as W
from axisframe.plans.numeric import _conformers, r6
from axisframe.plans.registry import query
from axisframe.sources import binary, replay
from axisframe.store import fresh_path
from axisframe.tables import table

#: Atoms of one stand-in structure, and the side of the block that it fills.
_ATOMS, _SIDE = 250, 7


def _globules(spark, d):
    """Structures of up to 250 vectors: a lattice whose points the vectors shake."""
    at = F.col("vec_id") % _ATOMS
    site = [F.floor(at / _SIDE**2), F.floor(at / _SIDE) % _SIDE, at % _SIDE]
    shaken = [(s * 3.8 + F.get("embedding", k).cast("double") * 2).alias(n) for k, (s, n) in enumerate(zip(site, "xyz"))]
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / _ATOMS).alias("structure"), "vec_id", *shaken)


@query("sparse_network_modes")
def _(spark, d):
    modes = S.sparse_network_modes(_globules(spark, d), "structure", "vec_id", 7.0, 10)
    return modes.select("structure", "mode", r6("eigenvalue").alias("eigenvalue"), (F.col("residual") <= S.MOST_RESIDUAL).alias("settled"))


# neighbourhood exclusion ---------------------------------------------------------------------------------------------
_DOMAINS = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]  # fixed values: first words of the parts' names


def _parts(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("edge"), "l_extendedprice")
    rows = lines.groupBy("p_partkey").agg(F.avg("l_extendedprice").alias("target"), F.count(F.lit(1)).alias("n_lines"))
    parts = table(spark, d, "part").join(rows, "p_partkey").withColumn("domain", F.split("p_name", " ")[0])
    own = dict(key="p_partkey", kind="p_type", domain="domain", target="target", features=["p_size", "p_retailprice", "n_lines"], domains=_DOMAINS, coordinates=["p_size", "p_retailprice"], cutoff=4.0)
    return parts, lines.select("p_partkey", "edge"), own


@query("ridge_shared_edges")
def _(spark, d):
    parts, edges, own = _parts(spark, d)
    fits = G.ridge_without_neighbours(parts, edges, alpha=0.1, least=10, least_of_domain=2, **own)
    return fits.withColumns({c: r6(c) for c in ("predicted", "residual", "mse")})


@query(
    "ridge_training_sets",
    """with e as (select l_partkey k, list_sort(list(distinct l_orderkey)) s from lineitem group by 1),
    p as (select p_partkey k, p_type kind, split_part(p_name, ' ', 1) dom, p_size::double x, p_retailprice y, s from part join e on k = p_partkey),
    t as (select t.k, c.s, arg_min(c.dom, c.k) dom, any_value(t.dom) own from p t join p c on t.kind = c.kind and sqrt((t.x - c.x) ** 2 + (t.y - c.y) ** 2) > 4 and not list_has_any(t.s, c.s) group by t.k, c.s),
    n as (select k, count(*) n, count(*) filter (dom = own) m from t group by k)
    select p.k p_partkey, case when coalesce(n, 0) >= 10 and coalesce(m, 0) >= 2 then 'fit' else 'insufficient' end status, coalesce(n, 0)::integer training_n, coalesce(m, 0)::integer same_domain_n from p left join n using (k)""",
)
def _(spark, d):
    parts, edges, own = _parts(spark, d)
    return G.ridge_without_neighbours(parts, edges, alpha=0.1, least=10, least_of_domain=2, **own).select("p_partkey", "status", "training_n", "same_domain_n")


# nulls ---------------------------------------------------------------------------------------------------------------
_N_DRAWS = 500


def _summary(draws, key):
    """The observed overlap (draw -1) against the draws."""
    drawn = F.when(F.col("draw") >= 0, F.col("overlap"))
    seen = F.max(F.when(F.col("draw") < 0, F.col("overlap")))
    own = draws.groupBy(key).agg(seen.alias("observed"), F.avg(drawn).alias("null_mean"), F.stddev_samp(drawn).alias("null_sd"), F.percentile(drawn, 0.95).alias("null_p95"), F.count(drawn).alias("n"))
    above = draws.join(own, key).groupBy(key).agg(F.count_if((F.col("draw") >= 0) & (F.col("overlap") >= F.col("observed"))).alias("k"))
    out = own.join(above, key)
    return out.select(key, *[r6(c).alias(c) for c in ("observed", "null_mean", "null_sd", "null_p95")], F.round((F.col("k") + 1) / (F.col("n") + 1), 9).alias("p_add_one"))


@query("rotation_null")
def _(spark, d):
    c = _conformers(spark, d).withColumns({"axis": F.transform(F.slice("v", 1, 3), lambda x: x + 5.0), "point": F.slice("v", 4, 3), "along": F.transform("v", lambda x: x * 0.1 + F.sin(x))})
    draws = R.rotation_null(c, "vec_id", "v", list(range(12, 22)), "axis", "point", "along", _N_DRAWS, 20260906)
    return _summary(draws.where("status = 'ok'"), "vec_id")


@query("permuted_null")
def _(spark, d):
    along = [float(np.sin(i + 1.0)) for i in range(64)]
    return _summary(R.permuted_null(table(spark, d, "embeddings"), "vec_id", "embedding", along, _N_DRAWS, 20260720), "vec_id")


@query("marginal_null")
def _(spark, d):
    sized = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("dimension"))
    draws = R.marginal_null(sized, "source", "dimension", _N_DRAWS, 20260720)
    return draws.groupBy("source").agg(r6(F.avg("overlap")).alias("null_mean"), r6(F.max("overlap")).alias("null_max"))


# boxes ---------------------------------------------------------------------------------------------------------------
_POINTS_SQL = """r as (select vec_id, label, p, case when p < 10 then 'a' else 'b' end as chain, embedding[3 * p + 1]::double * 40 as x, embedding[3 * p + 2]::double * 40 as y, embedding[3 * p + 3]::double * 40 as z from embeddings, range(0, 20) t(p)),
    f as (select *, z / 8 f3, (y - z / 8) / 9 f2, (x - 3 * ((y - z / 8) / 9) + 2 * (z / 8)) / 10 f1 from r),
    s as (select *, coalesce(round(f1 - lag(f1) over c), 0) t1, coalesce(round(f2 - lag(f2) over c), 0) t2, coalesce(round(f3 - lag(f3) over c), 0) t3 from f window c as (partition by vec_id, chain order by p)),
    k as (select *, sum(t1) over c k1, sum(t2) over c k2, sum(t3) over c k3 from s window c as (partition by vec_id, chain order by p rows unbounded preceding)),
    u as (select vec_id, label, p, chain, case when label = 9 then x else x - 10 * k1 - 3 * k2 + 2 * k3 end ux, case when label = 9 then y else y - 9 * k2 - k3 end uy, case when label = 9 then z else z - 8 * k3 end uz from k)"""


def _boxed(spark, d):
    """Twenty points of each vector, in two chains, in a skew box; label 9 has none."""
    e = table(spark, d, "embeddings")
    box = F.when(F.col("label") != 9, F.array(*[F.lit(float(b)) for b in (10, 0, 0, 3, 9, 0, -2, 1, 8)]))
    points = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda p: F.struct(p.alias("p"), *[(F.get("embedding", 3 * p + k).cast("double") * 40).alias(n) for k, n in enumerate("xyz")]))
    return e.select("vec_id", box.alias("box"), F.inline(points)).withColumn("chain", F.when(F.col("p") < 10, "a").otherwise("b"))


@query("unwrapped_chains", f"with {_POINTS_SQL} select vec_id, chain, p, round(ux, 6) x, round(uy, 6) y, round(uz, 6) z from u")
def _(spark, d):
    whole = B.unwrapped_chains(_boxed(spark, d), ["vec_id"], "chain", "p", ["x", "y", "z"], "box")
    return whole.select("vec_id", "chain", F.col("p").cast("long").alias("p"), *[r6(c).alias(c) for c in "xyz"])


@query(
    "bodies_together",
    f"""with {_POINTS_SQL},
    m as (select vec_id, any_value(label) label, avg(ux) filter (chain = 'b') - avg(ux) filter (chain = 'a') x, avg(uy) filter (chain = 'b') - avg(uy) filter (chain = 'a') y, avg(uz) filter (chain = 'b') - avg(uz) filter (chain = 'a') z from u group by vec_id),
    g as (select vec_id, case when label = 9 then 0 else round(z / 8) end g3, case when label = 9 then 0 else round((y - z / 8) / 9) end g2, case when label = 9 then 0 else round((x - 3 * ((y - z / 8) / 9) + 2 * (z / 8)) / 10) end g1 from m),
    o as (select vec_id, chain, p, ux, uy, uz, case when chain = 'b' then g1 else 0 end g1, case when chain = 'b' then g2 else 0 end g2, case when chain = 'b' then g3 else 0 end g3 from u join g using (vec_id))
    select vec_id, chain, p, round(ux - 10 * g1 - 3 * g2 + 2 * g3, 6) x, round(uy - 9 * g2 - g3, 6) y, round(uz - 8 * g3, 6) z from o""",
)
def _(spark, d):
    whole = B.unwrapped_chains(_boxed(spark, d), ["vec_id"], "chain", "p", ["x", "y", "z"], "box")
    met = B.bodies_together(whole, ["vec_id"], ["x", "y", "z"], "box", F.col("chain") == "b", F.col("chain") == "a")
    return met.select("vec_id", "chain", F.col("p").cast("long").alias("p"), *[r6(c).alias(c) for c in "xyz"])


# sub-ensembles and axes ----------------------------------------------------------------------------------------------
def _long_vectors(spark, d):
    """Sixteen vectors of 64 components as one of 1,024; what is left over at the end is shorter and stays out."""
    e = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).alias("conformer")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    return e.where(F.size("s") == 16).select("conformer", F.flatten(F.transform("s", lambda x: x["embedding"])).alias("v"))


@query("subensemble_scores")
def _(spark, d):
    s = E.subensemble_scores(_long_vectors(spark, d), "conformer", "v", 3)
    return s.select("conformer", "component", r6("score").alias("score"), r6("variance_ratio").alias("variance_ratio"))


@query("state_subensemble_scores")
def _(spark, d):
    s = E.subensemble_scores(table(spark, d, "embeddings").where("label = 0"), "vec_id", "embedding", 3)
    return s.select("vec_id", "component", r6("score").alias("score"), r6("variance_ratio").alias("variance_ratio"))


@query(
    "row_products",
    """with v as (select vec_id // 16 c, (vec_id % 16) * 64 + i pos, embedding[i]::double x from embeddings, range(1, 65) r(i)),
    w as (select c, pos, x from v where c in (select c from v group by c having count(*) = 1024)),
    m as (select c, pos, x - avg(x) over (partition by pos) x from w),
    n as (select c, dense_rank() over (order by c) - 1 k, pos, x from m)
    select a.k::integer i, b.k::integer j, round(sum(a.x * b.x), 6) g from n a join n b on a.pos = b.pos and a.k <= b.k group by all""",
)
def _(spark, d):
    return E.row_products(_long_vectors(spark, d), "conformer", "v", block=256).withColumn("g", r6("g"))


_AXES_SQL = """v as (select {0} c, label = 0 a, i, embedding[i]::double x from embeddings, range(1, 65) r(i)),
    s as (select c, i, sum(x) filter (a) sa, sum(x) filter (not a) sb, count(*) filter (a) na, count(*) filter (not a) nb from v group by c, i),
    t as (select i, sum(sa) ta, sum(sb) tb, sum(na) ka, sum(nb) kb from s group by i),
    g as (select c, ka - na la, kb - nb lb, case when ka > na and kb > nb then (ta - coalesce(sa, 0)) / (ka - na) - (tb - coalesce(sb, 0)) / (kb - nb) end g, ta / ka - tb / kb w, sin(i) f from s join t using (i)),
    o as (select c, any_value(la) la, any_value(lb) lb, sum(g * w) / sqrt(sum(g * g) * sum(w * w)) tw, abs(sum(g * f)) / sqrt(sum(g * g) * sum(f * f)) tf from g group by c)
    select c as {1}, case when la > 0 and lb > 0 then 'ok' else 'one state' end status, la::bigint n_first, lb::bigint n_second, round(tw, 9) to_whole, round(tf, 9) to_along from o"""


def _axes(spark, frame, cluster):
    fixed = np.sin(np.arange(1, 65))
    along = spark.createDataFrame([((fixed / np.linalg.norm(fixed)).tolist(),)], "axis array<double>")
    axes = E.leave_one_out_axes(frame, cluster, "embedding", F.col("label") == 0, F.col("label") != 0, along)
    return axes.select(cluster, "status", "n_first", "n_second", F.round("to_whole", 9).alias("to_whole"), F.round("to_along", 9).alias("to_along"))


@query("leave_one_out_axes", "with " + _AXES_SQL.format("vec_id", "vec_id"))
def _(spark, d):
    return _axes(spark, table(spark, d, "embeddings"), "vec_id")


@query("leave_study_out_axes", "with " + _AXES_SQL.format("vec_id % 38", "study"))
def _(spark, d):
    return _axes(spark, table(spark, d, "embeddings").withColumn("study", F.col("vec_id") % 38), "study")


# modes that nearly share an eigenvalue -------------------------------------------------------------------------------
_AXIS = [float(np.cos(i)) for i in range(66)]


@query("near_best_modes")
def _(spark, d):
    c = _conformers(spark, d)
    found = A.near_best(E.vector_modes(c, "vec_id", "v", 8.0, 12), c, "vec_id", "v", 12, _AXIS[:36], ratio=1.2)
    return found.withColumns({n: r6(n) for n in ("best_overlap", "best_amplitude", "internal_best_overlap", "near_overlap")})


@query("eigenvalue_clusters")
def _(spark, d):
    unit = np.array(_AXIS) / np.linalg.norm(_AXIS)
    axis = spark.createDataFrame([(unit.tolist(),)], "axis array<double>")
    modes = A.eigenvalue_clusters(E.vector_modes(_conformers(spark, d), "vec_id", "v", 8.0, 12), "vec_id")
    return A.cluster_overlaps(modes, "vec_id", axis).withColumn("overlap", r6("overlap"))


# panels --------------------------------------------------------------------------------------------------------------
@query(
    "control_panel",
    """with r as (select p_brand, p_size > 25 pos, p_retailprice + case when p_size > 25 and p_brand < 'Brand#15' then 3000 else 0 end m, p_partkey % 5 + 1 k from part),
    a as (select p_brand, count(*) filter (pos) n_positive, count(*) filter (not pos) n_negative, min(m) filter (pos) positive_min, median(m) filter (pos) positive_median, max(m) filter (pos) positive_max,
      min(m) filter (not pos) negative_min, median(m) filter (not pos) negative_median, max(m) filter (not pos) negative_max, avg((k <= 1)::integer) filter (pos) rank1, avg((k <= 3)::integer) filter (pos) rank3, 100 * avg((m <= 950)::integer) filter (pos) pct from r group by 1)
    select p_brand, n_positive, n_negative, round(positive_min, 6) positive_min, round(positive_median, 6) positive_median, round(positive_max, 6) positive_max, round(negative_min, 6) negative_min, round(negative_median, 6) negative_median, round(negative_max, 6) negative_max,
      round(case when negative_max < positive_min then (positive_min + negative_max) / 2 end, 6) threshold, coalesce(n_positive > 0 and n_negative > 0 and negative_max >= positive_min, false) classes_overlap,
      case when n_negative > 0 then (select count(*) from r where r.p_brand = a.p_brand and pos and m < negative_max) end n_positive_below, round(rank1, 6) rank1_fraction, round(rank3, 6) rank3_fraction, round(pct, 6) target_percentile from a""",
)
def _(spark, d):
    own = table(spark, d, "part").withColumns({"pos": F.col("p_size") > 25, "k": F.col("p_partkey") % 5 + 1, "goal": F.lit(950.0)})
    own = own.withColumn("m", F.col("p_retailprice") + F.when(F.col("pos") & (F.col("p_brand") < "Brand#15"), 3000).otherwise(0))
    found = P.separation(own, ["p_brand"], F.col("pos"), "m", "k", "goal")
    numbers = [c for c, t in found.dtypes if t == "double"]
    return found.withColumns({c: r6(c) for c in numbers})


@query(
    "panel_confounds",
    """with r as (select p_brand, p_retailprice m, p_size::double size, (p_partkey % 7)::double seventh from part),
    l as (select p_brand, m, 'p_size' confound, size o from r union all select p_brand, m, 'seventh', seventh from r),
    k as (select *, rank() over (partition by p_brand, confound order by m) + (count(*) over (partition by p_brand, confound, m) - 1) / 2.0 rm, rank() over (partition by p_brand, confound order by o) + (count(*) over (partition by p_brand, confound, o) - 1) / 2.0 ro from l where m is not null and o is not null)
    select p_brand, confound, count(*) n, round(corr(rm, ro), 9) rho from k group by all""",
)
def _(spark, d):
    own = table(spark, d, "part").withColumn("seventh", F.col("p_partkey") % 7)
    return P.confounds(own, ["p_brand"], "p_retailprice", ["p_size", "seventh"]).withColumn("rho", F.round("rho", 9))


# bundles and kept members --------------------------------------------------------------------------------------------
def _members(vector) -> dict[str, bytes]:
    whole = np.asarray(vector, dtype=float)
    out = {}
    for name, array in (("data/half.npy", whole[:32]), ("data/table.npz", None)):
        raw = io.BytesIO()
        np.save(raw, array) if array is not None else np.savez(raw, square=whole.reshape(8, 8), first=whole[:1])
        out[name] = raw.getvalue()
    return out


def _bundle_files(frame):
    """Bundles in turn as a directory and as a ZIP."""

    def run(batches):
        for pdf in (whole.iloc[at : at + 256] for whole in batches for at in range(0, len(whole), 256)):  # few files at once
            rows = []
            for vec_id, vector in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                files = _members(vector)
                if vec_id % 2:
                    rows += [(f"store/b{vec_id}/{name}", raw) for name, raw in files.items()]
                    continue
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w") as z:
                    for name, raw in files.items():
                        z.writestr(name, raw)
                    z.writestr("data/other.txt", "not read")
                rows.append((f"store/b{vec_id}.zip", packed.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return frame.select("vec_id", "embedding").mapInPandas(run, "path string, content binary")


@query(
    "bundle_arrays",
    """with n(member, name, shape, low, high) as (values ('half.npy', 'half', '32', 1, 32), ('table.npz', 'square', '8 x 8', 1, 64), ('table.npz', 'first', '1', 1, 1))
    select 'b' || vec_id bundle, member, name, shape, round(list_sum([x::double for x in embedding[low:high]]), 6) total from embeddings, n""",
)
def _(spark, d):
    a = binary.bundle_arrays(_bundle_files(table(spark, d, "embeddings")), ["half.npy", "table.npz"])
    return a.select("bundle", "member", "name", F.array_join(F.col("shape").cast("array<string>"), " x ").alias("shape"), r6(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query(
    "member_replay",
    """select o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total, o_orderpriority = '1-URGENT' and count(*) filter (o_orderstatus = 'P') > 0 computed_now from orders group by 1""",
)
def _(spark, d):
    """A second run after one member has got more rows."""
    orders, folder = table(spark, d, "orders"), fresh_path(spark, "replay")
    sums = lambda rows: rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    replay.replayed(spark, folder, orders.where("o_orderpriority <> '1-URGENT' or o_orderstatus <> 'P'"), "o_orderpriority", sums, "sums 1")
    results, computed = replay.replayed(spark, folder, orders, "o_orderpriority", sums, "sums 1")
    return results.join(computed.withColumn("computed_now", F.lit(True)), "o_orderpriority", "left").select("o_orderpriority", "n", "total", F.coalesce("computed_now", F.lit(False)).alias("computed_now"))


# chains, contacts and series -----------------------------------------------------------------------------------------
@query("backbone_network_modes")
def _(spark, d):
    chain = [(i, i + 1) for i in range(21)]
    return E.vector_modes(_conformers(spark, d), "vec_id", "v", 8.0, 6, extra=chain).select("vec_id", "mode", r6("eigenvalue").alias("eigenvalue"))


@query(
    "adjacent_distances",
    """with p as (select vec_id, p, case when p < 10 then 'a' else 'b' end as chain, [embedding[3 * p + k]::double * 40 for k in [1, 2, 3]] x from embeddings, range(0, 20) t(p)),
    s as (select vec_id, chain, list_distance(x, lag(x) over (partition by vec_id, chain order by p)) d from p)
    select vec_id, chain, count(d) n_pairs, round(min(d), 6) min_distance, round(max(d), 6) max_distance, count(*) filter (d < 2.5) n_below, count(*) filter (d > 4.5) n_above from s group by all""",
)
def _(spark, d):
    found = W.adjacent_distances(_boxed(spark, d), ["vec_id"], "chain", "p", ["x", "y", "z"])
    return found.withColumns({c: r6(c) for c in ("min_distance", "max_distance")})


@query(
    "partner_census",
    """with p as (select vec_id, p, [embedding[3 * p + k]::double * 40 for k in [1, 2, 3]] x from embeddings, range(0, 20) t(p)),
    m as (select a.vec_id, case when b.p < 12 then 'near' else 'far' end as role, b.p, list_distance(a.x, b.x) d from p a join p b on a.vec_id = b.vec_id where a.p < 8 and b.p >= 8)
    select vec_id, role, count(distinct p) n, round(min(d), 6) min_distance, (count(*) filter (d <= 5))::bigint n_pairs_within, min(d) <= 5 reaches from m group by all""",
)
def _(spark, d):
    points = _boxed(spark, d).withColumn("id", F.col("vec_id") * 20 + F.col("p"))
    roles = points.where("p >= 8").withColumn("role", F.when(F.col("p") < 12, "near").otherwise("far"))
    found = J.partner_census(points.where("p < 8"), roles, ["vec_id"], "role", "id", ["x", "y", "z"], 5.0)
    return found.withColumn("min_distance", r6("min_distance"))


@query(
    "contact_groups",
    """with p as (select vec_id * 20 + p id, vec_id, p, case when p < 10 then 'a' else 'b' end as chain, [embedding[3 * p + k]::double * 40 for k in [1, 2, 3]] x from embeddings, range(0, 20) t(p)),
    c as (select a.p i, b.p j, least(a.chain, b.chain) || '-' || greatest(a.chain, b.chain) k from p a join p b on a.vec_id = b.vec_id and a.p < b.p where list_distance(a.x, b.x) <= 6 and list_distance(a.x, b.x) > 1e-6 and b.p - a.p > 2),
    e as (select k, unnest([i, j]) residue from c)
    select residue || ':' || k "group", residue::integer residue, k contact_class, count(*) n_edges from e group by all""",
)
def _(spark, d):
    points = _boxed(spark, d).withColumn("id", F.col("vec_id") * 20 + F.col("p"))
    pairs = J.contacts(points, "id", ["x", "y", "z"], 6.0, groups=["vec_id"])
    return J.contact_groups(pairs.select("i", "j"), points.select("id", "p", "chain"), "id", "chain", position="p")


@query(
    "series_correlation",
    """with b as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity x, l_extendedprice y from lineitem),
    k as (select *, rank() over (partition by l_suppkey order by x) + (count(*) over (partition by l_suppkey, x) - 1) / 2.0 rx, rank() over (partition by l_suppkey order by y) + (count(*) over (partition by l_suppkey, y) - 1) / 2.0 ry, x - avg(x) over (partition by l_suppkey) cx, y - avg(y) over (partition by l_suppkey) cy from b),
    g as (select *, lag(cx) over w bx, lag(cy) over w by_ from k window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, x, y)),
    a as (select l_suppkey, count(*) n, corr(rx, ry) rho, sum(cx * bx) / nullif(sum(cx * cx), 0) lx, sum(cy * by_) / nullif(sum(cy * cy), 0) ly from g group by 1),
    e as (select *, n * (1 - lx * ly) / (1 + lx * ly) ne from a)
    select l_suppkey, n, round(rho, 6) rho, round(lx, 6) lag_x, round(ly, 6) lag_y, round(ne, 6) n_effective, round(rho * sqrt((ne - 2) / (1 - rho * rho)), 6) t from e""",
)
def _(spark, d):
    own = N.series_correlation(table(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_quantity", "l_extendedprice")
    return own.select("l_suppkey", "n", *[r6(c).alias(c) for c in ("rho", "lag_x", "lag_y", "n_effective", "t")])


def _letters(spark, d):
    """Each vector as 64 letters, and the same with every ninth letter turned and six more in front."""
    letter = lambda x: F.chr(F.lit(65) + F.pmod(F.floor(x.cast("double") * 8).cast("int"), F.lit(4)))
    one = F.transform("embedding", letter)
    two = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 29 == 8, "X").otherwise(letter(x)))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(one, "").alias("a"), F.concat(F.lit("QQQQQQ"), F.array_join(two, "")).alias("b"))


@query(
    "matching_stretches",
    """with s as (select vec_id, [chr((65 + (floor(x::double * 8)::int % 4 + 4) % 4)::int) for x in embedding] c from embeddings),
    t as (select vec_id, array_to_string(c, '') a, 'QQQQQQ' || array_to_string([case when (i - 1 + vec_id) % 29 = 8 then 'X' else c[i] end for i in range(1, 65)], '') b from s),
    m as (select vec_id, i, j - i d from t, range(1, 62) p(i), range(1, 68) q(j) where substr(a, i, 4) = substr(b, j, 4)),
    r as (select *, i - row_number() over (partition by vec_id, d order by i) g from m)
    select vec_id, min(i)::integer start, (min(i) + d)::integer other_start, (count(*) + 3)::integer length from r group by vec_id, d, g""",
)
def _(spark, d):
    return I.matching_stretches(_letters(spark, d), "vec_id", "a", "b")


@query("letter_blocks")
def _(spark, d):
    return I.sequence_blocks(_letters(spark, d), "vec_id", "a", "b", anchor=12)


@query(
    "recomputed_contacts",
    """with p as (select vec_id, p, [embedding[3 * p + k]::double * 40 for k in [1, 2, 3]] x from embeddings, range(0, 20) t(p)),
    c as (select a.vec_id, a.p::integer i, b.p::integer j, list_distance(a.x, b.x) d, list_distance([round(v, 1) for v in a.x], [round(v, 1) for v in b.x]) e from p a join p b on a.vec_id = b.vec_id and a.p < b.p)
    select vec_id, i, j, case when d <= 6 then 'first' else 'second' end only_in from c where (d <= 6 and d > 1e-6) <> (e <= 6 and e > 1e-6)""",
)
def _(spark, d):
    """Contacts by cells, against all pairs of each structure from coordinates as they are printed, to one decimal."""
    points = _boxed(spark, d).select("vec_id", "p", "x", "y", "z")
    found = J.contacts(points, "p", ["x", "y", "z"], 6.0, groups=["vec_id"]).select("vec_id", "i", "j")
    printed = points.select("vec_id", "p", F.array(*[F.round(c, 1) for c in "xyz"]).alias("x"))
    pairs = printed.alias("a").join(printed.alias("b"), F.expr("a.vec_id = b.vec_id and a.p < b.p"))
    apart = F.sqrt(F.aggregate(F.zip_with("a.x", "b.x", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, u: s + u))
    again = pairs.where((apart <= 6.0) & (apart > 1e-6)).select("a.vec_id", F.col("a.p").alias("i"), F.col("b.p").alias("j"))
    return I.recomputed_differences(found, again)


# curation and angles -------------------------------------------------------------------------------------------------
_WINDOW = list(range(40))
_CURATION = [
    {"name": "a_whole", "ceiling": 2.5},
    {"name": "b_share_95", "coverage": 0.95, "ceiling": 2.5},
    {"name": "b_share_90", "coverage": 0.90, "ceiling": 2.5},
    {"name": "c_one_dropped", "drop": (24,)},
    {"name": "d_gaps_at_ends", "terminal": True, "ceiling": 2.5},
    {"name": "e_best_chain", "chain": "best", "ceiling": 2.5},
    {"name": "f_any_resolution"},
    {"name": "g_share_95_any_resolution", "coverage": 0.95},
]


@query(
    "curation_rules",
    """with x as (select distinct l_suppkey structure, l_returnflag as chain, (l_partkey % 50)::integer p from lineitem),
    s as (select s_suppkey structure, s_acctbal / 3000 resolution, 'N' first from supplier),
    g as (select structure, chain, list(p) filter (p < 40) seen, count(*) filter (p < 40) n from x group by all having n > 0),
    m as (select *, row_number() over (partition by structure order by n desc, chain) k from g join s using (structure)),
    v(variant, share, ceiling, best, gone, ends) as (values ('a_whole', 1.0, 2.5, false, -1, false), ('b_share_95', 0.95, 2.5, false, -1, false), ('b_share_90', 0.9, 2.5, false, -1, false), ('c_one_dropped', 1.0, null, false, 24, false),
      ('d_gaps_at_ends', 0.0, 2.5, false, -1, true), ('e_best_chain', 1.0, 2.5, true, -1, false), ('f_any_resolution', 1.0, null, false, -1, false), ('g_share_95_any_resolution', 0.95, null, false, -1, false)),
    k as (select variant, structure, chain, seen, gone from m, v where case when best then k = 1 else chain = first end and (ceiling is null or coalesce(resolution <= ceiling, false))
      and case when ends then len([q for q in range(5, 35) if not list_contains(seen, q::integer)]) = 0 else len([q for q in seen if q <> gone]) >= share * (case when gone < 0 then 40 else 39 end) - 1e-9 end),
    z as (select variant, count(*) n_structures from k group by 1),
    f as (select variant, q, count(*) c from (select variant, gone, unnest(seen) q from k) where q <> gone group by all)
    select variant, n_structures, (select count(*) from f where f.variant = z.variant and c = n_structures) n_positions from z""",
)
def _(spark, d):
    """Positions 0 to 39 of each supplier's lines, by return flag as chains."""
    line = table(spark, d, "lineitem")
    residues = line.select(F.col("l_suppkey").alias("structure"), F.col("l_returnflag").alias("chain"), (F.col("l_partkey") % 50).cast("int").alias("position")).where("position < 40").distinct()
    structures = table(spark, d, "supplier").select(F.col("s_suppkey").alias("structure"), (F.col("s_acctbal") / 3000).alias("resolution"), F.lit("N").alias("primary"))
    return C.common_positions(C.curated(residues, structures, _WINDOW, _CURATION), residues, _CURATION)


@query(
    "signed_angles",
    """with v as (select vec_id, [x::double for x in embedding] e from embeddings), u as (select vec_id, e, sqrt(e[10] ** 2 + e[11] ** 2 + e[12] ** 2) n from v), a as (select vec_id, e, e[10] / n a, e[11] / n b, e[12] / n c from u)
    select vec_id, round(degrees(atan2(a * (e[8] - e[6]) + b * (e[3] - e[7]) + c * (e[4] - e[2]), e[1] + e[5] + e[9] - (a * a * e[1] + b * b * e[5] + c * c * e[9] + a * b * (e[2] + e[4]) + a * c * (e[3] + e[7]) + b * c * (e[6] + e[8])))), 6) degrees from a""",
)
def _(spark, d):
    v = V.doubles(F.col("embedding"))
    angle = V.signed_angle_about(F.slice(v, 1, 9), V.unit(F.slice(v, 10, 3)))
    return table(spark, d, "embeddings").select("vec_id", r6(angle).alias("degrees"))
