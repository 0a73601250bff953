"""Numeric and statistical queries on stand-ins from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.functions.vectors import doubles
from axisframe.operators import ensemble as E
from axisframe.operators import mechanics as M
from axisframe.operators import statistics as N
from axisframe.operators import windows as W
from axisframe.plans.registry import query
from axisframe.tables import table

_LABEL_AXIS = """m as (select i, avg(embedding[i]::double) filter (label = 0) - avg(embedding[i]::double) filter (label <> 0) g from embeddings, range(1, 65) r(i) group by i),
    n as (select sqrt(sum(g * g)) n from m), p as (select vec_id, label, sum(embedding[i]::double * g / n) s from embeddings, m, n group by all)"""


def r6(x):
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def _axis(spark, d):
    e = table(spark, d, "embeddings")
    return e, E.state_axis(e, "embedding", F.col("label") == 0, F.col("label") != 0)


@query(
    "state_axis_overlap",
    f"""with {_LABEL_AXIS}, o as (select s, lead(s) over w nx, row_number() over w k from p window w as (order by s desc, vec_id)),
    c as (select (s + nx) / 2 t from o where nx is not null and k <= 15 order by s - nx desc, k limit 1)
    select vec_id, label, round(s, 6) projection, s >= t is_open from p, c""",
)
def _(spark, d):
    e, axis = _axis(spark, d)
    scores = E.project(e, "embedding", axis).withColumn("one", F.lit(1))
    # only the first sixteen scores decide the cut
    lead = scores.orderBy(F.col("projection").desc(), "vec_id").limit(16)
    cut = W.widest_gap(lead, ["one"], "projection", "vec_id").select("threshold")
    return scores.crossJoin(F.broadcast(cut)).select("vec_id", "label", r6("projection").alias("projection"), (F.col("projection") >= F.col("threshold")).alias("is_open"))


@query(
    "covariance_matrix",
    "select cast(a.i - 1 as integer) i, cast(b.i - 1 as integer) j, round(covar_samp(embedding[a.i]::double, embedding[b.i]::double), 9) cov from embeddings, range(1, 65) a(i), range(1, 65) b(i) where a.i <= b.i group by all",
)
def _(spark, d):
    return E.covariance(table(spark, d, "embeddings"), "embedding").withColumn("cov", F.round("cov", 9))


@query("principal_components")
def _(spark, d):
    return E.principal_components(table(spark, d, "embeddings"), "embedding", 10).select("component", r6("eigenvalue").alias("eigenvalue"), r6("variance_ratio").alias("variance_ratio"))


@query("component_scores")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return E.component_scores(e, "vec_id", "embedding", E.principal_components(e, "embedding", 3))


def _conformers(spark, d):
    """All 64 components and two zeros as the coordinates of 22 points."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * 20)
    return table(spark, d, "embeddings").select("vec_id", F.concat(scaled, F.array(F.lit(0.0), F.lit(0.0))).alias("v"))


def _atoms(spark, d):
    points = F.transform(F.sequence(F.lit(0), F.lit(21)), lambda i: F.struct(i.alias("res"), *[F.get("v", i * 3 + k).alias(n) for k, n in enumerate("xyz")]))
    return _conformers(spark, d).select("vec_id", F.inline(points))


@query("superposition")
def _(spark, d):
    c = _conformers(spark, d)
    first = c.orderBy("vec_id").first()["v"]
    return E.superposed(c, "v", first).select("vec_id", r6("rmsd").alias("rmsd"))


@query("iterative_superposition")
def _(spark, d):
    laid, _ = E.iterative_superposition(_conformers(spark, d), "v", rounds=5)
    return laid.select("vec_id", r6("rmsd").alias("rmsd"))


@query("network_modes")
def _(spark, d):
    return E.vector_modes(_conformers(spark, d), "vec_id", "v", 8.0, 6).select("vec_id", "mode", r6("eigenvalue").alias("eigenvalue"))


@query("gaussian_network_modes")
def _(spark, d):
    return E.vector_modes(_conformers(spark, d), "vec_id", "v", 6.0, 4, kind="gnm").select("vec_id", "mode", r6("eigenvalue").alias("eigenvalue"))


@query("square_fluctuations")
def _(spark, d):
    f = E.square_fluctuations(E.vector_modes(_conformers(spark, d), "vec_id", "v", 8.0, 10), "vec_id")
    return f.withColumn("fluctuation", r6("fluctuation"))


@query("mode_overlaps")
def _(spark, d):
    e, axis = _axis(spark, d)
    padded = axis.select(F.concat("axis", F.array(F.lit(0.0), F.lit(0.0))).alias("axis"))
    return E.mode_overlaps(E.vector_modes(_conformers(spark, d), "vec_id", "v", 8.0, 5), "vec_id", padded).withColumn("overlap", r6("overlap"))


@query("subspace_overlap")
def _(spark, d):
    c = _conformers(spark, d)
    a, b = E.vector_modes(c, "vec_id", "v", 8.0, 5), E.vector_modes(c, "vec_id", "v", 9.0, 5)
    return E.subspace_overlap(a, b, "vec_id").withColumn("rmsip", r6("rmsip"))


@query("first_frame_change", "select event_id, round(value - first(value) over (partition by user_id order by ts, event_id), 6) change from events")
def _(spark, d):
    return E.first_as_reference(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", r6("change").alias("change"))


def _network(spark, d):
    """Two bodies of each structure: its first twelve points and the others, under two cutoffs."""
    atoms = _atoms(spark, d)
    long = atoms.select(F.col("vec_id").cast("string").alias("system"), F.col("res").alias("node"), F.when(F.col("res") < 12, "receptor").otherwise("partner").alias("body"), "x", "y", "z", F.lit(1.0).alias("dx"), (F.col("res") * 0.1).alias("dy"), F.sin(F.col("res").cast("double")).alias("dz"))
    grid = long.select("system").distinct().crossJoin(spark.createDataFrame([(9.0, "uniform"), (12.0, "inverse_square")], "cutoff double, weighting string"))
    return long, grid.withColumn("condition", F.concat_ws("/", "system", "cutoff", "weighting"))


@query("partner_states")
def _(spark, d):
    nodes, grid = _network(spark, d)
    states = M.partner_states(M.spring_table(nodes, grid), nodes, grid)
    return states.select("condition", "state", r6("c_close").alias("c_close"), r6("s_close").alias("s_close"), "status")


@query("spring_effects")
def _(spark, d):
    nodes, grid = _network(spark, d)
    effects = M.group_effects(M.spring_table(nodes, grid), nodes, grid, factors=(0.9, 1.1))
    return M.central_difference(effects).withColumn("d_g", r6("d_g"))


@query("partner_role_contrasts")
def _(spark, d):
    nodes, grid = _network(spark, d)
    return M.role_contrasts(M.partner_states(M.spring_table(nodes, grid), nodes, grid))


@query(
    "shared_edges",
    """with g as (select distinct l_partkey grp, l_orderkey edge from lineitem),
    s as (select grp, list_sort(list(edge)) edges from g group by grp), m as (select distinct a.grp, b.grp other from g a join g b using (edge) where a.grp <> b.grp),
    n as (select m.grp, string_agg(cast(other as varchar), ';' order by other) shared_with, string_agg(case when s.edges = o.edges then cast(other as varchar) end, ';' order by other) identical_to
      from m join s on s.grp = m.grp join s o on o.grp = other group by m.grp)
    select s.grp, coalesce(shared_with, '') shared_with, coalesce(identical_to, '') identical_to from s left join n on n.grp = s.grp""",
)
def _(spark, d):
    g = table(spark, d, "lineitem").select(F.col("l_partkey").alias("grp"), F.col("l_orderkey").alias("edge"))
    named = M.shared_edges(g, "grp", "edge")
    number = lambda c: F.array_join(F.transform(F.array_sort(F.transform(F.filter(F.split(c, ";"), lambda x: x != ""), lambda x: x.cast("long"))), lambda x: x.cast("string")), ";")
    return named.select("grp", number("shared_with").alias("shared_with"), number("identical_to").alias("identical_to"))


@query(
    "edge_identity",
    "select concat(least(s, p), '--', greatest(s, p)) edge, count(*) n from (select cast(l_suppkey as varchar) s, cast(l_partkey as varchar) p from lineitem) group by 1",
)
def _(spark, d):
    from axisframe.functions.vectors import edge_key

    line = table(spark, d, "lineitem")
    return line.groupBy(edge_key(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("edge")).agg(F.count(F.lit(1)).alias("n"))


# statistics ----------------------------------------------------------------------------------------------------------
@query("cosine_tail")
def _(spark, d):
    e, axis = _axis(spark, d)
    return E.project(e, "embedding", axis).select("vec_id", r6(N.cosine_tail(64, F.abs("projection"))).alias("p_value"))


@query("sampled_direction_null")
def _(spark, d):
    _, axis = _axis(spark, d)
    drawn = E.project(N.draws(spark, 5000, 64, 20260906), "direction", axis).select(F.lit(1).alias("k"), F.abs("projection").alias("v"), F.lit(0.3).alias("observed"))
    s = N.null_summary(drawn, ["k"], "v", "observed")
    return s.select("n_draws", *[r6(c).alias(c) for c in ("null_mean", "null_sd", "p95", "z", "p_add_one")])


@query(
    "null_summary",
    """with o as (select user_id, avg(value) + stddev_samp(value) obs from events group by user_id)
    select user_id, round(obs, 6) observed, count(value) n_draws, round(avg(value), 6) null_mean, round(stddev_samp(value), 6) null_sd, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99,
    count(*) filter (value >= obs) n_exceed, round((obs - avg(value)) / nullif(stddev_samp(value), 0), 6) z, round((count(*) filter (value >= obs) + 1) / (count(value) + 1), 6) p_add_one from events join o using (user_id) group by user_id, obs""",
)
def _(spark, d):
    e = table(spark, d, "events")
    o = e.groupBy("user_id").agg((F.avg("value") + F.stddev_samp("value")).alias("observed"))
    s = N.null_summary(e.join(o, "user_id"), ["user_id"], "value", "observed")
    return s.select("user_id", r6("observed").alias("observed"), "n_draws", *[r6(c).alias(c) for c in ("null_mean", "null_sd", "p50", "p95", "p99")], "n_exceed", r6("z").alias("z"), r6("p_add_one").alias("p_add_one"))


@query(
    "spearman",
    """with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 a,
    rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 b from lineitem)
    select l_returnflag, count(*) n, round(corr(a, b), 6) rho from r group by l_returnflag""",
)
def _(spark, d):
    return N.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("rho", r6("rho"))


@query("rank_correlation_p")
def _(spark, d):
    s = N.spearman(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice")
    return s.select("p_brand", "n", r6("rho").alias("rho"), r6(N.correlation_p(F.col("rho"), F.col("n"))).alias("p_value"))


@query(
    "ols_residual",
    """with b as (select o_orderstatus, regr_slope(o_totalprice, o_custkey) b, regr_intercept(o_totalprice, o_custkey) a from orders group by o_orderstatus)
    select o_orderkey, round(o_totalprice - a - b * o_custkey, 3) residual from orders join b using (o_orderstatus)""",
)
def _(spark, d):
    return N.residuals(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "o_custkey").select("o_orderkey", F.round("residual", 3).alias("residual"))


@query("rank_sum_exact")
def _(spark, d):
    s = table(spark, d, "supplier")
    return N.rank_sum(s, ["s_nationkey"], "s_acctbal", F.col("s_suppkey") % 2 == 0).select("s_nationkey", "n1", "n2", "u", r6("p_greater").alias("p_greater"), r6("p_two_sided").alias("p_two_sided"))


@query("fisher_exact")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("big", F.col("o_totalprice") > 200000).withColumn("done", F.col("o_orderstatus") == "F")
    t = o.groupBy("o_orderpriority").agg(*[F.count_if(c).alias(n) for n, c in (("a", F.col("big") & F.col("done")), ("b", F.col("big") & ~F.col("done")), ("c", ~F.col("big") & F.col("done")), ("d", ~F.col("big") & ~F.col("done")))])
    return N.fisher_exact(t, ["o_orderpriority"], "a", "b", "c", "d").withColumns({"odds_ratio": r6("odds_ratio"), "p_two_sided": r6("p_two_sided")})


@query(
    "matched_controls",
    """with f as (select p_partkey id, p_brand l, p_size n, round(p_retailprice, 0) v from part),
    m as (select a.id, b.n = a.n ex, case when b.v < a.v then 1.0 when b.v = a.v then 0.5 else 0.0 end u from f a join f b on a.l = b.l and a.id <> b.id and abs(a.n - b.n) <= 0.2 * a.n),
    g as (select f.id, count(*) filter (ex) ne, coalesce(sum(u) filter (ex), 0) ue, count(u) nc, coalesce(sum(u), 0) uc from f left join m on m.id = f.id group by f.id)
    select id, case when ne >= 4 then 'exact' when nc >= 4 then 'caliper' else 'insufficient' end tier, case when ne >= 4 then ne else nc end n_controls, round(case when ne >= 4 then 100 * ue / ne when nc >= 4 then 100 * uc / nc end, 6) percentile from g""",
)
def _(spark, d):
    part = table(spark, d, "part").withColumn("v", F.round("p_retailprice", 0))
    return N.matched_controls(part, "p_partkey", "p_brand", "p_size", "v", caliper=0.2, least=4).withColumn("percentile", r6("percentile"))


@query(
    "guinier_fit",
    """with c as (select label k, 0.004::double + 0.001::double * (row_number() over (partition by label order by vec_id)) q from embeddings),
    x as (select k, q, 0.42 * exp(-(q * q) * 400 * (1 + k) / 3) i from c), w as (select k, q, (i / 0.001) ** 2 w, q * q x, ln(i) y from x where i > 0),
    s as (select k, q, count(*) over o n, sum(w) over o sw, sum(w * x) over o sx, sum(w * y) over o sy, sum(w * x * x) over o sxx, sum(w * x * y) over o sxy from w window o as (partition by k order by q)),
    f as (select *, (sw * sxy - sx * sy) / nullif(sw * sxx - sx ** 2, 0) b from s), g as (select *, case when b < 0 then sqrt(-3 * b) end rg from f where n >= 5),
    h as (select *, sum(case when coalesce(round(rg * q, 9) <= 1.3, false) then 0 else 1 end) over (partition by k order by q) bad from g)
    select k, max(n) n_points, round(arg_max(rg, n), 4) rg, round(arg_max(exp((sy - b * sx) / sw), n), 4) i0, round(max(q), 6) q_max from h where bad = 0 group by k""",
)
def _(spark, d):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    c = table(spark, d, "embeddings").select(F.col("label").alias("k"), (0.004 + 0.001 * n).alias("q"))
    c = c.withColumn("i", 0.42 * F.exp(-(F.col("q") * F.col("q")) * 400 * (1 + F.col("k")) / 3)).withColumn("s", F.lit(0.001))
    g = N.guinier(c, ["k"], "q", "i", "s", most_qrg=1.3, least_points=5)
    return g.select("k", "n_points", F.round("rg", 4).alias("rg"), F.round("i0", 4).alias("i0"), r6("q_max").alias("q_max"))


@query(
    "kratky_peak",
    """with x as (select user_id k, 0.01::double * (event_id % 90 + 1) q, value + 1 i from events), h as (select k, (q * 2.5) ** 2 * i / 50 h, q from x)
    select k, round(arg_max(q, (h, -q)) * 2.5, 6) x, round(max(h), 11) height from h group by k""",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), (0.01 * (F.col("event_id") % 90 + 1)).alias("q"), (F.col("value") + 1).alias("i"), F.lit(2.5).alias("rg"), F.lit(50.0).alias("i0"))
    return N.kratky_peak(e, ["k"], "q", "i", "rg", "i0").withColumns({"x": r6("x"), "height": F.round("height", 11)})  # six digits would round ties


@query(
    "z_profile",
    """with p as (select l_suppkey s, l_partkey % 30 pos, avg(l_quantity) v from lineitem group by all), z as (select s, pos, (v - avg(v) over w) / nullif(stddev_pop(v) over w, 0) z from p window w as (partition by s))
    select pos, round(avg(z), 6) mean_z, count(distinct s) n from z group by pos having count(distinct s) >= 0.9 * (select count(distinct s) from p)""",
)
def _(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 30).alias("pos")).agg(F.avg("l_quantity").alias("v"))
    return N.z_profile(p, "s", "pos", "v", 0.9).withColumn("mean_z", r6("mean_z"))


@query("ridge_left_out")
def _(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("double").alias("place"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x1"), F.sin("p_partkey").alias("x2"), (F.col("p_size") > 25).cast("double").alias("dummy"))
    return N.ridge_left_out(p, ["p_brand"], "y", ["x1", "x2"], ["dummy"], "place", radius=10.0, alpha=0.1, least=5).withColumns({"predicted": F.round("predicted", 4), "residual": F.round("residual", 4)})


@query("cluster_bootstrap")
def _(spark, d):
    b = N.cluster_bootstrap(table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey", "c_acctbal", 200, 42)
    return b.groupBy("c_mktsegment").agg(*[F.round(F.percentile("mean", F.lit(q)), 4).alias(n) for n, q in (("low", 0.025), ("high", 0.975))])


@query("matched_set_null")
def _(spark, d):
    return N.matched_set_null(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", F.col("s_nationkey") < 5, 500, 7).select(*[r6(c).alias(c) for c in ("observed", "null_mean", "null_sd", "p_add_one")])


@query("pairwise_deviation", "with v as (select vec_id, [x::double for x in embedding] v from embeddings) select round(median(r), 6) median, round(max(r), 6) max, round(avg(r), 6) mean, count(r) n from (select list_distance(a.v, b.v) r from v a, v b where a.vec_id < b.vec_id)")
def _(spark, d):
    from axisframe.operators.joins import vector_pair_statistics

    p = vector_pair_statistics(table(spark, d, "embeddings"), "vec_id", "embedding")
    return p.select(r6("median").alias("median"), r6("max").alias("max"), r6("mean").alias("mean"), "n")


@query("vector_contact_join", "with v as (select vec_id, [x::double for x in embedding] v from embeddings) select a.vec_id i, b.vec_id j, round(list_distance(a.v, b.v), 6) r from v a, v b where a.vec_id < b.vec_id and list_distance(a.v, b.v) between 1e-6 and 1.19")
def _(spark, d):
    from axisframe.operators.joins import vector_contacts

    return vector_contacts(table(spark, d, "embeddings"), "vec_id", "embedding", 1.19).withColumn("r", r6("r"))
