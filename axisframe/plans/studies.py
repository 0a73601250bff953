"""Queries of sources, sinks, geometry, assemblies, resampling, integrity and streams, on stand-ins from the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from axisframe.functions.vectors import cross3, finite
from axisframe.operators import assembly as A
from axisframe.operators import ensemble as E
from axisframe.operators import geometry as G
from axisframe.operators import integrity as I
from axisframe.operators import mechanics as M
from axisframe.operators import resampling as R
from axisframe.plans.numeric import _conformers, _network, r6
from axisframe.plans.registry import query
from axisframe.sources import binary, sinks, text
from axisframe.store import fresh_path
from axisframe.streaming import frames as S
from axisframe.tables import table


# sources -------------------------------------------------------------------------------------------------------------
@query("csv_scan", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def _(spark, d):
    path = fresh_path(spark, "suppliers")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.option("header", True).option("compression", "gzip").csv(path)
    return text.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", required=["s_suppkey"], finite=["s_acctbal"])


@query("keyed_csv_scan", "select upper(trim(n_name)) n_name, cast(n_regionkey as varchar) n_regionkey from nation")
def _(spark, d):
    path = fresh_path(spark, "nations")
    table(spark, d, "nation").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("n_name"), F.col("n_regionkey").cast("string").alias("n_regionkey")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return text.read_keyed(spark, path, "n_name")


@query(
    "union_csv",
    "select cast(r_regionkey as varchar) r_regionkey, r_name, cast(null as varchar) n_name from region union all select cast(n_regionkey as varchar), cast(null as varchar), n_name from nation",
)
def _(spark, d):
    path = fresh_path(spark, "union")
    sinks.write_union_csv([table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")], path)
    return text.read_csv(spark, path, "r_regionkey string, r_name string, n_name string")


def _mmcif(spark, d):
    """A structure a customer's nation: customers as atoms, with a second placement of every seventh."""
    c = table(spark, d, "customer").where("c_nationkey is not null")
    row = F.concat_ws(" ", F.lit("ATOM"), F.col("c_custkey").cast("string"), F.lit("CA"), F.when(F.col("c_custkey") % 7 == 0, "A").otherwise("."), F.concat(F.lit("'seg "), F.col("c_mktsegment"), F.lit("'")), F.lit("X"), (F.col("c_custkey") % 50).cast("string"), *[F.format_string("%.3f", e) for e in (F.col("c_acctbal") / 100, F.col("c_custkey") / 10.0, F.lit(1.5))])
    head = "\n".join(["data_x", "loop_", *[f"_atom_site.{n}" for n in ("group_PDB", "id", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z")], ""])
    each = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("rows"))
    return each.select(F.col("c_nationkey").cast("string").alias("path"), F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n#\n")).alias("text"))


@query("mmcif_loop_rows", "select cast(c_nationkey as varchar) path, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as integer) as row, cast(c_custkey as varchar) id, 'seg ' || c_mktsegment comp from customer")
def _(spark, d):
    return text.mmcif_loop(_mmcif(spark, d), "atom_site").select("path", "row", F.col("fields")["id"].alias("id"), F.col("fields")["label_comp_id"].alias("comp"))


@query(
    "mmcif_alpha_carbons",
    """with r as (select cast(c_nationkey as varchar) path, cast(c_custkey % 50 as integer) resnum, c_custkey k, round(c_custkey / 10.0, 3) y, c_custkey % 7 = 0 alt from customer)
    select path, resnum, arg_min(y, k) y, count(*) filter (alt) n_alternates from r group by path, resnum""",
)
def _(spark, d):
    return text.alpha_carbons(_mmcif(spark, d)).select("path", "resnum", "y", "n_alternates")


def _pdb(spark, d):
    """A trajectory a brand, a model a part size, parts as atoms."""
    p = table(spark, d, "part")
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f", F.col("p_partkey") % 99999, F.col("p_partkey") % 9999, F.col("p_retailprice") / 10, F.col("p_size").cast("double"), F.lit(-1.25))
    model = p.groupBy("p_brand", "p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda r: r["l"]), "\n").alias("atoms"))
    one = F.concat(F.lit("MODEL "), F.col("p_size").cast("string"), F.lit("\n"), F.col("atoms"), F.lit("\nENDMDL"))
    return model.groupBy(F.col("p_brand").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_size", one.alias("m")))), lambda r: r["m"]), "\n").alias("text"))


@query(
    "pdb_frames",
    "select p_brand path, cast(dense_rank() over (partition by p_brand order by p_size) as integer) frame, cast(p_partkey % 9999 as integer) resnum, cast(p_size as double) y, -1.25::double z from part",
)
def _(spark, d):
    return text.pdb_atoms(_pdb(spark, d), atom="CA", chain="A").select("path", "frame", "resnum", "y", "z")


def _curves(spark, d):
    e = table(spark, d, "events")
    line = F.concat_ws(" ", (F.col("event_id") + 1).cast("string"), F.format_string("%.6f", F.col("value")), F.lit("0.5"))
    per = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda r: r["l"]), "\n").alias("rows"))
    head = F.concat(F.lit("sample "), F.col("user_id").cast("string"), F.lit('\nq in 1/nm {"concentration": 2.5}\n\n'))
    return per.select(F.col("user_id").cast("string").alias("path"), F.concat(head, "rows", F.lit("\nnan 1 1\n")).alias("text"))


@query("scattering_points", "select cast(user_id as varchar) path, cast(event_id + 1 as double) q, round(value, 6) intensity, 0.5::double sigma from events")
def _(spark, d):
    return text.scattering_points(_curves(spark, d)).select("path", "q", r6("intensity").alias("intensity"), "sigma")


@query(
    "scattering_headers",
    """select distinct cast(user_id as varchar) path, '1/nm' unit, 'q in 1/nm {"concentration": 2.5}' evidence, 2.5::double concentration, 2::bigint n_lines from events""",
)
def _(spark, d):
    heads = text.scattering_headers(_curves(spark, d))
    value = text.header_json(heads, "concentration double").select("path", F.col("value.concentration").alias("concentration"))
    return text.unit_evidence(heads).join(value, "path").join(heads.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines")), "path")


@query("mutation_symbols", r"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\b([ACDEFGHIKLMNPQRSTVWY][1-9][0-9]{0,3}[ACDEFGHIKLMNPQRSTVWY])\b', 1))), ';') mutations from documents")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mutations(docs).select(F.col("path").alias("doc_id"), F.array_join("mutations", ";").alias("mutations"))


def _binary(frame, key, column, make):
    @F.pandas_udf("binary")
    def built(values: pd.Series) -> pd.Series:
        return values.map(make)

    return frame.select(F.col(key).cast("string").alias("path"), built(column).alias("content"))


def _npz(v):
    import io

    out = io.BytesIO()
    np.savez(out, half=np.asarray(v, float)[:32], table=np.asarray(v, float).reshape(8, 8))
    return out.getvalue()


@query("npz_arrays", "select cast(vec_id as varchar) path, 'half' as name, 32::bigint n, round(list_sum([x::double for x in embedding[1:32]]), 6) total from embeddings union all select cast(vec_id as varchar), 'table', 64, round(list_sum([x::double for x in embedding]), 6) from embeddings")
def _(spark, d):
    a = binary.npz_arrays(_binary(table(spark, d, "embeddings"), "vec_id", "embedding", _npz), ["half", "table"])
    return a.select("path", "name", F.aggregate("shape", F.lit(1).cast("long"), lambda s, x: s * x).alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _map(v):
    import struct

    head = bytearray(1024)
    struct.pack_into("<4i", head, 0, 4, 4, 4, 2)
    struct.pack_into("<3i", head, 28, 4, 4, 4)
    struct.pack_into("<3f", head, 40, 8.0, 8.0, 8.0)
    return bytes(head) + np.asarray(v, "<f4").tobytes()


@query("density_voxels", "select cast(vec_id as varchar) path, (i - 1)::bigint voxel, round(embedding[i]::double, 6) as value from embeddings, range(1, 65) r(i) where (i - 1) % 3 = 0")
def _(spark, d):
    return binary.density_voxels(_binary(table(spark, d, "embeddings"), "vec_id", "embedding", _map), 3).withColumn("value", r6("value"))


@query("density_headers", "select cast(vec_id as varchar) path, 2::integer as mode, 2.0::double spacing, 64::bigint n from embeddings")
def _(spark, d):
    h = binary.density_headers(_binary(table(spark, d, "embeddings"), "vec_id", "embedding", _map))
    return h.select("path", "mode", F.col("spacing")[0].alias("spacing"), F.aggregate("dimensions", F.lit(1).cast("long"), lambda s, x: s * x).alias("n"))


def _xtc(v):
    import struct

    out = b""
    for step in range(8):
        out += struct.pack(">iiif", 1995, 2, step, step * 0.5) + struct.pack(">9f", *[1.0] * 9) + struct.pack(">i", 2) + np.asarray(v[6 * step : 6 * step + 6], ">f4").tobytes()
    return out


@query("trajectory_records", "select cast(vec_id as varchar) path, i::integer frame, (i // 3)::integer batch, (i * 0.5)::double time_ps, round(embedding[6 * i + 1]::double, 6) x from embeddings, range(0, 8) r(i)")
def _(spark, d):
    t = binary.trajectory_records(_binary(table(spark, d, "embeddings"), "vec_id", "embedding", _xtc), batch_bytes=200)
    return t.select("path", "frame", "batch", "time_ps", F.round(F.col("coordinates")[0], 6).alias("x"))


@query("kept_result", "select l_returnflag, count(*) n from lineitem group by 1")
def _(spark, d):
    line = table(spark, d, "lineitem").select("l_returnflag")
    folder, build = fresh_path(spark, "kept"), lambda: line.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    sinks.kept(spark, folder, "flags", {"lineitem": line}, {"by": "flag"}, "1", build)
    return sinks.kept(spark, folder, "flags", {"lineitem": line}, {"by": "flag"}, "1", build)[0]


@query(
    "bundle_faults",
    "select cast(page_id as varchar) path, case when page_id % 11 = 0 then 'missing' when page_id % 11 = 1 then 'unexpected' when page_id % 11 = 2 then 'size' else 'hash' end fault from pages where page_id % 11 < 4",
)
def _(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), (F.col("page_id") % 11).alias("k"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    manifest = p.where("k <> 1").select("path", (F.octet_length("content").cast("long") + (F.col("k") == 2).cast("long")).alias("bytes"), F.when(F.col("k") == 3, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return sinks.verify_bundle(p.where("k <> 0"), manifest)


# streams -------------------------------------------------------------------------------------------------------------
@query(
    "stream_change_from_first",
    "with f as (select user_id, arg_min(value, (ts, event_id)) v from events group by user_id) select user_id, event_id, round(abs(value - v), 6) change from events join f using (user_id)",
)
def _(spark, d):
    path = fresh_path(spark, "event-stream")
    e = table(spark, d, "events")
    at = F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string("%012d", "event_id"))
    e.select("user_id", "event_id", at.alias("at"), F.array(F.col("value")).alias("v")).write.parquet(path)
    stream = spark.readStream.schema("user_id long, event_id long, at string, v array<double>").parquet(path)
    out = S.drained(S.change_from_first(stream, "user_id", "at", "v"), "event-changes")
    return out.select("user_id", F.substring_index("at", "/", -1).cast("long").alias("event_id"), r6("rmsd").alias("change"))


# geometry ------------------------------------------------------------------------------------------------------------
def _pairs(spark, d):
    """Each structure beside the one of the next id in its label."""
    from pyspark.sql.window import Window

    c = _conformers(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return c.withColumn("w", F.lead("v").over(Window.partitionBy("label").orderBy("vec_id"))).where("w is not null").select("vec_id", "v", "w")


@query("body_motions")
def _(spark, d):
    return G.body_motions(_pairs(spark, d), "v", "w").select("vec_id", r6("rmsd").alias("rmsd"), r6("angle_deg").alias("angle_deg"), r6("rise").alias("rise"))


@query("chord_against_tangent")
def _(spark, d):
    return G.chord_against_tangent(_pairs(spark, d), "vec_id", "v", "w").withColumn("cosine", r6("cosine"))


@query("rigid_content")
def _(spark, d):
    p = _pairs(spark, d).withColumn("move", F.zip_with("w", "v", lambda a, b: a - b))
    return G.rigid_content(p, "v", "move", [10]).select("vec_id", r6("rigid_content").alias("rigid_content"))


@query("constrained_dimensions", "select vec_id, 12::integer as free, 9::integer same_move, 11::integer same_distance from embeddings")
def _(spark, d):
    return G.constrained_dimensions(_conformers(spark, d), "vec_id", "v", [10], 9, 10)


@query(
    "centroid_distance",
    """with p as (select vec_id, i, k, 20 * embedding[3 * i + k]::double x from embeddings, range(0, 21) a(i), range(1, 4) b(k)), m as (select vec_id, k, avg(x) filter (i < 10) a, avg(x) filter (i >= 10) b from p group by all)
    select vec_id, round(sqrt(sum((a - b) ** 2)), 6) distance from m group by vec_id""",
)
def _(spark, d):
    from axisframe.plans.numeric import _atoms

    return G.centroid_distance(_atoms(spark, d).where("res < 21"), "vec_id", F.col("res") < 10, F.col("res") >= 10).withColumn("distance", r6("distance"))


@query(
    "nearest_approach",
    """with p as (select vec_id, i, [20 * embedding[3 * i + k]::double for k in [1, 2, 3]] x from embeddings, range(0, 20) a(i))
    select a.vec_id, round(min(list_distance(a.x, b.x)), 6) approach from p a join p b on a.vec_id = b.vec_id and a.i < 10 and b.i >= 10 group by a.vec_id""",
)
def _(spark, d):
    c = _conformers(spark, d).select("vec_id", F.slice("v", 1, 30).alias("a"), F.slice("v", 31, 30).alias("b"))
    return G.nearest_approach(c, "a", "b", block=4).select("vec_id", r6("approach").alias("approach"))


@query("dynamic_domains")
def _(spark, d):
    return G.dynamic_domains(_pairs(spark, d), "vec_id", "v", "w", 3, seed=0)


@query("rewired_degrees", "with e as (select distinct l_suppkey % 7 k, least(l_partkey % 40, l_orderkey % 40) i, greatest(l_partkey % 40, l_orderkey % 40) j from lineitem where l_linenumber = 1 and l_partkey % 40 <> l_orderkey % 40) select k, node, count(*) degree from (select k, i node from e union all select k, j from e) group by all")
def _(spark, d):
    line = table(spark, d, "lineitem").where("l_linenumber = 1 and l_partkey % 40 <> l_orderkey % 40")
    e = line.select((F.col("l_suppkey") % 7).alias("k"), (F.col("l_partkey") % 40).alias("i"), (F.col("l_orderkey") % 40).alias("j"))
    r = G.rewired(e, "k", seed=3)
    return r.select("k", F.explode(F.array("i", "j")).alias("node")).groupBy("k", "node").agg(F.count(F.lit(1)).alias("degree"))


@query("principal_angles")
def _(spark, d):
    sets = [E.vector_modes(_conformers(spark, d), "vec_id", "v", c, 3).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "vector"))), lambda m: m["vector"]).alias(n)) for c, n in ((8.0, "a"), (9.0, "b"))]
    return G.principal_angles(sets[0].join(sets[1], "vec_id"), "a", "b").select("vec_id", F.transform("angles_deg", lambda x: F.round(x, 4)).alias("angles_deg"))


@query("frame_metrics")
def _(spark, d):
    c = _conformers(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    first = c.orderBy("vec_id").first()["v"]
    m = G.frame_metrics(c, "label", "vec_id", "v", first, [1 / 66**0.5] * 66, 0.0, 1.0, (8, 14))
    return m.select("label", "vec_id", *[F.round(n, 5).alias(n) for n in m.columns[2:]])


@query("cross_products", "select vec_id, round(embedding[2]::double * embedding[6] - embedding[3]::double * embedding[5], 6) x, round(embedding[3]::double * embedding[4] - embedding[1]::double * embedding[6], 6) y, round(embedding[1]::double * embedding[5] - embedding[2]::double * embedding[4], 6) z from embeddings")
def _(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    c = cross3(F.slice(v, 1, 3), F.slice(v, 4, 3))
    return table(spark, d, "embeddings").select("vec_id", *[F.round(c[i], 6).alias(n) for i, n in enumerate("xyz")])


@query("finite_numbers", "select doc_id, try_cast(split_part(coalesce(text, ''), ' ', 1) as double) x from documents where coalesce(isfinite(try_cast(split_part(coalesce(text, ''), ' ', 1) as double)), true) union all select doc_id, null from documents where not isfinite(try_cast(split_part(coalesce(text, ''), ' ', 1) as double))")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", finite(F.split(F.coalesce("text", F.lit("")), " ")[0]).alias("x"))


# assemblies ----------------------------------------------------------------------------------------------------------
_AXIS = [1 / 36**0.5 if i % 3 == 0 else 0.0 for i in range(36)]
_AXIS = [x / (sum(y * y for y in _AXIS) ** 0.5) for x in _AXIS]


@query("interface_continuation")
def _(spark, d):
    t = A.continuation(_conformers(spark, d), "vec_id", "v", 12, 9.0, [1.0, 0.7, 0.4, 0.1], 8)
    return t.groupBy("vec_id", "strength").agg(F.count(F.lit(1)).alias("n_modes"), F.round(F.sum("eigenvalue"), 5).alias("total"))


@query("two_level_condensation")
def _(spark, d):
    return A.two_level_condensation(_conformers(spark, d), "vec_id", "v", 8, 12, 9.0).select("vec_id", r6("soft").alias("soft"), (F.col("gap") < 1e-6).alias("same"))


@query("partner_ladder")
def _(spark, d):
    return A.partner_ladder(_conformers(spark, d), "vec_id", "v", [12, 17, 22], _AXIS, 9.0, 8).withColumns({c: F.round(c, 5) for c in ("best_overlap", "soft", "stiffening")})


@query("rank_shifts")
def _(spark, d):
    return A.rank_shifts(_conformers(spark, d), "vec_id", "v", 12, _AXIS, 9.0, 10)


@query("mode_character")
def _(spark, d):
    m = A.mode_character(_conformers(spark, d), "vec_id", "v", 12, _AXIS, 9.0, 3)
    return m.withColumns({c: F.round(c, 4) for c in m.columns[2:]})


@query("directional_statistics")
def _(spark, d):
    s = A.directional_statistics(_conformers(spark, d), "vec_id", "v", 12, _AXIS, 12.0, 500, 20260906)
    return s.withColumns({c: F.round(c, 5) for c in s.columns[1:]})


@query("spring_derivatives")
def _(spark, d):
    nodes, grid = _network(spark, d)
    g = M.group_derivatives(M.spring_table(nodes, grid), nodes, grid)
    return g.withColumns({c: F.round(c, 6) for c in ("d_log_c", "d_log_mean", "d_log_s")})


#: Partners with a loose atom: one of fewer than three springs leaves their flexible block singular.
_LOOSE_SQL = """p as (select vec_id, i, [coalesce(embedding[3 * i + k]::double * 20, 0) for k in [1, 2, 3]] x from embeddings, range(0, 22) r(i)),
    g(c, cut) as (values ('9.0/uniform', 9.0), ('12.0/inverse_square', 12.0)),
    n as (select a.vec_id, c, a.i, count(*) filter (list_distance(a.x, b.x) > 1e-6 and list_distance(a.x, b.x) <= cut) k from p a join p b on a.vec_id = b.vec_id, g where a.i >= 12 group by all),
    l as (select vec_id, c, min(k) < 3 loose from n group by all)"""


@query("stiffness_order", f"with {_LOOSE_SQL} select vec_id || '/' || c condition, softer, stiffer, case when loose and 'flexible' in (softer, stiffer) then 'unsolvable' else 'ok' end status from l, (values ('isolated', 'flexible'), ('flexible', 'rigid'), ('rigid', 'fixed')) s(softer, stiffer)")
def _(spark, d):
    nodes, grid = _network(spark, d)
    return M.order_checks(M.spring_table(nodes, grid), nodes, grid).select("condition", "softer", "stiffer", "status")


@query("static_response", f"with {_LOOSE_SQL} select vec_id || '/' || c condition, state, case when loose and state = 'flexible' then 'unsolvable' else 'ok' end status from l, (values ('rigid'), ('flexible')) s(state)")
def _(spark, d):
    nodes, grid = _network(spark, d)
    gap = F.col("gap")
    status = F.when(gap.isNull(), "unsolvable").when(gap > 1e-6, "apart").otherwise("ok")
    return M.response_checks(M.spring_table(nodes, grid), nodes, grid).select("condition", "state", status.alias("status"))


@query("role_deltas")
def _(spark, d):
    nodes, grid = _network(spark, d)
    g = M.group_derivatives(M.spring_table(nodes, grid), nodes, grid)
    r = M.role_deltas(g, "d_log_s")
    return r.withColumns({c: F.round(c, 6) for c in r.columns[2:]})


# resampling and checks -----------------------------------------------------------------------------------------------
@query("subspace_draws", "select i::bigint draw, 1.0::double norm, 0.0::double outside from range(0, 300) r(i)")
def _(spark, d):
    """Draws in the span of the table's own first components: of unit length, and nothing of them outside."""
    parts = E.principal_components(table(spark, d, "embeddings"), "embedding", 4)
    basis = np.array([r.loading for r in parts.orderBy("component").collect()]).T
    rest = np.eye(len(basis)) - basis @ basis.T
    out = R.subspace_draws(spark, basis, 300, 11)
    square = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    beyond = F.array(*[F.aggregate(F.zip_with("direction", F.array(*[F.lit(float(x)) for x in row]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for row in rest])
    return out.select("draw", r6(square(F.col("direction"))).alias("norm"), r6(square(beyond)).alias("outside"))


@query("random_subspace_null")
def _(spark, d):
    """Each label's vectors give the number of modes that its null has."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.max(F.size("embedding")).alias("dimension"), F.least(F.lit(8), F.count(F.lit(1))).cast("int").alias("k"))
    null = R.random_subspace_overlaps(e, "label", "dimension", "k", 400, 5)
    return null.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rmsip")).alias("mean"), r6(F.stddev_samp("rmsip")).alias("sd"))


@query("axis_bootstrap")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("open", F.col("label") == 0).withColumn("study", F.col("vec_id") % 37)
    b = R.axis_resamples(e, "study", "embedding", "open", 200, 42)
    return b.groupBy("status").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("overlap", F.lit(q)), 5).alias(n) for n, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])


@query("balanced_subsamples")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("open", F.col("label") == 0)
    b = R.axis_resamples(e, "vec_id", "embedding", "open", 200, 7, balanced=5)
    return b.groupBy("status").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("overlap", F.lit(q)), 5).alias(n) for n, q in (("low", 0.025), ("high", 0.975))])


@query("subset_overlap")
def _(spark, d):
    e = table(spark, d, "embeddings")
    s = R.subset_overlap(e, "embedding", {"even": F.col("vec_id") % 2 == 0, "odd": F.col("vec_id") % 2 == 1, "all": F.lit(True)}, 3)
    return s.withColumn("rmsip", r6("rmsip"))


@query(
    "set_percentiles",
    """with u as (select s_suppkey p, s_acctbal v from supplier), m as (select distinct 'set ' || (l_partkey % 3) "set", l_suppkey p from lineitem where l_partkey % 5 < 3 and l_linenumber = 1),
    r as (select 'all' universe, p, 100 * cume_dist() over (order by v) pct from u union all select 'common', p, 100 * cume_dist() over (order by v) from u where p in (select p from m))
    select "set", universe, count(*) n, round(avg(pct), 6) percentile from r join m using (p) group by all""",
)
def _(spark, d):
    members = table(spark, d, "lineitem").where("l_partkey % 5 < 3 and l_linenumber = 1").select(F.concat(F.lit("set "), (F.col("l_partkey") % 3).cast("string")).alias("set"), F.col("l_suppkey").alias("position")).distinct()
    return R.set_percentiles(table(spark, d, "supplier"), "s_suppkey", "s_acctbal", members).withColumn("percentile", r6("percentile"))


@query("json_tree_differences", "select event_id, '$.k' path, cast(cast(json_extract_string(props, '$.k') as bigint) as varchar) \"left\", cast(cast(json_extract_string(props, '$.k') as bigint) + 1 as varchar) \"right\", 'value' fault from events where event_id % 10 = 0")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    changed = e.withColumn("props", F.when(F.col("event_id") % 10 == 0, F.to_json(F.struct((k + 1).alias("k")))).otherwise(F.to_json(F.struct(k.alias("k")))))
    return I.tree_differences(e, changed, "event_id", "props")


@query(
    "path_faults",
    """with f as (select o_custkey k, o_orderkey % 30 f, o_orderstatus = 'P' p from orders), s as (select k, f - lag(f) over (partition by k order by f) step, p from f),
    g as (select k, count(*) n, count(*) filter (step <> 1) gaps, count(*) filter (p) flags from s group by k) select k, case when gaps > 0 then 'gap or repeat' when n < 2 then 'short' else 'flagged' end fault from g where gaps > 0 or n < 2 or flags > 0""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 30).alias("f"), (F.col("o_orderstatus") == "P").alias("flagged"))
    return I.path_faults(o, "k", "f", 2, ["flagged"])


@query(
    "fit_decisions",
    "select p_partkey, case when p_size > 40 then 'orientation varies' when p_retailprice % 1 > 0.5 then 'coordinate varies' when p_partkey % 3 = 0 then 'density does not support it' else 'stable' end verdict from part",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", I.fit_decision(F.col("p_size").cast("double"), F.col("p_retailprice") % 1, F.col("p_partkey") % 3 != 0, most_angle=40.0, most_spread=0.5).alias("verdict"))


@query("fit_tables", "select p_brand state, 'fit ' || p_partkey fit, 'size' residue, cast(p_size as double) as value from part")
def _(spark, d):
    fit = F.struct(F.concat(F.lit("fit "), F.col("p_partkey").cast("string")).alias("fit"), F.col("p_retailprice").alias("score"), F.lit(0.5).alias("coordinate"), F.create_map(F.lit("size"), F.col("p_size").cast("double")).alias("residues"))
    docs = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.first("p_brand").alias("state"), F.collect_list(fit).alias("fits"))).alias("doc"))
    return I.fit_tables(docs, "doc")[2]


@query(
    "placement_audit",
    """with a as (select s_nationkey k, s_suppkey % 20 a from supplier), n as (select k, count(*) n from a group by k), w as (select x.k, max(abs(x.a - y.a)) w from a x join a y using (k) group by x.k)
    select k, cast(n as integer) n, round(cast(w as double), 4) worst_angle, case when n <> 4 then 'wrong count' when w > 10 then 'orientation varies' else 'pass' end verdict from n join w using (k)""",
)
def _(spark, d):
    angle = F.radians((F.col("s_suppkey") % 20).cast("double"))
    turn = F.array(F.cos(angle), -F.sin(angle), F.lit(0.0), F.sin(angle), F.cos(angle), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), turn.alias("r"), F.lit(0.5).alias("c"))
    return I.placement_audit(s, "k", "r", "c", 4).select("k", "n", F.round("worst_angle", 4).alias("worst_angle"), "verdict")


@query("sequence_blocks", "select n_nationkey k, 1::integer start, 4::integer other_start, 60::integer length from nation")
def _(spark, d):
    first = F.concat_ws("", *[F.chr(F.lit(65) + (F.col("n_nationkey") * 7 + i * i) % 26) for i in range(60)])
    return I.sequence_blocks(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), first.alias("a"), F.concat(F.lit("123"), first).alias("b")), "k", "a", "b")


@query(
    "two_grain_comparison",
    """with f as (select l_partkey i, l_suppkey j, min(l_extendedprice) m from lineitem group by all)
    select distinct l.l_partkey i, l.l_suppkey j, f.m least_fine, coalesce(f.m <= 20000, false) touching from lineitem l join f on f.i = l.l_partkey and f.j = l.l_suppkey""",
)
def _(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), "l_extendedprice")
    return I.two_grain(line.select("i", "j").distinct(), line, ["i", "j"], "l_extendedprice", 20000.0)


@query(
    "recomputation_differences",
    "select o_custkey, count(*) n, 'first' only_in from orders group by o_custkey having count(*) > 12 union all select o_custkey, 12, 'second' from orders group by o_custkey having count(*) > 12",
)
def _(spark, d):
    o = table(spark, d, "orders")
    found = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return I.recomputed_differences(found, found.withColumn("n", F.least("n", F.lit(12).cast("long"))))


@query("one_to_one_join", "select n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey and n_nationkey = r_regionkey")
def _(spark, d):
    from axisframe.operators.joins import join_one_to_one

    n = table(spark, d, "nation").withColumn("k", F.when(F.col("n_regionkey") == F.col("n_nationkey"), F.col("n_nationkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("n_nationkey").cast("string"))))
    return join_one_to_one(n, table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("k"), "r_name"), ["k"]).select("n_nationkey", "n_name", "r_name")


@query("new_since_snapshot", "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(spark, d):
    return I.new_since(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("inventory", "select n_name, r_name, n_regionkey * 2.0::double score from nation left join region on n_regionkey = r_regionkey")
def _(spark, d):
    n = table(spark, d, "nation")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return sinks.inventory(n.select("n_name"), n.join(r, "n_regionkey").select("n_name", "r_name"), n.select("n_name", (F.col("n_regionkey") * 2.0).alias("score")), "n_name")
