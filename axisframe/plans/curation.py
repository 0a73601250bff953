"""Queries of curation with reasons, panels, titles, network connectivity and component signs, on stand-ins from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.functions import vectors as V
from axisframe.operators import ensemble as E
from axisframe.operators import geometry as G
from axisframe.operators import graph
from axisframe.operators import resampling as R
from axisframe.operators import rules as C
from axisframe.operators import selection as S
from axisframe.plans.numeric import _conformers, r6
from axisframe.plans.registry import query
from axisframe.sources import sinks, text
from axisframe.store import fresh_path, tasks
from axisframe.tables import table


@query(
    "reference_curation",
    """with x as (select distinct l_suppkey structure, (l_partkey % 50)::integer p from lineitem where l_returnflag = 'N' and l_partkey % 50 < 40)
    select structure, 'N' as chain from x join supplier on s_suppkey = structure where s_acctbal / 2000 <= 4 group by structure having count(*) = 40""",
)
def _(spark, d):
    """Suppliers whose first chain has all of positions 0 to 39, at a resolution of up to 4."""
    residues = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("structure"), F.col("l_returnflag").alias("chain"), (F.col("l_partkey") % 50).cast("int").alias("position"))
    structures = table(spark, d, "supplier").select(F.col("s_suppkey").alias("structure"), (F.col("s_acctbal") / 2000).alias("resolution"), F.lit("N").alias("primary"))
    return C.curated(residues, structures, list(range(40)), [{"name": "reference", "ceiling": 4.0}]).select("structure", "chain")


@query(
    "fragment_filter",
    """with e as (select l_orderkey, l_linenumber, max(l_quantity) n from lineitem group by all)
    select l_orderkey, count(*) n_entities, count(*) filter (n < 12) n_fragments, min(n) shortest, max(n) >= 12 kept from e group by 1""",
)
def _(spark, d):
    return C.fragment_filter(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 12)


_BANDS = """v as (select c_mktsegment s, c_acctbal v, row_number() over (partition by c_mktsegment order by c_acctbal desc) k from customer where c_custkey % 3 > 0 and c_acctbal is not null),
    g as (select s, v, k, lead(v) over (partition by s order by k) w from v where k <= 16),
    t as (select s, (v + w) / 2 cut from (select *, row_number() over (partition by s order by v - w desc, k) i from g where w is not null) where i = 1),
    b as (select s, count(*) filter (v < cut) n_closed, min(v) filter (v < cut) closed_min, max(v) filter (v < cut) closed_max, avg(v) filter (v < cut) closed_mean, stddev_pop(v) filter (v < cut) closed_sd,
      count(*) filter (v >= cut) n_open, min(v) filter (v >= cut) open_min, max(v) filter (v >= cut) open_max from v join t using (s) group by s)"""


def _bands(spark, d):
    """Two customers of three set the bands of their segment."""
    return C.gap_bands(table(spark, d, "customer").where("c_custkey % 3 > 0"), ["c_mktsegment"], "c_acctbal")


@query("gap_bands", f"with {_BANDS} select s c_mktsegment, n_closed, closed_min, closed_max, round(closed_mean, 6) closed_mean, round(closed_sd, 6) closed_sd, n_open, open_min, open_max from b")
def _(spark, d):
    return _bands(spark, d).withColumns({c: r6(c) for c in ("closed_mean", "closed_sd")})


@query(
    "band_reasons",
    f"""with {_BANDS}, c as (select *, coalesce(c_custkey % 7 > 0, false) there, case when c_custkey % 5 > 0 then c_nationkey / 4 end near from customer left join b on s = c_mktsegment),
    k as (select *, case when not there or c_acctbal is null or open_min is null then 'indeterminate' when c_acctbal <= closed_max + 1 then 'closed' when c_acctbal >= open_min - 1 then 'open' else 'intermediate' end verdict from c),
    z as (select *, case when verdict <> 'indeterminate' and closed_sd > 0 then (c_acctbal - closed_mean) / closed_sd end z from k)
    select c_custkey, verdict, case when not there then 'the coordinate does not exist for this entry' when verdict = 'indeterminate' then 'too few positions or reference values'
      when verdict = 'intermediate' then printf('%.2f A is between the closed band''s end %.2f and the open band''s start %.2f', c_acctbal, closed_max, open_min)
      else printf('%.2f A is in the %s band %.2f to %.2f, z ', c_acctbal, verdict, case verdict when 'open' then open_min else closed_min end, case verdict when 'open' then open_max else closed_max end)
        || case when z is null then 'n/a' else printf('%+.1f', z) end || '; nearest approach ' || case when near is null then 'n/a' else printf('%.2f', near) end end reason from z""",
)
def _(spark, d):
    c = table(spark, d, "customer").withColumn("near", F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey") / 4))
    return C.band_calls(c, _bands(spark, d), ["c_mktsegment"], "c_acctbal", present=F.col("c_custkey") % 7 > 0, nearest="near").select("c_custkey", "verdict", "reason")


@query(
    "panel_export",
    """select 'a' panel, 'point' record_type, cast(s_nationkey as varchar) series, cast(s_suppkey as varchar) identifier, cast(null as bigint) "index", s_suppkey * 1.0::double x, s_acctbal y, null::double z, null::double dx, null::double dy, null::double dz, null::double as value, 'usd' unit, null::varchar notes from supplier
    union all select 'b', 'arrow', o_orderstatus, cast(o_orderkey as varchar), null, 0, 0, 0, o_totalprice, 1, o_orderkey % 7, null, null, 'order, "placed"' from orders
    union all select 'c', 'trace', 'label ' || label, cast(vec_id as varchar), i - 1, null, null, null, null, null, null, embedding[i]::double, null, null from embeddings, range(1, 65) t(i)""",
)
def _(spark, d):
    """Points, arrows and traces, written as one CSV table and read back."""
    s, o, e = table(spark, d, "supplier"), table(spark, d, "orders"), table(spark, d, "embeddings")
    zero = F.lit(0.0)
    panels = [
        S.panel_records(s, "a", "point", series=F.col("s_nationkey"), identifier=F.col("s_suppkey"), x=F.col("s_suppkey"), y=F.col("s_acctbal"), unit="usd"),
        S.panel_records(o, "b", "arrow", series=F.col("o_orderstatus"), identifier=F.col("o_orderkey"), x=zero, y=zero, z=zero, dx=F.col("o_totalprice"), dy=F.lit(1.0), dz=F.col("o_orderkey") % 7, notes='order, "placed"'),
        S.panel_records(e, "c", "trace", each="embedding", series=F.concat(F.lit("label "), "label"), identifier=F.col("vec_id")),
    ]
    path = fresh_path(spark, "panels")
    sinks.write_union_csv(panels, path)
    return spark.read.schema(", ".join(f"`{n}` {t}" for n, t in S.PANEL.items())).option("header", True).option("escape", "\\").csv(path)


@query(
    "mapped_ranges",
    """with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 i from lineitem),
    r as (select l_orderkey, l_partkey % 100 + 1 b, l_partkey % 100 + 1 + l_quantity::bigint e, case when l_suppkey % 4 = 0 then 'row ' || i when l_suppkey % 4 = 1 then case when l_returnflag = 'N' then 'M,N' when l_returnflag = 'R' then 'M,R' else 'A,M' end else l_returnflag end strands from l where l_suppkey % 2 = 0 or l_suppkey % 3 = 1)
    select cast(l_orderkey as varchar) path, strands, array_to_string(list_transform(list_sort(list(distinct {'b': b, 'e': e})), lambda x: x.b || '-' || x.e), ';') ranges from r group by all""",
)
def _(spark, d):
    """A file an order: its lines as mapped intervals of two accessions, on one chain, on two, or on none."""
    strand = F.when(F.col("l_suppkey") % 4 == 0, "?").when(F.col("l_suppkey") % 4 == 1, F.concat("l_returnflag", F.lit(",M"))).otherwise(F.col("l_returnflag"))
    accession = F.when((F.col("l_suppkey") % 2 == 0) | (F.col("l_suppkey") % 3 == 1), "Q1").otherwise("Q2")
    beg = F.col("l_partkey") % 100 + 1
    row = F.concat_ws(" ", accession, strand, beg.cast("string"), (beg + F.col("l_quantity").cast("long")).cast("string"))
    head = "\n".join(["data_x", "loop_", *[f"_struct_ref_seq.{n}" for n in ("pdbx_db_accession", "pdbx_strand_id", "db_align_beg", "db_align_end")], ""])
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", row.alias("row"))))
    texts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows")).select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n#\n")).alias("text"))
    found = text.range_groups(texts, "q1", 400)
    return found.select("path", "strands", F.array_join(F.transform("ranges", lambda x: F.concat_ws("-", x["beg"].cast("string"), x["end"].cast("string"))), ";").alias("ranges"))


@query("json_hashes", """select event_id, sha256('{"event_type":"' || event_type || '","inner":{"a":' || coalesce(cast(user_id as varchar), 'null') || ',"b":[' || cast(value as varchar) || ']}}') hash from events""")
def _(spark, d):
    value = F.struct(F.struct(F.array("value").alias("b"), F.col("user_id").alias("a")).alias("inner"), F.col("event_type"))
    e = table(spark, d, "events").select("event_id", value.alias("v"))
    return e.select("event_id", V.json_hash(F.col("v"), e.schema["v"].dataType).alias("hash"))


@query(
    "table_titles",
    """with l as (select p_brand path, row_number() over (partition by p_brand order by p_partkey) - 1 line_no, p_partkey, 'S' || p_size table_id, 'Table S' || p_size || '. ' || p_name || case p_partkey % 7 when 0 then ' by SPR' when 1 then ' (ITC)' when 2 then ' thermal shift' when 3 then ' scattering' when 4 then ' mutant' when 5 then ' cryo-EM' else '' end title from part),
    f as (select *, row_number() over (partition by path, table_id order by line_no) k from l where p_partkey % 3 > 0)
    select path, table_id, title, case p_partkey % 7 when 0 then 'binding_spr' when 1 then 'binding_itc' when 2 then 'folding_dsf' when 3 then 'saxs' when 4 then 'mutation_construct_qc' when 5 then 'structure_statistics' else '' end assay_type, cast(line_no as integer) line_no from f where k = 1""",
)
def _(spark, d):
    """A text a brand, a line a part; every third line only mentions its table."""
    words = F.array(*[F.lit(w) for w in (" by SPR", " (ITC)", " thermal shift", " scattering", " mutant", " cryo-EM", "")])
    title = F.concat(F.lit("Table S"), F.col("p_size").cast("string"), F.lit(". "), "p_name", F.get(words, (F.col("p_partkey") % 7).cast("int")))
    line = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("  "), title)).otherwise(F.concat(F.lit("See "), title))
    lines = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("lines"))
    return text.table_titles(lines.select(F.col("p_brand").alias("path"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")))


@query(
    "network_connectivity",
    """with n as (select l_orderkey s, l_suppkey, max(l_partkey % 2) = 0 receptor, min(l_partkey) x from lineitem group by all),
    p as (select a.s, a.receptor <> b.receptor across from n a join n b on a.s = b.s and a.l_suppkey < b.l_suppkey and abs(a.x - b.x) <= (select count(*) / 5 from part)),
    e as (select s, count(*) n_edges, count(*) filter (across) n_interface_edges from p group by s),
    g as (select s, receptor, x - lag(x) over (partition by s order by x) gap, x - lag(x) over (partition by s, receptor order by x) own from n),
    c as (select s, count(*) filter (gap is null or gap > (select count(*) / 5 from part)) joint_components, count(*) filter (receptor and (own is null or own > (select count(*) / 5 from part))) receptor_components from g group by s)
    select s l_orderkey, coalesce(n_edges, 0) n_edges, coalesce(n_interface_edges, 0) n_interface_edges, true positive, joint_components, receptor_components, joint_components = 1 and receptor_components = 1 connected from c left join e using (s)""",
)
def _(spark, d):
    """A network an order: its suppliers, joined where their least part numbers lie within a fifth of all parts."""
    reach = table(spark, d, "part").count() / 5
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    lines = lines.repartition(tasks(lines), "l_orderkey")  # a task's share stays the same as tables grow
    nodes = lines.groupBy("l_orderkey", F.col("l_suppkey").alias("node")).agg((F.max(F.col("l_partkey") % 2) == 0).alias("receptor"), F.min("l_partkey").alias("x"))
    one, two = nodes.select("l_orderkey", F.col("node").alias("a"), F.col("x").alias("ax")), nodes.select("l_orderkey", F.col("node").alias("b"), F.col("x").alias("bx"))
    edges = one.join(two, "l_orderkey").where((F.col("a") < F.col("b")) & (F.abs(F.col("ax") - F.col("bx")) <= reach)).select("l_orderkey", "a", "b", F.lit(1.0).alias("weight"))
    return graph.connectivity(nodes.select("l_orderkey", "node", "receptor"), edges, "l_orderkey")


@query("scaled_scores")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return E.scaled_scores(e, "vec_id", "embedding", E.principal_components(e, "embedding", 3), 22)[0].withColumn("score", r6("score"))


@query("domain_fit_field")
def _(spark, d):
    """Each vector's points, in two bodies, fitted onto those of the next vector."""
    start = _conformers(spark, d)
    end = start.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    fitted = G.domain_fit_field(start.join(end, "vec_id"), "v", "w", [9])
    return fitted.select("vec_id", F.transform("fit_field", lambda x: F.round(x, 6)).alias("fit_field"), F.transform("domain_rmsd", lambda x: F.round(x, 6)).alias("domain_rmsd"))


@query("resolution_splits")
def _(spark, d):
    """Components of vectors by method and by resolution, against those of the first label."""
    e = table(spark, d, "embeddings").withColumn("resolution", F.get("embedding", 63).cast("double"))
    halves, middle = R.median_subsets(e, "resolution")
    modes = E.principal_components(e.where("label = 0"), "embedding", 5)
    found = R.subset_overlap(e, "embedding", {"all": F.lit(True), "odd": F.col("label") % 2 == 1, "even": F.col("label") % 2 == 0, **halves}, 5, modes)
    return found.select("subset", "n", r6("rmsip").alias("rmsip"), F.lit(middle).alias("median_resolution"))
