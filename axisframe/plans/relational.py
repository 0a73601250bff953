"""Relational queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisframe.functions import vectors as V
from axisframe.operators import aggregates as A
from axisframe.operators import gates as G
from axisframe.operators import joins as J
from axisframe.operators import rules as R
from axisframe.operators import selection as S
from axisframe.operators import windows as W
from axisframe.plans.registry import query
from axisframe.tables import table


def r6(x):
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def _effects(spark, d):
    """Group x class x condition effects: mean discount of a part, by return flag, under line status."""
    line = table(spark, d, "lineitem")
    return line.groupBy("l_partkey", "l_returnflag", "l_linestatus").agg((F.round(F.avg("l_discount") - 0.05, 9) + 0.0).alias("effect"), F.count(F.lit(1)).alias("n"))


_EFFECTS = "effects as (select l_partkey, l_returnflag, l_linestatus, round(avg(l_discount) - 0.05, 9) + 0.0 effect, count(*) n from lineitem group by all)"


# gates ---------------------------------------------------------------------------------------------------------------
@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) n_rows from lineitem group by all having count(*) > 1")
def _(spark, d):
    return G.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "key_differences",
    """select c_nationkey k, 'right' missing_from from (select distinct c_nationkey from customer where c_nationkey not in (select s_nationkey from supplier))
    union all select s_nationkey, 'left' from (select distinct s_nationkey from supplier where s_nationkey not in (select c_nationkey from customer))""",
)
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return G.key_differences(a, b, ["k"])


@query(
    "exact_key_join",
    "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey",
)
def _(spark, d):
    region = G.require_unique(table(spark, d, "region"), ["r_regionkey"]).withColumnRenamed("r_regionkey", "n_regionkey")
    nation = G.require_rows(G.require_unique(G.require_columns(table(spark, d, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"]), ["n_nationkey"]))
    return G.require_same_keys(nation, region, ["n_regionkey"]).join(region, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query(
    "condition_completeness",
    """with k as (select n_nationkey c_nationkey from nation), s as (select distinct c_mktsegment from customer),
    e as (select * from k cross join s), c as (select c_nationkey, c_mktsegment, count(*) n from customer group by all)
    select coalesce(e.c_nationkey, c.c_nationkey) c_nationkey, coalesce(e.c_mktsegment, c.c_mktsegment) c_mktsegment,
      case when c.n is null then 'missing' when e.c_nationkey is null then 'unexpected' when c.n > 1 then 'repeated' end fault
    from e full join c on e.c_nationkey = c.c_nationkey and e.c_mktsegment = c.c_mktsegment where c.n is null or e.c_nationkey is null or c.n > 1""",
)
def _(spark, d):
    customer = table(spark, d, "customer")
    return G.completeness(customer, [table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey")), customer.select("c_mktsegment").distinct()])


@query(
    "derived_value_gate",
    "select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) net, round(sum(l_extendedprice), 4) gross, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) ratio from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey",
)
def _(spark, d):
    line = table(spark, d, "lineitem")
    given = F.sum(F.col("l_extendedprice") * F.col("l_discount"))
    net = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.sum("l_extendedprice").alias("gross"), given.alias("given"))
    # the ratio by what was given away, held against net over gross
    checked = G.require_derived(net.withColumn("ratio", 1 - F.col("given") / F.col("gross")), "ratio", F.col("net") / F.col("gross"))
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(checked, "o_orderkey").select("o_orderkey", F.round("net", 4).alias("net"), F.round("gross", 4).alias("gross"), r6("ratio").alias("ratio"))


@query(
    "table_differences",
    """select p_partkey, 'p_size' as "column", cast(p_size as varchar) as "left", cast(p_size + 5 as varchar) as "right" from part where p_size = 7""",
)
def _(spark, d):
    a = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    b = a.withColumn("p_size", F.when(F.col("p_size") == 7, F.col("p_size") + 5).otherwise(F.col("p_size"))).withColumn("p_retailprice", F.col("p_retailprice") + 1e-12)
    return G.table_differences(a, b, ["p_partkey"])


# joins ---------------------------------------------------------------------------------------------------------------
@query(
    "precedence_join",
    "select n_nationkey, n_name, n_regionkey, r_name from nation left join region on n_regionkey = r_regionkey",
)
def _(spark, d):
    extra = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name", F.lit("other").alias("n_name"))
    return J.join_with_precedence(table(spark, d, "nation"), extra, ["n_regionkey"]).select("n_nationkey", "n_name", "n_regionkey", "r_name")


@query(
    "override_join",
    """select c_custkey, coalesce(o.g, case when c_mktsegment like '%E%' then c_mktsegment end) study_group
    from customer left join (select c_custkey k, 'override' g from customer where c_acctbal < 0) o on c_custkey = k""",
)
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    given = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", F.lit("override").alias("c_mktsegment"))
    return J.override_join(rows, given, "c_custkey", "c_mktsegment", F.col("c_mktsegment").like("%E%"), "study_group").select("c_custkey", "study_group")


@query(
    "join_or_none",
    "select c_custkey, coalesce(o_orderkey, -1) o_orderkey, o_orderkey is not null has_order from customer left join orders on c_custkey = o_custkey",
)
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    customer = table(spark, d, "customer")
    return J.join_or_none(customer, orders, F.col("c_custkey") == F.col("o_custkey"), "has_order", o_orderkey=-1).select("c_custkey", "o_orderkey", "has_order")


@query("semi_members", "select p_partkey, p_brand from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45)")
def _(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(big, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("anti_members", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def _(spark, d):
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "universe_outer_join",
    f"""with {_EFFECTS}, c as (select distinct l_returnflag, l_linestatus from lineitem)
    select p_partkey l_partkey, c.l_returnflag, c.l_linestatus, effect, case when n is null then 'missing' else 'observed' end status
    from part cross join c left join effects e on e.l_partkey = p_partkey and e.l_returnflag = c.l_returnflag and e.l_linestatus = c.l_linestatus""",
)
def _(spark, d):
    facts = _effects(spark, d).drop("n")
    conditions = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    return J.universe_join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), conditions, facts, ["l_partkey", "l_returnflag", "l_linestatus"])


@query(
    "pairs_across_states",
    "select a.s_suppkey a_s_suppkey, b.s_suppkey b_s_suppkey, round(a.s_acctbal - b.s_acctbal, 4) gap from supplier a, supplier b where a.s_nationkey = 3 and b.s_nationkey = 7",
)
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return J.pairs_across(s, "s_nationkey", 3, 7, "s_suppkey").select("a_s_suppkey", "b_s_suppkey", F.round(F.col("a_s_acctbal") - F.col("b_s_acctbal"), 4).alias("gap"))


_POINTS = "pts as (select vec_id id, embedding[1]::double * 40 x, embedding[2]::double * 40 y, embedding[3]::double * 40 z from embeddings)"


def _points(spark, d, *more):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *more, *[(F.col("embedding")[i].cast("double") * 40).alias(n) for i, n in enumerate("xyz")])


@query(
    "contact_grid_join",
    f"""with {_POINTS} select a.id i, b.id j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) r from pts a, pts b
    where a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 2 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) > 1e-6""",
)
def _(spark, d):
    return J.contacts(_points(spark, d), "id", ["x", "y", "z"], 2.0).withColumn("r", r6("r"))


@query(
    "typed_contacts",
    f"""with {_POINTS}, c as (select a.id i, b.id j from pts a, pts b where a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) between 1e-6 and 2)
    select concat(least(p.label, q.label), '-', greatest(p.label, q.label)) contact_class, count(*) n from c join embeddings p on i = p.vec_id join embeddings q on j = q.vec_id group by 1""",
)
def _(spark, d):
    pairs = J.contacts(_points(spark, d), "id", ["x", "y", "z"], 2.0)
    labels = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return J.typed_contacts(pairs, labels, "vec_id", "label").groupBy("contact_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contact_degree",
    f"""with {_POINTS}, c as (select a.id i, b.id j from pts a, pts b where a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) between 1e-6 and 2)
    select node, count(*) degree from (select i node from c union all select j from c) group by node""",
)
def _(spark, d):
    from axisframe.operators.graph import degrees

    return degrees(J.contacts(_points(spark, d), "id", ["x", "y", "z"], 2.0), "i", "j")


@query(
    "contact_components",
    f"""with recursive {_POINTS}, c as (select a.id i, b.id j from pts a, pts b where a.id < b.id and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) between 1e-6 and 1.5),
    e as (select i a, j b from c union select j, i from c), reach(a, b) as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
    root as (select a node, least(a, min(b)) root from reach group by a)
    select node, root, dense_rank() over (order by root) component_id, count(*) over (partition by root) component_size from root""",
)
def _(spark, d):
    from axisframe.operators.graph import component_table

    return component_table(J.contacts(_points(spark, d), "id", ["x", "y", "z"], 1.5), "i", "j")


@query(
    "nearest_partner",
    f"""with {_POINTS}, s as (select pts.*, label from pts join embeddings on id = vec_id), l as (select * from s where label = 0), r as (select * from s where label = 1),
    m as (select l.id left_id, r.id right_id, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) d from l, r)
    select left_id, arg_min(right_id, (d, right_id)) nearest_id, round(min(d), 6) min_distance, count(*) filter (d <= 5) n_within from m group by left_id""",
)
def _(spark, d):
    p = _points(spark, d, "label")
    a = p.where("label = 0").select(F.col("id").alias("left_id"), *[F.col(c).alias(f"l{c}") for c in "xyz"])
    b = p.where("label = 1").select(F.col("id").alias("right_id"), *[F.col(c).alias(f"r{c}") for c in "xyz"])
    return J.nearest(a, b, "left_id", "right_id", [(f"l{c}", f"r{c}") for c in "xyz"], 5.0).withColumn("min_distance", r6("min_distance"))


@query(
    "interval_join",
    """with iv as (select p_partkey, p_size * 10 lo, p_size * 10 + 25 hi from part)
    select vec_id, p_partkey from embeddings join iv on vec_id between lo and hi""",
)
def _(spark, d):
    iv = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("lo"), (F.col("p_size") * 10 + 25).alias("hi"))
    return J.interval_join(table(spark, d, "embeddings").select("vec_id"), iv, "vec_id", "lo", "hi", 32).select("vec_id", "p_partkey")


@query(
    "best_partner",
    """with a as (select distinct l_suppkey s, l_partkey m from lineitem where l_returnflag = 'A'), b as (select distinct l_suppkey t, l_partkey m from lineitem where l_returnflag = 'R'),
    c as (select s, t, count(*) n_shared from a join b using (m) group by all)
    select s, t, n_shared from (select *, row_number() over (partition by s order by n_shared desc, t) k from c) where k = 1 and n_shared >= 2""",
)
def _(spark, d):
    line = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_partkey").alias("m"))
    a = line.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("s"), "m")
    b = line.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("t"), "m")
    return J.best_partner(a, b, "s", "t", "m", least=2)


@query(
    "composite_key_lookup",
    f"with {_EFFECTS} select a.l_partkey, a.l_returnflag, round(a.effect - b.effect, 9) + 0.0 difference from effects a join effects b on a.l_partkey = b.l_partkey and a.l_returnflag = b.l_returnflag where a.l_linestatus = 'F' and b.l_linestatus = 'O'",
)
def _(spark, d):
    e = _effects(spark, d)
    a, b = e.where("l_linestatus = 'F'"), e.where("l_linestatus = 'O'").select("l_partkey", "l_returnflag", F.col("effect").alias("other"))
    return a.join(b, ["l_partkey", "l_returnflag"]).select("l_partkey", "l_returnflag", (F.round(F.col("effect") - F.col("other"), 9) + 0.0).alias("difference"))


# rules ---------------------------------------------------------------------------------------------------------------
@query(
    "eligibility_with_reasons",
    """select p_partkey, (p_size <= 30 and p_retailprice < 1500 and p_brand <> 'Brand#11') eligible,
    array_to_string(list_filter([case when p_size > 30 then 'size' end, case when p_retailprice >= 1500 then 'price' end, case when p_brand = 'Brand#11' then 'brand' end], lambda x: x is not null), '; ') reasons from part""",
)
def _(spark, d):
    rules = {"size": F.col("p_size") <= 30, "price": F.col("p_retailprice") < 1500, "brand": F.col("p_brand") != "Brand#11"}
    return R.with_reasons(table(spark, d, "part"), rules).select("p_partkey", "eligible", "reasons")


@query(
    "rule_variants",
    "select variant, count(*) n from (select unnest(list_filter([case when p_size >= 10 then 'strict' end, case when p_size >= 5 then 'loose' end, 'all'], lambda x: x is not null)) variant from part) group by variant",
)
def _(spark, d):
    kept = R.variants(table(spark, d, "part"), {"strict": F.col("p_size") >= 10, "loose": F.col("p_size") >= 5, "all": F.lit(True)})
    return kept.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


@query(
    "three_state_class",
    "select state, count(*) n from (select case when value <= 20 then 'closed' when value >= 80 then 'open' when value is not null then 'intermediate' end state from events) group by state",
)
def _(spark, d):
    return table(spark, d, "events").groupBy(R.three_state(F.col("value"), 20, 80).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "band_adjudication",
    """with b as (select event_type, min(value) filter (user_id % 3 = 0) a1, max(value) filter (user_id % 3 = 0) b1, min(value) filter (user_id % 3 = 1) a2, max(value) filter (user_id % 3 = 1) b2
      from events group by event_type),
    j as (select event_id, coalesce(a1, a2) is not null and a1 is not null and a2 is not null and value is not null known, value between a1 - 1 and b1 + 1 i1, value between a2 - 1 and b2 + 1 i2 from events join b using (event_type))
    select event_id, case when not known or (i1 and i2) then 'indeterminate' when i1 then 'closed' when i2 then 'open' else 'intermediate' end verdict from j""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("state", F.when(F.col("user_id") % 3 == 0, "closed").when(F.col("user_id") % 3 == 1, "open"))
    return R.adjudicate(e, "value", "state", ["event_type"], 1.0).select("event_id", "verdict")


@query("domain_bucket", "select domain, count(*) n from (select case when p_size < 15 then 'NTD' when p_size < 30 then 'HB' else 'TBD' end domain from part) group by domain")
def _(spark, d):
    return table(spark, d, "part").groupBy(R.bucket(F.col("p_size"), [(15, "NTD"), (30, "HB")], "TBD").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "residue_window_flag",
    """with m as (select l_orderkey, list(distinct l_partkey % 100) r from lineitem group by l_orderkey)
    select l_orderkey, case when len(list_filter(r, lambda x: x < 40)) = len(r) then 'inside' when len(list_filter(r, lambda x: x < 40)) = 0 then 'outside' else 'mixed' end flag from m""",
)
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 100).alias("r"))
    return m.select("l_orderkey", R.window_flag(F.col("r"), F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("flag"))


@query(
    "altloc_resolution",
    """select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_quantity desc, (l_returnflag = 'A')::int desc, l_orderkey * 10 + l_linenumber) k from lineitem) where k = 1""",
)
def _(spark, d):
    atoms = table(spark, d, "lineitem").withColumn("serial", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return R.resolve_altloc(atoms, ["l_partkey"], "l_quantity", "l_returnflag").select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    "construct_flags",
    """select o_orderkey, array_to_string(list_filter([case when o_totalprice > 200000 then 'large' end, case when o_orderstatus = 'F' then 'done' end, case when o_orderpriority like '1%' then 'urgent' end], lambda x: x is not null), ';') flags from orders""",
)
def _(spark, d):
    f = R.flags({"large": F.col("o_totalprice") > 200000, "done": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority").like("1%")})
    return table(spark, d, "orders").select("o_orderkey", f.alias("flags"))


@query(
    "ligand_class",
    """with k as (select o_custkey, max(o_totalprice) m from orders where o_orderpriority <> '5-LOW' group by o_custkey), a as (select distinct o_custkey from orders)
    select o_custkey, coalesce(m, 0) largest, case when coalesce(m, 0) = 0 then 'unmodelled' when m > 300000 then 'bivalent' else 'monovalent' end size_class from a left join k using (o_custkey)""",
)
def _(spark, d):
    low = spark.createDataFrame([("5-LOW",)], "o_orderpriority string")
    return R.class_of_largest(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", low, "o_orderpriority", 300000.0, ("unmodelled", "bivalent", "monovalent"))


@query("identifier_validation", "select p_partkey, p_brand from part where regexp_full_match(p_brand, 'Brand#[0-9]{2}')")
def _(spark, d):
    part = table(spark, d, "part")
    return part.where(F.col("p_brand").rlike("^Brand#[0-9]{2}$")).select("p_partkey", R.validated(F.col("p_brand"), "Brand#[0-9]{2}", "brand").alias("p_brand"))


@query("path_roles", "select role, count(*) n from (select case when regexp_matches(url, '/(a|b)') then 'primary' when regexp_matches(url, 'https') then 'secure' else 'other' end role from pages) group by role")
def _(spark, d):
    return table(spark, d, "pages").groupBy(R.role(F.col("url"), [("/(a|b)", "primary"), ("https", "secure")], "other").alias("role")).agg(F.count(F.lit(1)).alias("n"))


# aggregates ----------------------------------------------------------------------------------------------------------
@query("count_by_key", "select o_orderstatus, o_orderpriority, count(*) n from orders group by all")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("two_by_two", """select l_returnflag, count(*) filter (l_linestatus = 'F') as "F", count(*) filter (l_linestatus = 'O') as "O" from lineitem group by all""")
def _(spark, d):
    return A.cross_table(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("all_and_any", "select l_orderkey, bool_and(l_quantity > 10) all_true, bool_or(l_quantity > 45) any_true from lineitem group by l_orderkey")
def _(spark, d):
    line = table(spark, d, "lineitem")
    every = A.all_and_any(line, ["l_orderkey"], F.col("l_quantity") > 10).select("l_orderkey", "all_true")
    return every.join(A.all_and_any(line, ["l_orderkey"], F.col("l_quantity") > 45).select("l_orderkey", "any_true"), "l_orderkey")


@query(
    "all_conditions_gate",
    f"""with {_EFFECTS}, c as (select distinct l_returnflag, l_linestatus from lineitem),
    g as (select p_partkey l_partkey, coalesce(effect > 0, false) ok from part cross join c left join effects e on e.l_partkey = p_partkey and e.l_returnflag = c.l_returnflag and e.l_linestatus = c.l_linestatus)
    select l_partkey, bool_and(ok) gate_pass, count(*) filter (ok) n_passed, count(*) n_required from g group by l_partkey""",
)
def _(spark, d):
    conditions = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    grid = J.universe_join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), conditions, _effects(spark, d), ["l_partkey", "l_returnflag", "l_linestatus"])
    return A.gate_over_conditions(grid, ["l_partkey"], F.col("effect") > 0)


@query("grouped_vector_mean", "select label, cast(i - 1 as integer) pos, round(avg(embedding[i]::double), 6) mean from embeddings, range(1, 65) t(i) group by all")
def _(spark, d):
    return A.vector_mean(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("mean", r6("mean"))


@query(
    "study_equal_mean",
    "select c_mktsegment, round(avg(m), 6) mean_of_means, count(*) n_groups from (select c_mktsegment, c_nationkey, avg(c_acctbal) m from customer group by all) group by c_mktsegment",
)
def _(spark, d):
    return A.mean_of_means(table(spark, d, "customer"), "c_nationkey", ["c_mktsegment"], "c_acctbal").withColumn("mean_of_means", r6("mean_of_means"))


@query(
    "group_summary",
    """select event_type, count(value) n, round(min(value), 6) min, round(max(value), 6) max, round(avg(value), 6) mean, round(median(value), 6) median,
    round(list_sort(list(value))[count(value) // 2 + 1], 6) upper_median from events where value is not null group by event_type""",
)
def _(spark, d):
    s = A.summary(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[r6(c).alias(c) for c in ("min", "max", "mean", "median", "upper_median")])


@query(
    "grouped_quantiles",
    """with l as (select user_id, 'value' metric, value x from events union all select user_id, 'k', try_cast(json_extract_string(props, '$.k') as double) from events)
    select user_id, metric, count(*) n, round(quantile_cont(x, 0.05), 6) p05, round(quantile_cont(x, 0.5), 6) p50, round(quantile_cont(x, 0.95), 6) p95 from l where x is not null group by all""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    q = A.grouped_quantiles(e, ["user_id"], ["value", "k"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("user_id", "metric", "n", *[r6(c).alias(c) for c in ("p05", "p50", "p95")])


@query(
    "flag_counts",
    """with e as (select user_id, case when event_type = 'click' then value end v from events)
    select user_id, case when count(v) > 0 then count(v) end n_observed, case when count(v) > 0 then count(*) filter (v > 50) end n_flagged, round(min(v), 6) min_value, round(max(v), 6) max_value from e group by user_id""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("value")))
    f = A.flag_counts(e, ["user_id"], "v", F.col("v") > 50)
    return f.withColumns({c: r6(c) for c in ("min_value", "max_value")})


@query("distinct_counts", "select o_orderstatus, count(distinct o_custkey) n_customers, count(distinct o_orderpriority) n_priorities from orders group by o_orderstatus")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct("o_orderpriority").alias("n_priorities"))


@query("member_strings", "select o_custkey, string_agg(p, ';' order by p) members from (select distinct o_custkey, o_orderpriority p from orders) group by o_custkey")
def _(spark, d):
    return A.members(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("votes", "select l_partkey, count(distinct l_suppkey) n_votes from lineitem group by l_partkey having count(distinct l_suppkey) >= 0.2 * (select count(distinct l_suppkey) from lineitem)")
def _(spark, d):
    return A.votes(table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", 0.2)


@query("argmax_by_group", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) k from orders) where k = 1")
def _(spark, d):
    return A.argmax(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "density_summary",
    """select event_type, round(min(value), 6) min_value, round(max(value), 6) max_value, round(avg(value), 6) mean_value, round(stddev_pop(value), 6) sd_value, round(avg(abs(value)), 6) mean_abs,
    round(avg((value <> 0)::int), 6) nonzero_fraction, round(quantile_cont(value, 0.01), 6) p01, round(quantile_cont(value, 0.25), 6) p25, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.75), 6) p75, round(quantile_cont(value, 0.99), 6) p99
    from events group by event_type""",
)
def _(spark, d):
    x = A.density(table(spark, d, "events"), ["event_type"], "value")
    return x.select("event_type", *[r6(c).alias(c) for c in x.columns[1:]])


@query("strided_correlation", "select round(corr(l_quantity, l_extendedprice), 6) r, count(*) n from lineitem where l_orderkey % 7 = 0")
def _(spark, d):
    return A.strided_correlation(table(spark, d, "lineitem"), "l_orderkey", 7, "l_quantity", "l_extendedprice").withColumn("r", r6("r"))


@query(
    "exclusion_partition",
    """select case when k = '' then 'none' else k end cause, count(*) n from (select concat_ws('+', case when p_size < 10 then 'small' end, case when coalesce(p_retailprice, 9999) > 1200 then 'dear' end) k from part) group by 1""",
)
def _(spark, d):
    return A.partition_by_cause(table(spark, d, "part"), {"small": F.col("p_size") < 10, "dear": F.coalesce("p_retailprice", F.lit(9999.0)) > 1200})


@query(
    "baseline_delta",
    "select l_orderkey, l_linenumber, round(case when l_linenumber <> 1 then l_quantity - max(case when l_linenumber = 1 then l_quantity end) over (partition by l_orderkey) end, 6) delta from lineitem",
)
def _(spark, d):
    x = A.delta_from_baseline(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_linenumber") == 1, "l_quantity")
    return x.select("l_orderkey", "l_linenumber", r6("delta").alias("delta"))


# windows -------------------------------------------------------------------------------------------------------------
@query(
    "rank_within_class",
    f"""with {_EFFECTS} select l_partkey, l_returnflag, l_linestatus, row_number() over w class_rank, count(*) over (partition by l_returnflag, l_linestatus) class_n,
    round(row_number() over w / count(*) over (partition by l_returnflag, l_linestatus), 9) rank_fraction from effects window w as (partition by l_returnflag, l_linestatus order by abs(effect) desc, l_partkey)""",
)
def _(spark, d):
    x = W.rank_within(_effects(spark, d), ["l_returnflag", "l_linestatus"], [F.abs("effect").desc(), F.col("l_partkey")])
    return x.select("l_partkey", "l_returnflag", "l_linestatus", "class_rank", "class_n", F.round("rank_fraction", 9).alias("rank_fraction"))


@query(
    "widest_gap_split",
    """with o as (select o_orderstatus, o_totalprice s, lead(o_totalprice) over w nx, row_number() over w k from orders window w as (partition by o_orderstatus order by o_totalprice desc, o_orderkey))
    select o_orderstatus, round(s - nx, 6) gap, k n_above, round((s + nx) / 2, 6) threshold from (select *, row_number() over (partition by o_orderstatus order by s - nx desc, k) b from o where nx is not null and k <= 15) where b = 1""",
)
def _(spark, d):
    x = W.widest_gap(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey")
    return x.select("o_orderstatus", r6("gap").alias("gap"), "n_above", r6("threshold").alias("threshold"))


@query(
    "percentile_conventions",
    """with w as (select p_partkey, p_size, rank() over (partition by p_brand order by p_size) - 1 b, count(*) over (partition by p_brand, p_size) e, count(*) over (partition by p_brand) n from part)
    select p_partkey, round(100.0 * (b + e) / n, 6) pct_weak, round(case when n > 1 then 100.0 * b / (n - 1) end, 6) pct_strict, round(100.0 * (b + 0.5 * e) / n, 6) pct_mid, round(100.0 * (b + (e + 1) / 2) / n, 6) pct_average from w""",
)
def _(spark, d):
    x = W.percentiles(table(spark, d, "part"), ["p_brand"], "p_size")
    return x.select("p_partkey", *[r6(c).alias(c) for c in ("pct_weak", "pct_strict", "pct_mid", "pct_average")])


@query(
    "sign_changes",
    """with s as (select vec_id, i, lead(i) over w nx, sign(embedding[i]) * lead(sign(embedding[i])) over w t from embeddings, range(1, 65) r(i) where abs(embedding[i]::double) > 0.02 window w as (partition by vec_id order by i))
    select vec_id, cast(i as integer) pos, cast(nx as integer) next_position, nx - i > 1 across_gap from s where t < 0""",
)
def _(spark, d):
    long = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("pos"), "x").where(F.abs(F.col("x").cast("double")) > 0.02)
    return W.sign_changes(long, ["vec_id"], "pos", "x")


@query(
    "numbering_gaps",
    """with p as (select distinct l_suppkey, l_partkey from lineitem), g as (select *, lead(l_partkey) over (partition by l_suppkey order by l_partkey) nx from p)
    select l_suppkey, l_partkey before, nx after, nx - l_partkey - 1 n_missing from g where nx - l_partkey > 1""",
)
def _(spark, d):
    return W.gaps(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey")


@query(
    "islands",
    """with p as (select distinct l_suppkey, l_partkey from lineitem), g as (select *, case when l_partkey - lag(l_partkey) over (partition by l_suppkey order by l_partkey) <= 3 then 0 else 1 end f from p),
    k as (select *, sum(f) over (partition by l_suppkey order by l_partkey) r from g) select l_suppkey, min(l_partkey) lo, max(l_partkey) hi, count(*) n from k group by l_suppkey, r""",
)
def _(spark, d):
    return W.islands(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", 3)


@query(
    "interval_coverage",
    """with i as (select o_custkey k, o_orderkey % 500 lo, o_orderkey % 500 + 20 hi from orders), p as (select distinct k, unnest(range(lo, hi + 1)) q from i)
    select k, count(*) n_covered, (select count(*) from i where i.k = p.k) n_intervals from p group by k""",
)
def _(spark, d):
    i = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 500).alias("lo"), (F.col("o_orderkey") % 500 + 20).alias("hi"))
    return W.coverage(i, ["k"], "lo", "hi")


@query(
    "lag_one_autocorrelation",
    """with x as (select user_id, ts, event_id, value - avg(value) over (partition by user_id) x from events), y as (select *, lag(x) over (partition by user_id order by ts, event_id) y from x),
    g as (select user_id, count(*) n, sum(x * y) / nullif(sum(x * x), 0) r from y group by user_id)
    select user_id, n, round(r, 6) lag1, round(n * (1 - greatest(0, r)) / (1 + greatest(0, r)), 6) n_effective from g""",
)
def _(spark, d):
    x = W.lag_one(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    return x.select("user_id", "n", r6("lag1").alias("lag1"), r6("n_effective").alias("n_effective"))


@query("cumulative_overlap", "select vec_id, cast(i - 1 as integer) k, round(sqrt(sum(embedding[i]::double ** 2) over (partition by vec_id order by i)), 6) cumulative from embeddings, range(1, 65) r(i)")
def _(spark, d):
    long = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.doubles(F.col("embedding"))).alias("k", "x"))
    return W.cumulative_overlap(long, ["vec_id"], "k", "x").select("vec_id", "k", r6("cumulative").alias("cumulative"))


@query(
    "first_mode_reaching",
    """with c as (select vec_id, i - 1 k, sqrt(sum(embedding[i]::double ** 2) over (partition by vec_id order by i)) c from embeddings, range(1, 65) r(i))
    select vec_id, cast(min(case when c >= 0.8 then k end) as integer) first_0_8, cast(min(case when c >= 0.9 then k end) as integer) first_0_9 from c group by vec_id""",
)
def _(spark, d):
    long = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.doubles(F.col("embedding"))).alias("k", "x"))
    return W.first_reaching(W.cumulative_overlap(long, ["vec_id"], "k", "x"), ["vec_id"], "k", "cumulative", [0.8, 0.9])


@query(
    "local_gaps",
    """select o_orderkey, round(least(abs(o_totalprice - lag(o_totalprice) over w), abs(lead(o_totalprice) over w - o_totalprice)), 6) local_gap, round(o_totalprice / nullif(lag(o_totalprice) over w, 0), 6) ratio_to_previous
    from orders window w as (partition by o_custkey order by o_orderkey)""",
)
def _(spark, d):
    x = W.local_gap(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return x.select("o_orderkey", r6("local_gap").alias("local_gap"), r6("ratio_to_previous").alias("ratio_to_previous"))


@query("leave_one_out", "select o_orderkey, round(case when count(*) over w > 1 then (sum(o_totalprice) over w - o_totalprice) / (count(*) over w - 1) end, 4) mean_without from orders window w as (partition by o_custkey)")
def _(spark, d):
    return W.leave_one_out_mean(table(spark, d, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", F.round("mean_without", 4).alias("mean_without"))


@query(
    "circular_shift_test",
    """with c as (select c_nationkey h, row_number() over (partition by c_nationkey order by c_custkey) - 1 p, c_acctbal v, c_mktsegment = 'BUILDING' m, count(*) over (partition by c_nationkey) n from customer),
    g as (select s.h, s.p shift, sum(t.v) sv, count(t.v) k from c s, c q, c t where q.h = s.h and t.h = s.h and q.m and t.p = (q.p + s.p) % s.n group by s.h, s.p),
    tot as (select h, sum(v) t, count(*) c from c group by h), d as (select h, shift, sv / k - (t - sv) / nullif(c - k, 0) d from g join tot using (h)),
    o as (select h, d from d where shift = 0)
    select h c_nationkey, round(any_value(o.d), 6) observed, count(*) n_shifts, round(avg((abs(d.d) >= abs(o.d) - 1e-9)::int), 6) p_two_sided from d join o using (h) group by h""",
)
def _(spark, d):
    x = W.circular_shift(table(spark, d, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", F.col("c_mktsegment") == "BUILDING")
    return x.select("c_nationkey", r6("observed").alias("observed"), "n_shifts", r6("p_two_sided").alias("p_two_sided"))


@query(
    "empty_middle",
    """with e as (select event_type, value, case when user_id % 5 = 0 then 'closed' when user_id % 5 = 1 then 'open' end s from events),
    b as (select event_type, max(value) filter (s = 'closed') t, min(value) filter (s = 'open') b from e group by event_type)
    select event_type, round(t, 6) top, round(b, 6) bottom, count(*) filter (value between least(t + 0.15 * (b - t), t + 0.85 * (b - t)) and greatest(t + 0.15 * (b - t), t + 0.85 * (b - t))) n_middle from e join b using (event_type) group by all""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("s", F.when(F.col("user_id") % 5 == 0, "closed").when(F.col("user_id") % 5 == 1, "open"))
    return W.empty_middle(e, ["event_type"], "value", "s").withColumns({"top": r6("top"), "bottom": r6("bottom")})


@query(
    "periodic_unwrap",
    """with t as (select user_id, ts, event_id, value, coalesce(round((value - lag(value) over w) / 50.0), 0) k from events window w as (partition by user_id order by ts, event_id))
    select event_id, round(value - 50.0 * sum(k) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) unwrapped from t""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return W.unwrapped(e, ["user_id"], "at", "value", 50.0).select("event_id", r6("unwrapped").alias("unwrapped"))


# selection -----------------------------------------------------------------------------------------------------------
@query("multi_key_sort", "select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) place from orders")
def _(spark, d):
    from axisframe.operators.order import numbered

    o = table(spark, d, "orders")
    return numbered(o, [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")], "place").select("o_orderkey", (F.col("place") + 1).alias("place"))


@query("top_k_per_class", f"with {_EFFECTS} select * exclude (n) from (select *, row_number() over (partition by l_returnflag order by abs(effect) desc, l_partkey, l_linestatus) rank from effects) where rank <= 5")
def _(spark, d):
    return S.top_k(_effects(spark, d).drop("n"), ["l_returnflag"], [F.abs("effect").desc(), F.col("l_partkey"), F.col("l_linestatus")], 5)


@query("top_fraction", "select p_partkey, p_brand, rank from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) rank, count(*) over (partition by p_brand) n from part) where rank <= n * 0.2")
def _(spark, d):
    return S.top_fraction(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 0.2).select("p_partkey", "p_brand", "rank")


@query(
    "representatives",
    "select o_orderstatus, o_orderkey, place from (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) - 1 place, count(*) over (partition by o_orderstatus) n from orders) where place in (0, n // 4, n // 2, 3 * n // 4, n - 1)",
)
def _(spark, d):
    return S.representatives(table(spark, d, "orders"), ["o_orderstatus"], [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderstatus", "o_orderkey", "place")


@query("union_by_name", "select s_name as name, s_acctbal balance, null segment from supplier union all select c_name, c_acctbal, c_mktsegment from customer")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return S.union_all([a, b])


@query("intersect_keys", "select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R'")
def _(spark, d):
    line = table(spark, d, "lineitem")
    return line.where("l_returnflag = 'A'").select("l_partkey").intersect(line.where("l_returnflag = 'R'").select("l_partkey"))


@query("except_rows", "select o_custkey, o_orderpriority from orders except all select o_custkey, o_orderpriority from orders where o_totalprice > 100000")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderpriority").exceptAll(o.where("o_totalprice > 100000").select("o_custkey", "o_orderpriority"))


@query("keep_first", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) k from orders) where k = 1")
def _(spark, d):
    return S.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("relational_division", "select l_partkey % 40 item, count(distinct l_suppkey) n_holders from lineitem group by 1 having count(distinct l_suppkey) >= 0.95 * (select count(distinct l_suppkey) from lineitem)")
def _(spark, d):
    return S.divide(table(spark, d, "lineitem").withColumn("item", F.col("l_partkey") % 40), "item", "l_suppkey", 0.95)


@query("pivot_models", """select l_partkey, l_returnflag, max(case when l_linestatus = 'F' then round(effect, 6) + 0.0 end) as "F", max(case when l_linestatus = 'O' then round(effect, 6) + 0.0 end) as "O" from (""" + f"with {_EFFECTS} select * from effects) group by all")
def _(spark, d):
    return S.pivoted(_effects(spark, d).withColumn("effect", r6("effect") + 0.0), ["l_partkey", "l_returnflag"], "l_linestatus", ["F", "O"], "effect")


@query("packed_status", "select o_orderkey, 'a' condition, 'pass' status, 1 code from orders union all select o_orderkey, 'b', o_orderstatus, case when o_orderstatus = 'fail' then -1 else 0 end from orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("packed", F.concat(F.lit("a=pass;b="), "o_orderstatus"))
    return S.status_matrix(o, ["o_orderkey"], "packed")


@query("long_panel", "select s_suppkey, 'balance' record, s_acctbal value from supplier union all select s_suppkey, 'nation', s_nationkey from supplier")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return S.long_panel(s, ["s_suppkey"], ["balance", "nation"])


# scalars -------------------------------------------------------------------------------------------------------------
@query(
    "vector_scalars",
    """with q as (select vec_id, [x::double for x in embedding] v from embeddings), z as (select v from q order by vec_id limit 1)
    select vec_id, round(sqrt(list_dot_product(q.v, q.v)), 6) norm, round(list_dot_product(q.v, z.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(z.v, z.v))), 6) cosine from q, z""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("z"))  # one row
    return e.crossJoin(F.broadcast(first)).select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"), r6(V.cosine(F.col("embedding"), F.col("z"))).alias("cosine"))


@query(
    "role_contrasts",
    """with m as (select l_partkey, avg(l_quantity) filter (l_returnflag = 'A') a, avg(l_quantity) filter (l_returnflag = 'N') n, avg(l_quantity) filter (l_returnflag = 'R') r from lineitem group by l_partkey)
    select l_partkey, round(ln(n / a), 6) r_body, round(ln(r / n), 6) r_internal, round(ln(r / a), 6) r_total from m""",
)
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return m.select("l_partkey", r6(V.log_ratio(F.col("N"), F.col("A"))).alias("r_body"), r6(V.log_ratio(F.col("R"), F.col("N"))).alias("r_internal"), r6(V.log_ratio(F.col("R"), F.col("A"))).alias("r_total"))


@query(
    "text_normalisation",
    "select c_custkey, upper(trim(c_mktsegment)) segment, split_part(c_name, '#', 2) suffix, md5(c_name) digest, c_acctbal > 0 positive from customer",
)
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.upper(F.trim("c_mktsegment")).alias("segment"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("suffix"), F.md5(F.col("c_name").cast("binary")).alias("digest"), V.permissive_bool((F.col("c_acctbal") > 0).cast("string")).alias("positive"))


@query("json_navigation", "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), -1) k, strftime(ts, '%Y-%m-%d') day_text from events")
def _(spark, d):
    e = table(spark, d, "events")
    k = F.coalesce(F.from_json("props", "k double")["k"], F.lit(-1.0))
    return e.select("event_id", k.alias("k"), V.iso_date(F.col("ts").cast("string")).alias("day_text"))
