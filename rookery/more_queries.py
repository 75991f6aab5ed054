"""Queries for attribution, frames, verdicts and sheets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import predicates as P
from rookery.operators import attribution, frames, ownership, sheets, verdicts
from rookery.plans.fixtures import tasks_for_links
from rookery.plans.staging import staged
from rookery.queries import _BFS, _TIES, _UP, _edges, _held, _holds, _ids, _items, _roots, _table, query

# ---- predicates


@query(
    """select id, kind in ('struct','enum','union','static') is_data, kind in ('fn','macro') is_callable, vis in ('pub','pub(crate)','pub(super)','pub(in)') admitted,
 case vis when 'pub' then 'pub' when 'pub(crate)' then 'crate' when '' then 'all' else 'super' end showing,
 case when id % 17 = 0 then 'ghost' when id % 5 = 0 then 'changed' when size <= 10 then 'member' when id % 3 = 0 then 'downstream' else 'external' end class from fx_item""",
    "fx_item",
)
def q_node_predicates(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    cls = P.node_class(F.col("size") <= 10, F.when(i % 5 == 0, 2).otherwise(0), i % 17 == 0, F.when(i % 3 == 0, 1))
    return _items(s, d).select("id", P.is_data(F.col("kind")).alias("is_data"), P.is_callable(F.col("kind")).alias("is_callable"), P.admits(F.col("vis"), "super").alias("admitted"), P.showing(F.col("vis")).alias("showing"), cls.alias("class"))


# ---- attribution


def _refs(s: SparkSession, d: str) -> DataFrame:
    m = _items(s, d).select("id", "module")
    at = lambda c: m.select(F.col("id").alias(c), F.col("module").alias(f"{c}_m"))
    e = _edges(s, d).join(at("src"), "src").join(at("dst"), "dst")
    return e.select("src", "dst", "w", (F.col("src_m") == F.col("dst_m")).alias("same_file"))


@query(
    "select dst, cast(sum(w) as bigint) fan_in from fx_edge join fx_item a on a.id = src join fx_item b on b.id = dst where a.module <> b.module group by dst",
    "fx_edge", "fx_item",
)
def q_fan_in(s: SparkSession, d: str) -> DataFrame:
    return attribution.fan_in(_refs(s, d))


@query(
    """with l as (select case when src % 10 = 5 then src - 5 else src end src, dst, a.module = b.module same_file, w from fx_edge join fx_item a on a.id = src join fx_item b on b.id = dst)
select src, dst, same_file, cast(sum(w) as bigint) w from l where src <> dst group by all""",
    "fx_edge", "fx_item",
)
def q_lifted_refs(s: SparkSession, d: str) -> DataFrame:
    impl = _items(s, d).where("id % 10 = 5").select(F.col("id").alias("impl"), (F.col("id") - 5).alias("self_mark"))
    return attribution.lifted(_refs(s, d), impl)


@query("select id node, coalesce(parent, id) root from fx_item", "fx_item")
def q_container_root(s: SparkSession, d: str) -> DataFrame:
    return attribution.container_root(_items(s, d).select("id", "parent"))


@query("select module path, id, cast(row_number() over (order by module, id, size desc) - 1 as bigint) nth from fx_item", "fx_item")
def q_item_ids(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d).select(F.col("module").alias("path"), F.col("id").alias("start"), F.col("size").alias("end"))
    return attribution.numbered(items).select("path", F.col("start").alias("id"), F.col("id").cast("long").alias("nth"))


@query(
    """with f as (select src, dst, kind, 'f' || w as name, case kind when 'build' then 1 when 'dev' then 3 else 0 end rank, w ord from fx_edge),
 b as (select *, row_number() over (partition by src, name, dst order by rank desc, ord) k from f)
select src, dst, kind, count(*) n_fields, string_agg(name, ',' order by ord) names from b where k = 1 group by src, dst, kind""",
    "fx_edge",
)
def q_hold_edges(s: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("kind") == "build", 1).when(F.col("kind") == "dev", 3).otherwise(0)
    name = F.concat(F.lit("f"), F.col("w").cast("string"))
    f = _edges(s, d).select("src", "dst", "kind", F.lit("").alias("via"), F.lit(False).alias("from_method"), name.alias("name"), F.lit("").alias("decl"), rank.alias("rank"), F.col("w").alias("ord"))
    return attribution.hold_edges(f).select("src", "dst", "kind", F.size("fields").cast("long").alias("n_fields"), F.array_join(F.transform("fields", lambda x: x["name"]), ",").alias("names"))


# ---- frames


def _homes(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select(F.col("id").alias("node"), F.lit("k").alias("krate"), F.array("crate", "module").alias("path"))


@query(
    """select 'k' krate, '' frame, cast(null as varchar) parent, 0 as depth, 0 own, count(*) held from fx_item
union all select 'k', crate, '', 1, 0, count(*) from fx_item group by crate
union all select 'k', crate || '/' || module, crate, 2, count(*), count(*) from fx_item group by crate, module""",
    "fx_item",
)
def q_frame_tree(s: SparkSession, d: str) -> DataFrame:
    return frames.frame_tree(_homes(s, d))


@query(
    """select id node, case when crate in ('1', '3') then crate when module in ('Brand#21', 'Brand#13') then crate || '/' || module end box,
 case when module = 'Brand#13' then '1,1/Brand#13' when crate in ('1', '3') then crate when module = 'Brand#21' then '2/Brand#21' end reveal from fx_item""",
    "fx_item",
)
def q_fold_box(s: SparkSession, d: str) -> DataFrame:
    folds = s.sql("select * from values ('k', '1'), ('k', '3'), ('k', '2/Brand#21'), ('k', '1/Brand#13') as t(krate, frame)")
    homes = _homes(s, d)
    reveal = frames.reveal_path(homes, folds).select("node", F.array_join("frames", ",").alias("reveal"))
    return frames.fold_box(homes, folds).join(reveal, "node")


@query(
    """with f as (select dst ghost, min(src) dropper from fx_edge where kind = 'dev' group by dst), r as (select *, row_number() over (partition by dropper order by ghost) - 1 seat from f)
select ghost, dropper, cast(seat as integer) seat, case when seat % 2 = 0 then 1 else -1 end * 0.22 * floor(seat / 2.0 + 1) turn from r""",
    "fx_edge",
)
def q_ghost_seats(s: SparkSession, d: str) -> DataFrame:
    drops = _edges(s, d).where("kind = 'dev'").select(F.col("dst").alias("ghost"), F.col("src").alias("dropper"))
    return frames.ghost_seats(drops).withColumn("turn", F.col("turn").cast("double"))


@query(
    f"""with {_TIES}, h as (select dst src, src dst from fx_edge), one as (select min(id) node from fx_item where id in (select dst from fx_edge where src <> dst) and id in (select definition from k)),
 seed as (select node from one), {_UP}, {_BFS},
 x as (select node, 'sel' light, 0 r from one union all select node, 'up', 1 from d where hops > 0 union all select dst, 'down', 2 from fx_edge where src = (select node from one)
  union all select holder, 'near', 3 from k where definition = (select node from one))
select node, arg_min(light, r) light from x group by node""",
    "fx_edge", "fx_item",
)
def q_lit(s: SparkSession, d: str) -> DataFrame:
    edges = staged(_edges(s, d), "links")  # read by each part of what is lit, made once
    ties = staged(ownership.ties(edges, _roots(s, d), _ids(_items(s, d), "true"), tasks_for_links(s, d)), "ties")
    held = edges.where("src <> dst").select(F.col("dst").alias("node")).distinct()
    start = held.join(ties.select(F.col("definition").alias("node")).distinct(), "node", "left_semi").agg(F.min("node").alias("node"))
    return frames.lit(staged(start, "start"), _held(edges), ties, "in")


# ---- verdicts


@query(
    """with h as (select e.src, e.dst, e.kind, e.w, a.size sa, b.size sb from fx_edge e join fx_item a on a.id = src join fx_item b on b.id = dst)
select src, dst, kind, case when sa % 9 = 1 or sb % 9 = 1 or (sa % 9 = 2 and w = 1) then 'added' end event from h""",
    "fx_edge", "fx_item",
)
def q_added_holds(s: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("size") % 9 == 1, "added").when(F.col("size") % 9 == 2, "changed")
    deltas = _items(s, d).select(F.col("id").alias("node"), delta.alias("delta"))
    fields = F.array(F.struct(F.concat(F.lit("f"), F.col("w").cast("string")).alias("name"), F.lit("").alias("decl")))
    new = _items(s, d).where("size % 9 = 2").select(F.col("id").alias("item"), F.lit("f1").alias("name"))
    return verdicts.added_holds(_edges(s, d).select("src", "dst", "kind", fields.alias("fields")), deltas, new).select("src", "dst", "kind", "event")


@query(
    """with m as (select distinct module from fx_item where size = 1 and crate = '2'), l as (select list(module order by module) m from m)
select case when len(m) <= 1 then array_to_string(m, '') else array_to_string(m[1:len(m) - 1], ', ') || ' and ' || m[len(m)] end modules from l""",
    "fx_item",
)
def q_landing(s: SparkSession, d: str) -> DataFrame:
    return verdicts.landing(_items(s, d).where("size = 1 and crate = '2'"))


# ---- sheets


@query(
    """with n as (select min(p_name) pick from part), l as (select a.p_name sn, b.p_name dn, kind from fx_edge join part a on a.p_partkey = src join part b on b.p_partkey = dst),
 x as (select distinct 'used by' side, sn as name, kind from l, n where dn = pick union select distinct 'depends on', dn, kind from l, n where sn = pick),
 y as (select *, cast(null as varchar) event, cast(row_number() over (partition by side order by kind, name) as integer) place, count(*) over (partition by side) total from x)
select * from y where place <= 14""",
    "fx_edge",
)
def q_crate_focus(s: SparkSession, d: str) -> DataFrame:
    names = _items(s, d).select(F.col("id").alias("node"), "name")
    pick = names.agg(F.min("name")).head()[0]
    return sheets.crate_focus(_edges(s, d).withColumn("event", F.lit(None).cast("string")), names, pick)


_PICK = "(select min(dst) from fx_edge where src <> dst)"


def _pick(s: SparkSession, d: str) -> int:
    return _edges(s, d).where("src <> dst").agg(F.min("dst")).head()[0]


@query(
    f"""with seed as (select {_PICK} node), {_UP}, {_BFS}
select 'called by' list, src other, cast(sum(w) as bigint) n from fx_edge where dst = {_PICK} and src <> dst group by src
union all select 'calls', dst, cast(sum(w) as bigint) from fx_edge where src = {_PICK} and src <> dst group by dst
union all select 'upstream', node, hops from d where hops > 1""",
    "fx_edge",
)
def q_function_sheet(s: SparkSession, d: str) -> DataFrame:
    return sheets.function_sheet(_edges(s, d), _pick(s, d))


@query(
    """with p as (select parent container, count(*) methods from fx_item where parent is not null group by parent),
 e as (select w, a.parent sp, b.parent dp from fx_edge left join fx_item a on a.id = src left join fx_item b on b.id = dst where a.parent is distinct from b.parent)
select container, methods, coalesce((select cast(sum(w) as bigint) from e where dp = container), 0) calls_in, coalesce((select cast(sum(w) as bigint) from e where sp = container), 0) calls_out from p""",
    "fx_edge", "fx_item",
)
def q_owner_sheet(s: SparkSession, d: str) -> DataFrame:
    return sheets.owner_sheet(_edges(s, d), _items(s, d).select(F.col("id").alias("node"), "parent"))


@query(
    f"""with {_TIES}, h as (select src, dst, case kind when 'normal' then 'owns' when 'dev' then 'shares' else 'borrows' end word from fx_edge),
 x as (select 'used by' side, src other, 0 o, word from h where dst = {_PICK} and src <> dst union select 'uses', dst, 0, word from h where src = {_PICK} and src <> dst
  union select 'used by', holder, 1, 'names' from k where definition = {_PICK} union select 'uses', definition, 1, 'names' from k where holder = {_PICK})
select side, other, string_agg(word, ' · ' order by o, word) words from x group by all""",
    "fx_edge", "fx_item",
)
def q_data_sheet(s: SparkSession, d: str) -> DataFrame:
    ties = ownership.ties(_edges(s, d), _roots(s, d), _ids(_items(s, d), "true"))
    return sheets.data_sheet(_holds(s, d), ties, _pick(s, d))


@query(f"with seed as (select {_PICK} node), {_UP}, {_BFS} select count(*) filter (where hops = 1) direct, count(*) filter (where hops > 1) beyond from d", "fx_edge")
def q_data_reach(s: SparkSession, d: str) -> DataFrame:
    return sheets.data_reach(_holds(s, d), _pick(s, d))


@query(
    "select count(*) filter (where id in (select user_id from events)) seen, count(*) total from fx_item where size <= 10",
    "fx_item",
)
def q_seen_of(s: SparkSession, d: str) -> DataFrame:
    return sheets.seen_of(_table(s, d, "events").select(F.col("user_id").alias("node")), _ids(_items(s, d), "size <= 10"))
