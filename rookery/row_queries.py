"""Queries for row-level operators: files, holders' rows, boxes, verdicts and words, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions import lexing
from rookery.functions import text as T
from rookery.functions.lexing import KEYWORDS
from rookery.more_queries import _homes, _refs
from rookery.operators import attribution, frames, lexer, names, verdicts
from rookery.plans.fixtures import relation
from rookery.queries import _SPANS, _edges, _ids, _items, _spans, _table, query

_DATA = "kind in ('struct', 'enum', 'union', 'static')"


# ---- files and references


@query(
    """with x as (select case when id % 7 = 0 then 'target/' else '' end || module || '/' || id % 40 || case when id % 3 = 0 then '.txt' else '.rs' end path, 'c' || id % 5 krate from fx_item)
select path, min(krate) krate from x where ends_with(path, '.rs') and not starts_with(path, 'target/') group by path""",
    "fx_item",
)
def q_source_files(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    path = F.concat(F.when(i % 7 == 0, "target/").otherwise(""), "module", F.lit("/"), (i % 40).cast("string"), F.when(i % 3 == 0, ".txt").otherwise(".rs"))
    return attribution.files_of(_items(s, d).select(path.alias("path"), F.concat(F.lit("c"), (i % 5).cast("string")).alias("krate")))


@query("select src, dst, cast(sum(w) as bigint) w from fx_edge where src <> dst group by src, dst", "fx_edge")
def q_pair_counts(s: SparkSession, d: str) -> DataFrame:
    return attribution.pair_counts(_refs(s, d))


@query(
    f"""with {_SPANS}, pt as (select doc_id file, k * 170 as pos from documents, unnest(range(0, 1 + coalesce(length(text), 0) // 170)) t(k))
select file, pos from pt where not exists (select 1 from sp where sp.file = pt.file and sp.id % 5 = 0 and pos >= sp.start and pos < sp."end")"""
)
def q_outside_ranges(s: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.coalesce(F.length("text"), F.lit(0)) / 170).cast("long")
    points = _table(s, d, "documents").select(F.col("doc_id").alias("file"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: k * 170)).alias("at"))
    return attribution.outside(points, _spans(s, d).where("id % 5 = 0")).withColumnRenamed("at", "pos")


@query(
    """with k as (select distinct module path, name as label from fx_item union all select distinct module, 'none' from fx_item)
select k.path, k.label, (select min(id) from fx_item where module = k.path and name = k.label) id from k""",
    "fx_item",
)
def q_declared(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d).select(F.col("module").alias("path"), F.col("name").alias("label"), "id")
    keys = items.select("path", "label").distinct()
    return attribution.declared(items, keys.unionByName(items.select("path", F.lit("none").alias("label")).distinct()))


@query(
    f"""with r as (select distinct src item, 'f' || w as name from fx_edge union select id, 'none' from fx_item),
 f as (select src item, 'f' || w as name, min(dst) held from fx_edge group by all)
select item, name, held, coalesce(held in (select id from fx_item where {_DATA}) and held <> item, false) linked from r left join f using (item, name)""",
    "fx_edge", "fx_item",
)
def q_row_targets(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("w").cast("string")).alias("name")
    edges, items = _edges(s, d), _items(s, d)
    rows = edges.select(F.col("src").alias("item"), name).distinct().unionByName(items.select(F.col("id").alias("item"), F.lit("none").alias("name")))
    holds = edges.select("src", "dst", F.col("dst").alias("ord"), F.array(F.struct(name)).alias("fields"))
    return attribution.row_targets(rows, holds, _ids(items, _DATA))


# ---- boxes


@query(
    """with b as (select case when crate in ('1', '3') then crate when module in ('Brand#21', 'Brand#13') then crate || '/' || module end box from fx_item)
select box, count(*) n from b where box is not null group by box""",
    "fx_item",
)
def q_packed(s: SparkSession, d: str) -> DataFrame:
    folds = s.sql("select * from values ('k', '1'), ('k', '3'), ('k', '2/Brand#21'), ('k', '1/Brand#13') as t(krate, frame)")
    return frames.packed(_homes(s, d), folds)


@query("select id node from fx_item where crate = '1'", "fx_item")
def q_inside_frame(s: SparkSession, d: str) -> DataFrame:
    return frames.inside_frame(_homes(s, d), ["1"])


def _containers(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    methods = items.where("parent is not null").select(F.col("id").alias("node"), F.col("parent").alias("owner"), F.col("module").alias("file"), F.col("size").alias("line"))
    return frames.containers(methods, _homes(s, d).select("node", "path"))


@query(
    """select p.id as "owner", p.crate || '/' || p.module frame, string_agg(cast(m.id as varchar), ',' order by m.module, m.size, m.id) methods
from fx_item m join fx_item p on p.id = m.parent group by all""",
    "fx_item",
)
def q_containers(s: SparkSession, d: str) -> DataFrame:
    methods = F.array_join(F.transform("methods", lambda m: m.cast("string")), ",")
    return _containers(s, d).select("owner", F.array_join("path", "/").alias("frame"), methods.alias("methods"))


@query(
    "select id node, case when parent in (select id from fx_item) then 'owner ' || parent else 'frame ' || crate || '/' || module end home from fx_item",
    "fx_item",
)
def q_homes(s: SparkSession, d: str) -> DataFrame:
    marks = _items(s, d).select(F.col("id").alias("node"), F.col("parent").alias("owner"), F.array("crate", "module").alias("path"))
    return frames.homes(marks, _containers(s, d))


# ---- verdicts


@query(
    """with v as (select module path, kind, cast(id as varchar) as name, (id % 4 <> 0 or vis = 'pub') and id % 6 <> 0 signature, id % 5 <> 0 and id % 7 <> 0 body from fx_item where id % 9 <> 0)
select path, kind, name, case when case when kind in ('fn', 'trait') then signature else body end then 'same' else 'changed' end verdict from v""",
    "fx_item",
)
def q_changed_verdict(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    key = [F.col("module").alias("path"), "kind", i.cast("string").alias("name")]
    none = F.lit("")
    base = _items(s, d).where("id % 9 <> 0").select(*key, "vis", F.col("name").alias("rows"), none.alias("result"), F.col("name").alias("text"), none.alias("methods"))
    other = lambda by, text, new: F.when(i % by == 0, new).otherwise(text)
    live = _items(s, d).select(
        *key, other(4, F.col("vis"), F.lit("pub")).alias("vis"), other(6, F.col("name"), F.concat("name", F.lit("x"))).alias("rows"), none.alias("result"),
        other(5, F.col("name"), F.concat("name", F.lit(" y"))).alias("text"), other(7, none, F.lit("m")).alias("methods"),
    )
    return verdicts.changed(base, live)


@query(
    """with b as (select src, dst, kind, kind = 'dev' from_method, w from hop where first_ts < timestamp '1999-01-01 00:00:00'),
 l as (select src, dst, kind = 'dev' from_method from hop where last_ts >= timestamp '1998-01-01 00:00:00'),
 g as (select b.*, w + k ord from b, unnest([0, 1]) u(k) where src <> dst and not exists (select 1 from l where l.src = b.src and l.dst = b.dst and l.from_method = b.from_method))
select src, dst, kind, from_method, string_agg('f' || ord, ',' order by ord) names, 'removed' event from g group by src, dst, kind, from_method""",
    "hop",
)
def q_removed_holds(s: SparkSession, d: str) -> DataFrame:
    hop = relation(s, d, "hop").withColumn("from_method", F.col("kind") == "dev")
    dropped = hop.where("first_ts < timestamp '1999-01-01 00:00:00'").withColumn("ord", F.explode(F.array(F.col("w"), F.col("w") + 1)))
    dropped = dropped.select("src", "dst", "kind", "from_method", "ord", F.concat(F.lit("f"), F.col("ord").cast("string")).alias("name"))
    gone = verdicts.removed_holds(dropped, hop.where("last_ts >= timestamp '1998-01-01 00:00:00'"))
    return gone.select("src", "dst", "kind", "from_method", F.array_join("fields", ",").alias("names"), "event")


_DROPPED = """w as (select distinct l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_partkey as "row", l_suppkey src, l_linenumber ord, 'f' || l_linenumber as name, l_partkey a, l_linenumber k, l_linenumber % 2 = 0 from_method from lineitem),
 x as (select *, case k when 1 then 'Arc<T' || a || ', Vec<T' || (a + 7) || '>>' when 2 then '&T' || a when 3 then 'Box<dyn T' || a || '>' when 4 then 'T' || a || ' { of: T' || (a + 1) || ', T' || (a + 1) || ' }'
   when 5 then 'Memo<é_T' || a || '>' when 6 then '&mut dyn Fn(Rc<T' || a || '>) -> Weak<T' || (a + 2) || '>' else '(T' || a || ', T' || (a + 3) || ')' end as text, k = 4 skip_leading from w),
 nm as (select p_partkey id, 'T' || p_partkey as name from part union all select p_partkey + 100000000, 'T' || (p_partkey + 1) from part where p_size = 1 union all select 0, 'Memo'),
 nk as (select name, case when count(*) = 1 then min(id) end id, count(*) > 1 several from nm group by name),
 tk as (select "row", skip_leading, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) as word, generate_subscripts(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), 1) ps from x),
 tt as (select * from tk where not (skip_leading and ps = 1)),
 ht as (select "row", id, several, min(ps) ps, count(*) n from tt join nk on nk.name = tt.word group by all),
 fd as (select "row", list(id order by ps) filter (where not several) targets, cast(coalesce(sum(n) filter (where several), 0) as bigint) ambiguous from ht group by "row"),
 st as (select "row", ps, word, case word when 'dyn' then 2 else 3 end rank from tt where word in ('dyn','Arc','Rc','Weak','Signal','GlobalSignal','ReadSignal','Memo','Resource') and word not in (select name from nk)),
 wp as (select "row", max(rank) rank, arg_min(word, (-rank, ps)) as word from st group by "row"),
 wk as (select x."row", case when coalesce(wp.rank, 0) > pl then list_extract(['owns','borrows','dyn','shares'], wp.rank + 1) when pl = 1 then 'borrows' else 'owns' end kind,
   case when coalesce(wp.rank, 0) > pl then wp.word when pl = 1 then '&' else '' end via, coalesce(targets, []) targets, coalesce(ambiguous, 0) ambiguous
  from (select *, case when text like '%&%' then 1 else 0 end pl from x) x left join wp using ("row") left join fd using ("row"))"""


def _dropped_rows(s: SparkSession, d: str) -> DataFrame:
    a, k = F.col("l_partkey"), F.col("l_linenumber")
    t = lambda n: F.concat(F.lit("T"), (a + n).cast("string"))
    text = (
        F.when(k == 1, F.concat(F.lit("Arc<"), t(0), F.lit(", Vec<"), t(7), F.lit(">>"))).when(k == 2, F.concat(F.lit("&"), t(0))).when(k == 3, F.concat(F.lit("Box<dyn "), t(0), F.lit(">")))
        .when(k == 4, F.concat(t(0), F.lit(" { of: "), t(1), F.lit(", "), t(1), F.lit(" }"))).when(k == 5, F.concat(F.lit("Memo<é_"), t(0), F.lit(">")))
        .when(k == 6, F.concat(F.lit("&mut dyn Fn(Rc<"), t(0), F.lit(">) -> Weak<"), t(2), F.lit(">"))).otherwise(F.concat(F.lit("("), t(0), F.lit(", "), t(3), F.lit(")")))
    )
    rows = _table(s, d, "lineitem")
    return rows.select(F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")]).alias("row"), F.col("l_suppkey").alias("src"), k.alias("ord"), F.concat(F.lit("f"), k.cast("string")).alias("name"), text.alias("text"), (k == 4).alias("skip_leading"), (k % 2 == 0).alias("from_method")).distinct()


def _part_names(s: SparkSession, d: str) -> DataFrame:
    part = _table(s, d, "part")
    t = lambda n: F.concat(F.lit("a::b::T"), (F.col("p_partkey") + n).cast("string")).alias("name")
    own = part.select(F.col("p_partkey").alias("id"), F.lit("struct").alias("kind"), t(0))
    again = part.where("p_size = 1").select((F.col("p_partkey") + 100_000_000).alias("id"), F.lit("trait").alias("kind"), t(1))
    functions = part.select((F.col("p_partkey") + 200_000_000).alias("id"), F.lit("fn").alias("kind"), t(0))  # no kind that a row can name
    word = own.agg(F.lit(0).cast("long").alias("id")).select("id", F.lit("enum").alias("kind"), F.lit("Memo").alias("name"))
    return names.known_names(own.where("id % 11 <> 0").unionByName(functions).unionByName(word), own.where("id % 11 = 0").unionByName(again))


@query(f"""with {_DROPPED} select "row", kind, via, array_to_string(targets, ',') targets, ambiguous from wk""")
def q_name_walk(s: SparkSession, d: str) -> DataFrame:
    return names.name_walk(_dropped_rows(s, d), _part_names(s, d)).withColumn("targets", F.array_join(F.transform("targets", lambda t: t.cast("string")), ","))


@query(
    f"""with {_DROPPED}, lv as (select distinct l_suppkey src, l_partkey dst, l_linenumber % 2 = 0 from_method from lineitem where l_returnflag = 'N'),
 dr as (select distinct src, t.dst, kind, via, from_method, ord, name from (select "row", kind, via, unnest(targets) dst from wk) t join x using ("row") where src <> t.dst)
select src, dst, kind, via, from_method, string_agg(name, ',' order by ord) fields, 'removed' event from dr where not exists (select 1 from lv where lv.src = dr.src and lv.dst = dr.dst and lv.from_method = dr.from_method) group by src, dst, kind, via, from_method"""
)
def q_dropped_holds(s: SparkSession, d: str) -> DataFrame:
    live = _table(s, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_linenumber") % 2 == 0).alias("from_method"))
    return names.dropped_holds(_dropped_rows(s, d), _part_names(s, d), live).withColumn("fields", F.array_join("fields", ","))


_FILES = r"""t as (select doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z \n]', '', 'g') as txt from documents where doc_id is not null),
 p as (select doc_id, 'comment' as class, unnest(string_split('/* a /* b */ ' || txt || ' */', chr(10))) part from t union all select doc_id, 'str', unnest(string_split('"' || txt || '"', chr(10))) from t
  union all select doc_id, 'space', unnest(regexp_extract_all(txt, ' +')) from t),
 w as (select doc_id, unnest(regexp_extract_all(txt, '[A-Za-z]+')) part, generate_subscripts(regexp_extract_all(txt, '[A-Za-z]+'), 1) k from t),
 n as (select doc_id, part, lag(part) over (partition by doc_id order by k) before from w)"""


@query(
    f"""with {_FILES} select doc_id, class, count(*) n, cast(sum(length(part)) as bigint) chars from (select * from p where part <> '' union all
 select doc_id, case when part in ({", ".join(f"'{k}'" for k in KEYWORDS)}) then 'kw' when before = 'fn' then 'fn' when part[1] between 'A' and 'Z' then 'type' else 'ident' end, part from n) x group by doc_id, class"""
)
def q_file_runs(s: SparkSession, d: str) -> DataFrame:
    kept = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z \n]", "")
    # bound as a lambda's variable, so that it is computed once
    whole = F.get(F.transform(F.array(kept), lambda text: F.concat(F.lit("/* a /* b */ "), text, F.lit(" */\n"), text, F.lit('\n"'), text, F.lit('"'))), F.lit(0))
    files = _table(s, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("file"), whole.alias("text"), (F.coalesce(F.length("text"), F.lit(0)) * 3 + 30).alias("at_most"))
    runs = lexer.file_runs(files, 1_000)
    return runs.groupBy(F.col("file").alias("doc_id"), "class").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    """with t as (select doc_id, regexp_replace(left(coalesce(text, ''), 400), '[^A-Za-z ]', '', 'g') as b from documents),
 l as (select doc_id, b, length(b) n, repeat(' ', cast(doc_id % 3 as integer)) pre from t)
select doc_id, case when doc_id % 4 = 0 then '' else 'impl ' || b || ' {|' end || '    fn ' || b || ' {' || chr(10) || '    }' || case when doc_id % 5 = 0 then '' else '|}' end quote from l where doc_id % 4 <> 0
union all select doc_id, 'fn ' || b || ' {' || chr(10) || '}' || case when doc_id % 5 = 0 then '' else '|' end from l where doc_id % 4 = 0"""
)
def q_item_source(s: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(400)), "[^A-Za-z ]", "")
    doc = F.col("doc_id")
    pre = F.repeat(F.lit(" "), (doc % 3).cast("int"))
    head = F.concat(F.when(doc % 4 == 0, "no brace").otherwise(F.concat(F.lit("impl "), body, F.lit(" {"))))
    lead = F.concat(F.lit("// before\n"), pre)
    item = F.concat(F.lit("fn "), body, F.lit(" {\n"), pre, F.lit("    }"))
    until = F.concat(lead, head, F.lit("\n"), pre, F.lit("    "))
    whole = F.concat(until, item, F.lit("\n"), pre, F.when(doc % 5 == 0, ";").otherwise("}"))
    rows = _table(s, d, "documents").select("doc_id", whole.alias("text"), F.length(until).alias("start"), (F.length(until) + F.length(item)).alias("end"), F.length(lead).alias("owner_start"), F.length(whole).alias("owner_end"))
    return lexing.item_source(rows).select("doc_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "|").alias("quote"))


# ---- words


@query(
    r"""with x as (select id, size, trim(regexp_replace(name || '   ' || name || ' of ' || module || '  ' || name, '\s+', ' ', 'g')) flat from fx_item)
select id, case when length(flat) <= 48 then flat else left(flat, 48) || '…' end short, size || case when size = 1 then ' crate' else ' crates' end crates, size || case when size = 1 then ' box' else ' boxes' end boxes,
 least(sqrt(size) * 1.3::double + 4, 11.0::double) radius, greatest(0.85::double - (size - 1) * 0.22::double, 0.3::double) opacity from x""",
    "fx_item",
)
def q_words(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat("name", F.lit("   "), "name", F.lit(" of "), "module", F.lit("  "), "name")
    n = F.col("size")
    return _items(s, d).select(
        "id", T.compact(raw).alias("short"), T.plural(n, "crate").alias("crates"), T.plural(n, "box").alias("boxes"),
        T.star_radius(n).alias("radius"), T.halo_opacity(n).alias("opacity"),
    )
