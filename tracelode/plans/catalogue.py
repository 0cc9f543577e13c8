"""The registered queries over code graphs and the SQL that they are held against.

Queries run the library's operators on the projected graph; the SQL says the same in other words, on the
same tables, in the other engine's dialect. Whole numbers are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import build, resolve, verbs, walk
from ..operators.intervals import innermost
from ..schema import CALL, DECL, DEF, REF, Graph
from ..sources.index import missing_from
from .project import graph, prelude, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NAME, PART, BRAND = "red plate", "widget", "Brand#7::"
CUSTOMER, SUPPLIER = "Customer#000000007", "Supplier#000000003"


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes])


def _register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _long(query(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = prelude() + ",\n" + sql if sql.lstrip().startswith("own as") else prelude() + "\n" + sql


def on_graph(name: str, query: Callable[[Graph], DataFrame], sql: str) -> None:
    _register(name, lambda spark, sf_dir: query(graph(spark, sf_dir)), sql)


def on_views(name: str, query: Callable[[dict[str, DataFrame]], DataFrame], sql: str) -> None:
    _register(name, lambda spark, sf_dir: query(views(spark, sf_dir)), sql)


# SQL of the parts that verbs share

EXACT = "select sym, row_number() over (order by sym) as seq from (select distinct sym from pg_names where name = '{0}')"
SUBSTR = "select sym, row_number() over (order by n, sym) as seq from (select sym, min(name) as n from pg_names where contains(name, '{0}') group by sym order by n, sym limit {1})"
FOLDED = "select sym, row_number() over (order by n, sym) as seq from (select sym, min(name) as n from pg_names where contains(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{0}') group by sym order by n, sym limit {1})"
ROLE = "case {0} when 0 then 'decl' when 1 then 'def' when 2 then 'ref' when 3 then 'call' else '?' end"
KIND = "case {0} when 1 then 'fn' when 2 then 'type' when 3 then 'var' when 4 then 'field' when 5 then 'pkg' else '?' end"
LANG = "case {0} when 1 then 'cxx' when 2 then 'java' when 3 then 'jvm' when 4 then 'go' when 5 then 'proto' when 6 then 'rust' when 7 then 'kt' else '?' end"
KEY = "case when starts_with({0}, 'kythe:') then split_part({0}, '#', -1) else {0} end"
FIRST_PATH = "select sym, path as def_path from (select x.sym, f.path, row_number() over (partition by x.sym order by x.role, x.file, x.off) as nth from pg_xrefs x join pg_files f on x.file = f.file where x.role in (0, 1)) where nth = 1"
PLACE = "select sym, path, off from (select x.sym, f.path, x.off, row_number() over (partition by x.sym order by case when x.role = 1 then 0 else 1 end, x.file, x.off) as nth from pg_xrefs x join pg_files f on x.file = f.file where x.role in (0, 1)) where nth = 1"


def sites_sql(syms: str, low: int, high: int, hits: int | None = None, where: str = "true", def_in: str | None = None, typed: bool = False) -> str:
    kept = f"own as ({syms}), dp as ({FIRST_PATH}), kept as (select o.* from own o " + (f"join dp on dp.sym = o.sym and contains(dp.def_path, '{def_in}')" if def_in else "") + ")"
    cut = f"qualify row_number() over (order by k.seq, x.role, x.file, x.off) <= {hits}" if hits else ""
    extra = ", t.typed, g.sig" if typed else ""
    joins = "left join pg_typed t on t.sym = k.sym left join pg_sig g on g.sym = k.sym" if typed else ""
    return f"""{kept}
select k.seq as group_seq, s.name, {KIND.format('s.kind')} as kind, {LANG.format('s.lang')} as lang{extra}, {ROLE.format('x.role')} as role, f.path as file, x.off
from kept k join pg_xrefs x on x.sym = k.sym join pg_syms s on s.sym = k.sym join pg_files f on f.file = x.file {joins}
where x.role between {low} and {high} and {where} {cut}"""


on_graph("stat", verbs.stat, "select (select count(*) from pg_xrefs) as xrefs, (select count(*) from pg_syms) as syms, (select count(*) from pg_files) as files, (select count(*) from pg_inh) as inhs, (select count(*) from pg_calls) as calls")
on_graph("def_exact", lambda g: verbs.define(g, f"{BRAND}{NAME}"), sites_sql(EXACT.format(f"{BRAND}{NAME}"), DECL, DEF, typed=True))
on_graph("def_ambiguous", lambda g: verbs.define(g, NAME), sites_sql(EXACT.format(NAME), DECL, DEF, typed=True))
on_graph("def_substr", lambda g: verbs.define(g, PART, substr=True), sites_sql(SUBSTR.format(PART, 16), DECL, DEF, typed=True))
on_graph("def_substr_ci", lambda g: verbs.define(g, "bRANd#2::Hot", substr=True, ignore_case=True, limit=20), sites_sql(FOLDED.format("brand#2::hot", 20), DECL, DEF, typed=True))
on_graph("def_in", lambda g: verbs.define(g, NAME, in_="ASIA/"), sites_sql(EXACT.format(NAME), DECL, DEF, where="contains(f.path, 'ASIA/')", typed=True))
on_graph("def_not_in", lambda g: verbs.define(g, NAME, in_="NATION_1", not_in="ASIA/"), sites_sql(EXACT.format(NAME), DECL, DEF, where="contains(f.path, 'NATION_1') and not contains(f.path, 'ASIA/')", typed=True))
on_graph("ref_all", lambda g: verbs.refs(g, NAME, max_hits=None), sites_sql(EXACT.format(NAME), 0, 255))
on_graph("ref_max_hits", lambda g: verbs.refs(g, "plate", substr=True, max_hits=50), sites_sql(SUBSTR.format("plate", 64), 0, 255, hits=50))
on_graph("ref_def_in", lambda g: verbs.refs(g, NAME, max_hits=None, def_in="ASIA/"), sites_sql(EXACT.format(NAME), 0, 255, def_in="ASIA/"))
on_graph("callers", lambda g: verbs.callers(g, NAME, max_hits=None), sites_sql(EXACT.format(NAME), CALL, CALL))
on_graph("callers_in", lambda g: verbs.callers(g, "ring", substr=True, max_hits=100, in_="/NATION_1"), sites_sql(SUBSTR.format("ring", 64), CALL, CALL, hits=100, where="contains(f.path, '/NATION_1')"))
_register(
    "lookup_many",
    lambda spark, sf_dir: verbs.sites_many(g := graph(spark, sf_dir), g.names.select(F.col("name").alias("needle"))),
    f"select n.name as needle, n.sym, {ROLE.format('x.role')} as role, f.path, x.off from (select distinct name, sym from pg_names) n join pg_xrefs x on x.sym = n.sym join pg_files f on f.file = x.file",
)


def related_sql(syms: str, mine: str, other: str, where: str = "true") -> str:
    shown = f"case when not starts_with(name, 'kythe:') then name else coalesce(case when path is not null then concat('anon@', path, '@', cast(off as varchar)) end, nullif(split_part(name, '#', -1), ''), name) end"
    return f"""own as ({syms}), dp as ({FIRST_PATH}), pl as ({PLACE}),
found as (select i.{other} as sym, min(o.seq) as seq from pg_inh i join own o on o.sym = i.{mine} group by 1),
full_ as (select f.sym, f.seq, s.name, p.path, p.off, {KEY.format('s.name')} as key from found f join pg_syms s on s.sym = f.sym left join pl p on p.sym = f.sym left join dp on dp.sym = f.sym where {where}),
shown as (select key, min(seq * 100000000000 + sym) as place, arg_min({shown}, (case when starts_with(name, 'kythe:') then 1 else 0 end) * 10000000000000000 + seq * 100000000000 + sym) as name,
  arg_min(concat(path, '@', cast(off as varchar)), seq * 100000000000 + sym) filter (where path is not null) as "def" from full_ group by key)
select row_number() over (order by place) as seq, name, "def" from shown"""


on_graph("super_direct", lambda g: verbs.supers(g, "0000", substr=True, limit=200), related_sql(SUBSTR.format("0000", 200), "child", "parent"))
on_graph("sub_direct", lambda g: verbs.subs(g, "ASIA"), related_sql(EXACT.format("ASIA"), "parent", "child"))
on_graph("sub_in", lambda g: verbs.subs(g, "NATION_1", substr=True, limit=10, not_in="/x"), related_sql(SUBSTR.format("NATION_1", 10), "parent", "child", "not contains(coalesce(dp.def_path, ''), '/x')"))


def text_sql(syms: str, table: str, column: str, limit: int) -> str:
    return f"""own as ({syms}),
rows_ as (select o.seq, s.name, {KIND.format('s.kind')} as kind, {LANG.format('s.lang')} as lang, t.{column}, row_number() over (partition by {KEY.format('s.name')}, t.{column} order by o.seq) as nth from own o join {table} t on t.sym = o.sym join pg_syms s on s.sym = o.sym)
select row_number() over (order by seq) as seq, name, kind, lang, {column} from (select * from rows_ where nth = 1 order by seq limit {limit})"""


on_graph("type_of", lambda g: verbs.types(g, PART, substr=True, limit=30), text_sql(SUBSTR.format(PART, 64), "pg_typed", "typed", 30))
on_graph("sig_of", lambda g: verbs.signatures(g, "order.1", substr=True, limit=40), text_sql(SUBSTR.format("order.1", 64), "pg_sig", "sig", 40))
on_graph(
    "members",
    lambda g: verbs.members(g, CUSTOMER, substr=True, limit=50),
    f"""own as ({SUBSTR.format(CUSTOMER, 64)}), holders as (select o.* from own o join pg_syms s on s.sym = o.sym where s.kind in (2, 5)),
found as (select c.child as sym, min(h.seq) as holder from pg_childof c join holders h on h.sym = c.parent group by 1),
rows_ as (select f.sym, f.holder, s.name, {KIND.format('s.kind')} as kind, {LANG.format('s.lang')} as lang, g.sig from found f join pg_syms s on s.sym = f.sym left join pg_sig g on g.sym = f.sym),
one as (select *, row_number() over (partition by {KEY.format('name')}, kind, sig order by holder, sym) as nth from rows_)
select row_number() over (order by holder, sym) as seq, name, kind, lang, sig from (select * from one where nth = 1 order by holder, sym limit 50)""",
)
on_graph("names_prefix", lambda g: resolve.prefix(g.names, "Brand#1", 64), "select name, concat('0x', lpad(lower(hex(sym)), 16, '0')) as sym from (select distinct name, sym from pg_names where starts_with(name, 'Brand#1') order by name, sym limit 64)")


def walk_sql(roots: str, table: str, direction: str, depth: int, room: int | None = None) -> str:
    """The forest with one CTE a level."""
    frm, to = ("caller", "callee") if table == "pg_calls" else ("child", "parent")
    ends = {"up": (to, frm), "down": (frm, to)} if table == "pg_calls" else {"up": (frm, to), "down": (to, frm)}
    ways = [(d, r) for d, r in (("up", 0), ("down", 1)) if direction in (d, "both")]
    ctes = [
        f"own as ({roots})",
        f"l0 as (select row_number() over (order by seq) - 1 as id, cast(null as bigint) as parent, 0 as hop, 'root' as dir, sym, name, key from (select o.seq, o.sym, s.name, {KEY.format('s.name')} as key, row_number() over (partition by {KEY.format('s.name')} order by o.seq) as nth from own o join pg_syms s on s.sym = o.sym) where nth = 1)",
    ]
    for h in range(1, depth + 1):
        seen = " union all ".join(f"select id, key from l{i}" for i in range(h))
        ctes.append(f"c{h} as (select sym, id from l{h - 1} union select n.sym, l.id from l{h - 1} l join pg_names n on n.name = l.name join pg_syms s on s.sym = n.sym where {KEY.format('s.name')} = l.key)")
        near = " union all ".join(f"select e.{ends[d][1]} as sym, c.id as parent, {r} as rank, '{d}' as dir from pg_{table[3:]} e join c{h} c on c.sym = e.{ends[d][0]}" for d, r in ways)
        ctes.append(f"f{h} as (select n.*, s.name, {KEY.format('s.name')} as key from ({near}) n join pg_syms s on s.sym = n.sym)")
        ctes.append(f"b{h} as (select * from f{h} where key not in (select key from ({seen})) qualify row_number() over (partition by key order by parent, rank, sym) = 1)")
        count = f"(select count(*) from ({seen}))"
        limit = f"where {count} + nth <= greatest({room}, (select count(*) from l0) + 1)" if room else ""
        ctes.append(f"l{h} as (select {count} + nth - 1 as id, parent, {h} as hop, dir, sym, name, key from (select *, row_number() over (order by parent, rank, sym) as nth from b{h}) {limit})")
    every = " union all ".join(f"select * from l{i}" for i in range(depth + 1))
    anon = "coalesce(case when p.path is not null then concat('anon@', p.path, '@', cast(p.off as varchar)) end, nullif(split_part(a.name, '#', -1), ''), a.name)"
    shown = "a.name" if table == "pg_calls" else f"case when starts_with(a.name, 'kythe:') then {anon} else a.name end"
    return ",\n".join(ctes) + f""", pl as ({PLACE})
select cast(a.id as bigint) as id, cast(a.parent as bigint) as parent, cast(a.hop as bigint) as hop, a.dir, {KIND.format('s.kind')} as kind, {shown} as name, p.path || '@' || cast(p.off as varchar) as "def"
from ({every}) a join pg_syms s on s.sym = a.sym left join (select sym, path, off from pl) p on p.sym = a.sym"""


_ALL = 1_000_000
on_graph("inheritance_up", lambda g: walk.inheritance(g, CUSTOMER, substr=True, direction="up"), walk_sql(SUBSTR.format(CUSTOMER, 16), "pg_inh", "up", 3))
on_graph("inheritance_down", lambda g: walk.inheritance(g, "ASIA", direction="down", depth=2, max_syms=_ALL), walk_sql(EXACT.format("ASIA"), "pg_inh", "down", 2))
on_graph("inheritance_both", lambda g: walk.inheritance(g, "NATION_1", substr=True, direction="both", depth=2, max_syms=150, root_limit=3), walk_sql(SUBSTR.format("NATION_1", 3), "pg_inh", "both", 2, 150))
on_graph("callgraph_down", lambda g: walk.callgraph(g, CUSTOMER, substr=True, direction="down", depth=3, max_syms=_ALL), walk_sql(SUBSTR.format(CUSTOMER, 16), "pg_calls", "down", 3))
on_graph("callgraph_up", lambda g: walk.callgraph(g, SUPPLIER, substr=True, direction="up", depth=2, max_syms=300), walk_sql(SUBSTR.format(SUPPLIER, 16), "pg_calls", "up", 2, 300))
on_graph("callgraph_forest", lambda g: walk.callgraph(g, NAME, direction="both", depth=2, max_syms=200), walk_sql(EXACT.format(NAME), "pg_calls", "both", 2, 200))
_register(
    "reach_hops",
    lambda spark, sf_dir: walk.least_hops(
        (v := views(spark, sf_dir))["pg_calls"].select(F.col("caller").alias("src"), F.col("callee").alias("dst")), v["pg_syms"].filter("kind = 2 and lang = 2").select("sym"), 3
    ),
    "own as (select distinct sym from pg_syms where kind = 2 and lang = 2), h1 as (select distinct callee as sym from pg_calls join own on caller = own.sym), h2 as (select distinct callee as sym from pg_calls join h1 on caller = h1.sym), h3 as (select distinct callee as sym from pg_calls join h2 on caller = h2.sym)\n"
    "select sym, min(hop) as hop from (select sym, cast(0 as bigint) as hop from own union all select sym, 1 from h1 union all select sym, 2 from h2 union all select sym, 3 from h3) group by sym",
)

# build aggregates

on_views("alias_variable_suppressed", lambda v: build.name_rows(v["pg_syms"], v["pg_aliases"]), "select name, sym from pg_names")
on_views("alias_dedup", lambda v: v["pg_aliases"].distinct(), "select distinct sym, alias from pg_aliases")
_SEEN = "select sym, kind, lang, name from pg_syms union all select sym, 0, 0, alias from pg_aliases union all select o.sym, 4, 0, '' from pg_syms o where o.sym % 7 = 0 and o.kind = 3"


def _sightings(v: dict[str, DataFrame]) -> DataFrame:
    s = v["pg_syms"]
    again = v["pg_aliases"].select("sym", F.lit(0).alias("kind"), F.lit(0).alias("lang"), F.col("alias").alias("name"))
    fields = s.filter("sym % 7 = 0 and kind = 3").select("sym", F.lit(4).alias("kind"), F.lit(0).alias("lang"), F.lit("").alias("name"))
    return s.unionByName(again).unionByName(fields)


_RANK = "(case when name = '' then 1 else 0 end, case when regexp_matches(name, '[\\p{L}\\p{N}]') then 0 else 1 end, case when starts_with(name, 'kythe:') then 1 else 0 end, octet_length(encode(name)), name)"
on_views(
    "sym_refine",
    lambda v: build.refine(_sightings(v)),
    f"own as ({_SEEN}) select a.sym, cast(a.kind as bigint) as kind, cast(a.lang as bigint) as lang, b.name from (select sym, case when bool_or(kind = 4) then 4 when bool_or(kind = 2) then 2 when bool_or(kind = 1) then 1 when bool_or(kind = 5) then 5 when bool_or(kind = 3) then 3 else 0 end as kind, coalesce(min(case when lang <> 0 then lang end), 0) as lang from own group by sym) a join (select sym, name from own qualify row_number() over (partition by sym order by {_RANK.replace('(', '', 1)[:-1]}) = 1) b on a.sym = b.sym",
)
on_views(
    "prefers_name",
    lambda v: v["pg_syms"].select("lang", "name").union(v["pg_syms"].select("lang", F.lit("<>"))).groupBy("lang").agg(build.best_name().alias("name")),
    f"own as (select lang, name from pg_syms union all select lang, '<>' from pg_syms) select cast(lang as bigint) as lang, name from own qualify row_number() over (partition by lang order by {_RANK.replace('(', '', 1)[:-1]}) = 1",
)
on_views("typed_min", lambda v: build.least_text(v["pg_typed_raw"], "typed"), "select sym, typed from pg_typed")
on_graph("sig_render_ordered", lambda g: g.sig, "select sym, sig from pg_sig")
on_graph("logical_key_dedup", lambda g: g.syms.groupBy(S.logical_key(F.col("name")).alias("key")).agg(F.min("sym").alias("sym"), F.count(F.lit(1)).alias("copies")), f"select {KEY.format('name')} as key, min(sym) as sym, count(*) as copies from pg_syms group by 1")
on_graph(
    "display_name",
    lambda g: g.syms.join(verbs.places(g, g.syms), "sym", "left").select("sym", S.display_name(F.col("name"), F.col("path"), F.col("off")).alias("shown")),
    f"own as ({PLACE}) select s.sym, case when not starts_with(s.name, 'kythe:') then s.name else coalesce(case when p.path is not null then concat('anon@', p.path, '@', cast(p.off as varchar)) end, nullif(split_part(s.name, '#', -1), ''), s.name) end as shown from pg_syms s left join own p on p.sym = s.sym",
)
on_graph("def_loc", lambda g: verbs.places(g, g.syms), f"own as ({PLACE}) select sym, path, off from own")
on_graph("def_path", lambda g: verbs.first_paths(g, g.syms), f"own as ({FIRST_PATH}) select sym, def_path from own")


def _micros(v: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sites = v["pg_sites"].select("site", "file", at("off").alias("off"))
    return sites, v["pg_bodies"].select("body", "file", at("st").alias("st"), at("en").alias("en"))


_AROUND = "own as (select s.site, b.body, row_number() over (partition by s.site order by b.st desc, b.en, b.body) as nth from pg_sites s left join pg_bodies b on b.file = s.file and b.st <= s.off and s.off < b.en)"
on_views("innermost_body", lambda v: innermost(*_micros(v)).select("site", "body"), f"{_AROUND} select site, body from own where nth = 1 and body is not null")
on_views("unattributed_sites", lambda v: innermost(*_micros(v), outer=True).filter("body is null").select("site"), f"{_AROUND} select site from own where nth = 1 and body is null")
on_views(
    "completes_remap",
    lambda v: build.remapped(v["pg_calls"], v["pg_completes"], "caller", "callee").distinct().select("caller", "callee", "role"),
    "select distinct coalesce(a.decl_sym, c.caller) as caller, coalesce(b.decl_sym, c.callee) as callee, cast(c.role as bigint) as role from pg_calls c left join pg_completes a on a.def_sym = c.caller left join pg_completes b on b.def_sym = c.callee",
)
on_graph("calls_from", lambda g: verbs.neighbours(g, g.syms.filter("kind = 2"), "calls_from"), "select c.caller as sym, c.callee as other, cast(c.role as bigint) as role from pg_calls c where c.caller in (select sym from pg_syms where kind = 2)")
on_graph("called_by", lambda g: verbs.neighbours(g, g.syms.filter("kind = 4"), "called_by"), "select c.callee as sym, c.caller as other, cast(c.role as bigint) as role from pg_calls c where c.callee in (select sym from pg_syms where kind = 4)")
on_graph("inherits_of", lambda g: verbs.neighbours(g, g.syms, "inherits_of"), "select child as sym, parent as other, cast(null as bigint) as role from pg_inh where child in (select sym from pg_syms)")
on_graph("inherited_by", lambda g: verbs.neighbours(g, g.syms, "inherited_by"), "select parent as sym, child as other, cast(null as bigint) as role from pg_inh where parent in (select sym from pg_syms)")
on_graph("members_of", lambda g: verbs.neighbours(g, g.syms.filter("kind in (2, 5)"), "members"), "select distinct parent as sym, child as other, cast(null as bigint) as role from pg_childof where parent in (select sym from pg_syms where kind in (2, 5))")
on_graph("reverse_edges", lambda g: build.reverse(g.calls, "caller", "callee"), "select callee, caller, cast(role as bigint) as role from pg_calls")

# ranks and trigrams

on_graph("file_rank", lambda g: build.file_ids(g.files), "select path, dense_rank() over (order by path) - 1 as file from (select distinct path from pg_files)")
on_graph(
    "file_rank_local",
    lambda g: build.file_ids(g.xrefs.join(g.files, "file").select((F.col("sym") % 10).alias("cu"), "path"), "cu"),
    "select cu, path, dense_rank() over (partition by cu order by path) - 1 as file from (select distinct x.sym % 10 as cu, f.path from pg_xrefs x join pg_files f on x.file = f.file)",
)
on_graph(
    "file_ids_continued",
    lambda g: build.continued_ids(g.files.select("path"), g.files.filter("file % 3 = 0").select("path", "file")),
    "own as (select path, file from pg_files where file % 3 = 0) select path, file from own union all select path, (select max(file) + 1 from own) + row_number() over (order by path) - 1 from (select distinct path from pg_files where path not in (select path from own))",
)
on_graph("name_row_id", lambda g: resolve.numbered(g.names), "select name, sym, row_number() over (order by name, sym) - 1 as row_id from pg_names")
_TRI = "own as (select name, sym, row_number() over (order by name, sym) - 1 as row_id from pg_names), tris as (select distinct row_id, hex(substr(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), cast(i as int), 3)) as tri from own, unnest(range(1, length(name) - 1)) as r(i))"
on_graph("trigram_postings", lambda g: resolve.trigram_postings(resolve.numbered(g.names)), f"{_TRI} select tri, row_id from tris")
on_graph("trigram_dict", lambda g: resolve.trigram_dictionary(resolve.trigram_postings(resolve.numbered(g.names))), f"{_TRI} select tri, count(*) as cnt from tris group by tri")


def _trigram_search(g: Graph, needle: str) -> DataFrame:
    rows = resolve.numbered(g.names)
    return resolve.substring(g.names, needle, 1000, ignore_case=True, rows=resolve.candidates(rows, resolve.trigram_postings(rows), needle))


on_graph("trigram_intersect", lambda g: _trigram_search(g, "Blue Bo"), FOLDED.format("blue bo", 1000))


def _false_positives(g: Graph, needle: str) -> DataFrame:
    rows = resolve.numbered(g.names)
    found = resolve.candidates(rows, resolve.trigram_postings(rows), needle)
    return found.filter(~S.fold(F.col("name")).contains(needle)).select("name", "sym")


on_graph("trigram_false_positive", lambda g: _false_positives(g, "0000001"), f"{_TRI}, w as (select distinct hex(substr('0000001', cast(i as int), 3)) as tri from unnest(range(1, 6)) as r(i)), hit as (select row_id from tris join w using (tri) group by row_id having count(*) = (select count(*) from w)) select name, sym from own join hit using (row_id) where not contains(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '0000001')")
on_graph(
    "trigram_rarest",
    lambda g: resolve.rarest(resolve.trigram_dictionary(resolve.trigram_postings(resolve.numbered(g.names))), "red plate"),
    f"{_TRI} select tri, count(*) as cnt from tris where tri in (select hex(substr('red plate', cast(i as int), 3)) from unnest(range(1, 8)) as r(i)) group by tri order by cnt, tri limit 1",
)

# merging

def _shards(g: Graph) -> list[Graph]:
    from dataclasses import replace

    part = lambda df, key, k: df.filter(F.pmod(F.col(key), F.lit(3)).isin(k, (k + 1) % 3))  # noqa: E731  shards overlap
    keys = {"syms": "sym", "names": "sym", "xrefs": "sym", "inh": "child", "calls": "caller", "childof": "parent", "typed": "sym", "sig": "sym"}
    return [replace(g, **{t: part(g.tables()[t], key, k) for t, key in keys.items()}) for k in range(3)]


def _merged(g: Graph) -> DataFrame:
    m = build.merge(_shards(g))
    own = lambda df, table, *columns: df.select(F.lit(table).alias("table"), *[c.cast("long").alias(n) for c, n in zip(columns, "abc", strict=True)], *(["name"] if "name" in df.columns else [F.lit(None).cast("string").alias("name")]))
    return own(m.syms, "syms", F.col("sym"), F.col("kind"), F.col("lang")).union(own(m.calls, "calls", F.col("caller"), F.col("callee"), F.col("role"))).union(own(m.childof, "childof", F.col("parent"), F.col("child"), F.lit(None)))


on_graph(
    "merge_union",
    _merged,
    "select 'syms' as \"table\", sym as a, cast(kind as bigint) as b, cast(lang as bigint) as c, name from pg_syms union all select 'calls', caller, callee, cast(role as bigint), null from pg_calls union all select distinct 'childof', parent, child, cast(null as bigint), null from pg_childof",
)


def _local(g: Graph) -> list[Graph]:
    """Shards whose files have numbers of their own."""
    from dataclasses import replace

    out = []
    for k in range(2):
        x = g.xrefs.filter(F.col("file") % 2 == k).withColumn("file", F.floor(F.col("file") / 2).cast("long"))
        out.append(replace(g, xrefs=x, files=g.files.filter(F.col("file") % 2 == k).withColumn("file", F.floor(F.col("file") / 2).cast("long"))))
    return out


on_graph("merge_remap", lambda g: build.merge(_local(g), local_files=True).xrefs, "own as (select file, dense_rank() over (order by path) - 1 as new from pg_files) select x.sym, cast(x.role as bigint) as role, o.new as file, x.off from pg_xrefs x join own o on o.file = x.file")
on_graph("merge_names", lambda g: build.merge(_shards(g)).names, "select name, sym from pg_names")
on_graph("resume_anti", lambda g: missing_from(g.syms.select(F.col("sym").alias("sha"), "name"), g.typed.select(F.col("sym").alias("sha"))), "select sym as sha, name from pg_syms where sym not in (select sym from pg_typed)")
on_graph(
    "edge_union_dups",
    lambda g: g.calls.join(g.syms.withColumnRenamed("sym", "caller"), "caller").select(S.logical_key(F.col("name")).alias("key"), "callee").distinct(),
    f"select distinct {KEY.format('s.name')} as key, c.callee from pg_calls c join pg_syms s on s.sym = c.caller",
)

# scalar functions, on tables of their inputs

def _rows(values: list[str]) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


EDGES = ["/kythe/edge/defines/binding", "/kythe/edge/defines", "/kythe/edge/ref", "/kythe/edge/ref.3", "/kythe/edge/ref/call", "/kythe/edge/ref/writes", "/kythe/edge/ref/imports", "/kythe/edge/typed", "/kythe/edge/param.12", "/kythe/edge/param", "/kythe/edge/extends/public"]
METHODS = ["a.b.C.m()V", "a.b.C.m(ILjava/lang/String;)J", "f(x)", "plain", "a(b)c(d)V", "()V", "ns::C::op", "x.y::z.w"]


def _literal(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")


_register("edge_role_map", lambda spark, _: _literal(spark, EDGES).select("value", S.edge_role(F.col("value")).alias("role"), S.param_ordinal(F.col("value")).alias("ordinal"), F.substring_index("value", ".", 1).isin(*S.INHERITS).alias("inherits")),
          f"select value, cast(case split_part(value, '.', 1) when '/kythe/edge/defines/binding' then 0 when '/kythe/edge/defines' then 1 when '/kythe/edge/ref' then 2 when '/kythe/edge/ref/writes' then 2 when '/kythe/edge/ref/imports' then 2 when '/kythe/edge/ref/call' then 3 end as bigint) as role, cast(nullif(regexp_extract(value, '^/kythe/edge/param[.]([0-9]+)$', 1), '') as bigint) as ordinal, split_part(value, '.', 1) in ('/kythe/edge/extends', '/kythe/edge/extends/private', '/kythe/edge/extends/protected', '/kythe/edge/extends/public', '/kythe/edge/overrides', '/kythe/edge/satisfies') as inherits from (values {_rows(EDGES)}) t(value)")
_register("node_kind_map", lambda spark, _: _literal(spark, [*S.NODE_KINDS, "file", ""]).select("value", S.node_kind(F.col("value")).alias("kind")),
          f"select value, cast(case value when 'function' then 1 when 'record' then 2 when 'interface' then 2 when 'variable' then 3 when 'constant' then 4 when 'field' then 4 when 'package' then 5 else 0 end as bigint) as kind from (values {_rows([*S.NODE_KINDS, 'file', ''])}) t(value)")
_register("lang_map", lambda spark, _: _literal(spark, [*S.LANGUAGE, "protobuf", ""]).select("value", S.language(F.col("value")).alias("lang"), S.lang_label(S.language(F.col("value"))).alias("label")),
          f"select value, cast(n as bigint) as lang, {LANG.format('n')} as label from (select value, case value when 'c++' then 1 when 'java' then 2 when 'jvm' then 3 when 'go' then 4 when 'proto' then 5 when 'rust' then 6 when 'kotlin' then 7 else 0 end as n from (values {_rows([*S.LANGUAGE, 'protobuf', ''])}) t(value))")
_register("strip_descriptor", lambda spark, _: _literal(spark, METHODS).select("value", S.strip_descriptor(F.col("value")).alias("name")),
          f"select value, nullif(regexp_extract(value, '^(.*)\\([A-Za-z0-9;\\[/$_]*\\)[A-Za-z0-9;\\[/$_]+$', 1), '') as name from (values {_rows(METHODS)}) t(value)")
_register("short_name", lambda spark, _: _literal(spark, METHODS).select("value", S.short_name(F.col("value")).alias("name")), f"select value, split_part(split_part(value, '::', -1), '.', -1) as name from (values {_rows(METHODS)}) t(value)")
on_graph("labels", lambda g: g.syms.groupBy(S.kind_label(F.col("kind")).alias("kind"), S.lang_label(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n")), f"select {KIND.format('kind')} as kind, {LANG.format('lang')} as lang, count(*) as n from pg_syms group by 1, 2")
on_graph("ascii_fold", lambda g: g.names.select("name", S.fold(F.col("name")).alias("folded")).distinct(), "select distinct name, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as folded from pg_names")

# run statistics

def _run_stats(v: dict[str, DataFrame]) -> DataFrame:
    from ..operators.ingest import run_stats

    units = v["pg_syms"].select(S.lang_label(F.col("lang")).alias("lang"), (F.col("sym") % 3 == 0).alias("ok"), (F.col("sym") % 3 == 1).alias("empty"), (F.col("sym") % 3 == 2).alias("failed"), F.length("name").alias("entries"), F.substring("name", 1, 12).alias("tail"))
    return run_stats(units).withColumn("tails", F.array_join("tails", "|"))


on_views("run_stats_by_lang", _run_stats, f"own as (select {LANG.format('lang')} as lang, sym % 3 as r, length(name) as n, substr(name, 1, 12) as tail from pg_syms) select lang, count(*) as units, cast(sum(case when r = 0 then 1 else 0 end) as bigint) as ok, cast(sum(case when r = 1 then 1 else 0 end) as bigint) as empty, cast(sum(case when r = 2 then 1 else 0 end) as bigint) as failed, cast(sum(n) as bigint) as entries, coalesce(array_to_string(list_slice(list_sort(list(distinct tail) filter (where r = 2)), 1, 8), '|'), '') as tails from own group by lang")
PERCENTILES = (50.0, 90.0, 99.0, 99.9)


def _percentiles(v: dict[str, DataFrame]) -> DataFrame:
    """Nearest rank, round((n - 1) p / 100), of offsets by role."""
    x = build.ranked(v["pg_xrefs"].select("role", "off", "sym", "file"), ["role", "off", "sym", "file"])
    base = x.groupBy("role").agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("n"), F.max("off").alias("most"))
    x = x.join(F.broadcast(base), "role")  # a row a role
    at = lambda p: F.max(F.when(F.col("rank") - F.col("low") == F.floor((F.col("n") - 1) * (p / 100) + 0.5), F.col("off"))).alias("p" + str(p).replace(".0", "").replace(".", "_"))
    return x.groupBy("role").agg(*[at(p) for p in PERCENTILES], F.max("most").alias("most"))


on_views("latency_percentiles", _percentiles, "own as (select role, off, row_number() over (partition by role order by off, sym, file) - 1 as nth, count(*) over (partition by role) as n from pg_xrefs) select cast(role as bigint) as role, " + ", ".join(f"max(case when nth = floor((n - 1) * ({p} / 100) + 0.5) then off end) as p{str(p).replace('.0', '').replace('.', '_')}" for p in PERCENTILES) + ", max(off) as most from own group by role")


# ingestion of a built-in entry stream, held against its known result by tests

def _ingested(table: str) -> Query:
    def query(spark: SparkSession, _: str) -> DataFrame:
        from .sample import entries

        from ..operators.ingest import raw_tables

        return raw_tables(entries(spark))[table].distinct()

    return query


def _literal_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL of literal rows."""
    shown = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    return f"select {', '.join(f'cast({c} as {k}) as {c}' for c, k in columns.items())} from (values {values}) t({', '.join(columns)})"


#: Symbols of the built-in stream, by the hash of their identity.
_BAR, _HELPER, _W, _BASE, _BOX = -44136972196806020, -7444416847966249867, -8062535717394313524, 2719579818734437276, 6114211611803695586
_LONG = {c: "bigint" for c in ("sym", "role", "file", "off", "caller", "callee", "child", "parent")}
_KNOWN = {
    "xrefs": [(_BAR, DECL, 1, 100), (_BAR, DECL, 0, 200), (_BAR, DEF, 0, 190), (_W, REF, 0, 320), (_HELPER, CALL, 0, 300), (_HELPER, CALL, 0, 500)],
    "calls": [(_BAR, _HELPER, CALL), (_BAR, _W, REF)],
    "typed": [(_BAR, "int(Box *)"), (_W, "Box *")],
    "sig": [(_BAR, "int bar(Box * w)")],
    "aliases": [(_BAR, "Foo::bar"), (_HELPER, "Foo::helper"), (_W, "Foo::bar::w"), (_BASE, "Base"), (_BOX, "Box")],
    "inh": [(_BOX, _BASE)],
}
_NAMES = {"xrefs": ("sym", "role", "file", "off"), "calls": ("caller", "callee", "role"), "typed": ("sym", "typed"), "sig": ("sym", "sig"), "aliases": ("sym", "alias"), "inh": ("child", "parent")}
for _name, _table in (("ingest_xrefs", "xrefs"), ("ingest_calls", "calls"), ("ingest_types", "typed"), ("ingest_sigs", "sig"), ("ingest_names", "aliases"), ("ingest_inherits", "inh")):
    _register(_name, (lambda query: lambda spark, sf_dir: query(spark, sf_dir))(_ingested(_table)), _literal_sql({c: _LONG.get(c, "varchar") for c in _NAMES[_table]}, _KNOWN[_table]))


def _marked(spark: SparkSession, _: str) -> DataFrame:
    from .sample import entries

    from ..operators.ingest import marked_name

    code = entries(spark).filter("fact_name = '/kythe/code'").select("fact_value").distinct()
    return code.select(F.hex("fact_value").alias("code"), marked_name("fact_value").alias("name"))


#: Bytes of the stream's marked sources, and the names in them.
_CODES = [
    ("1A08080422023A3A50011A0708031203426F78", "Box"),
    ("1A08080422023A3A50011A080803120442617365", "Base"),
    ("1A1108041A0708031203466F6F22023A3A50011A0708031203626172", "Foo::bar"),
    ("1A1108041A0708031203466F6F22023A3A50011A0A0803120668656C706572", "Foo::helper"),
    ("1A1A08041A0708031203466F6F1A070803120362617222023A3A50011A050803120177", "Foo::bar::w"),
]
_register("marked_source_fqn", _marked, _literal_sql({"code": "varchar", "name": "varchar"}, _CODES))
QUERIES["sym_hash"] = lambda spark, sf_dir: graph(spark, sf_dir).syms.select("name", S.sym_of(F.col("name")).alias("hash"))
#: Values of the 64-bit hash with seed 0 by its own library, as signed numbers.
_HASHES = [("", -1205034819632174695), ("a", -3292477735350538661), ("abc", 4952883123889572249), ("message digest", 463544382707905470), ("abcdefghijklmnopqrstuvwxyz", -3467223636685257892)]
_register("sym_hash_known", lambda spark, _: _literal(spark, [v for v, _ in _HASHES]).select("value", S.sym_of(F.col("value")).alias("hash")), _literal_sql({"value": "varchar", "hash": "bigint"}, _HASHES))


def _digests(spark: SparkSession, _: str) -> DataFrame:
    """sha and the units that have the same digest: two are equal, the others differ in one thing each."""
    from .sample import units

    from ..sources.kzip import digest

    rows = units(spark).select("sha", digest(F.lit("cxx-1"), F.col("unit")).alias("digest"))
    same = rows.groupBy("digest").agg(F.array_join(F.sort_array(F.collect_list("sha")), ",").alias("same"))
    return rows.join(same, "digest").select("sha", "same", F.length("digest").alias("n"))


_register("cu_digest_changes", _digests, _literal_sql({"sha": "varchar", "same": "varchar", "n": "bigint"}, [("same1", "same1,same2", 64), ("same2", "same1,same2", 64), ("argv", "argv", 64), ("input", "input", 64)]))
