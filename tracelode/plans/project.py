"""A code graph projected from the star schema, so that the verbs can be held against SQL on the same tables.

Each view is one statement that Spark and DuckDB both take; ids are surrogates, so nothing is hashed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import least_text, name_rows
from ..schema import Graph

#: The base tables. With schemas given, reading one takes no job.
BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}
_OF_REGION = "join nation on {0}_nationkey = n_nationkey join region on n_regionkey = r_regionkey"

VIEWS = {
    "pg_syms": f"""
select cast(1000000000 as bigint) + r_regionkey as sym, 5 as kind, 1 as lang, r_name as name from region
union all select cast(2000000000 as bigint) + n_nationkey, 2, 2, concat(r_name, '.', n_name) from nation join region on n_regionkey = r_regionkey
union all select cast(3000000000 as bigint) + c_custkey, 2, 2, concat(r_name, '.', n_name, '.', c_name) from customer {_OF_REGION.format('c')}
union all select cast(4000000000 as bigint) + s_suppkey, 2, 1, concat(r_name, '.', n_name, '.', s_name) from supplier {_OF_REGION.format('s')}
union all select cast(5000000000 as bigint) + p_partkey, case when p_size % 10 = 0 then 3 else 4 end, cast(p_size % 8 as int), p_name from part
union all select cast(6000000000 as bigint) + o_orderkey, 1, 4, case when o_orderkey % 5 = 0 then concat('kythe:java:c#r#', cast(o_custkey as varchar(20)), '/O.java#SIG', cast(o_orderkey % 50 as varchar(20))) else concat('order.', cast(o_orderkey as varchar(20))) end from orders""",
    "pg_files": f"select s_suppkey as file, concat(r_name, '/', n_name, '/', s_name, '.cc') as path from supplier {_OF_REGION.format('s')}",
    "pg_xrefs": "select distinct cast(5000000000 as bigint) + l_partkey as sym, case when l_returnflag = 'R' then 3 when l_returnflag = 'N' then 2 when l_linestatus = 'O' then 1 else 0 end as role, l_suppkey as file, l_orderkey * 8 + l_linenumber as off from lineitem",
    "pg_inh": """
select cast(3000000000 as bigint) + c_custkey as child, cast(2000000000 as bigint) + c_nationkey as parent from customer
union all select cast(4000000000 as bigint) + s_suppkey, cast(2000000000 as bigint) + s_nationkey from supplier
union all select cast(2000000000 as bigint) + n_nationkey, cast(1000000000 as bigint) + n_regionkey from nation""",
    "pg_childof": """
select cast(3000000000 as bigint) + o_custkey as parent, cast(6000000000 as bigint) + o_orderkey as child from orders
union all select cast(1000000000 as bigint) + n_regionkey, cast(2000000000 as bigint) + n_nationkey from nation
union all select distinct cast(6000000000 as bigint) + l_orderkey, cast(5000000000 as bigint) + l_partkey from lineitem""",
    "pg_calls": """
select cast(3000000000 as bigint) + o_custkey as caller, cast(6000000000 as bigint) + o_orderkey as callee, 3 as role from orders
union select cast(6000000000 as bigint) + l_orderkey, cast(5000000000 as bigint) + l_partkey, case when l_returnflag = 'R' then 3 else 2 end from lineitem
union select cast(5000000000 as bigint) + l_partkey, cast(4000000000 as bigint) + l_suppkey, 3 from lineitem""",
    "pg_typed_raw": """
select cast(5000000000 as bigint) + p_partkey as sym, p_type as typed from part
union all select cast(6000000000 as bigint) + l_orderkey, concat(l_returnflag, l_linestatus) from lineitem""",
    "pg_aliases": """
select cast(5000000000 as bigint) + p_partkey as sym, concat(p_brand, '::', p_name) as alias from part
union all select cast(5000000000 as bigint) + l_partkey, concat(p_brand, '::', p_name) from lineitem join part on l_partkey = p_partkey""",
    "pg_sig_params": "select distinct cast(6000000000 as bigint) + l_orderkey as fn, l_linenumber as ord, l_partkey as pkey, p_type as ptype, p_name as pname from lineitem join part on l_partkey = p_partkey",
    "pg_completes": "select cast(5000000000 as bigint) + p_partkey as def_sym, cast(5000000000 as bigint) + p_partkey - 1 as decl_sym from part where p_partkey % 10 = 9",
    "pg_bodies": "select event_id as body, user_id as file, ts as st, ts + interval 6 hours as en from events where event_type in ('signup', 'purchase')",
    "pg_sites": "select event_id as site, user_id as file, ts as off from events",
}
#: What the aggregates make of the raw views, in SQL for the other engine.
DERIVED = {
    "pg_typed": "select sym, min(typed) as typed from pg_typed_raw where typed <> '' group by sym",
    "pg_sig": "select fn as sym, concat('o(', string_agg(concat(ptype, ' ', pname), ', ' order by ord, pkey, ptype, pname), ')') as sig from pg_sig_params group by fn",
    "pg_names": "select name, sym from pg_syms union select alias, a.sym from pg_aliases a where not exists (select 1 from pg_syms s where s.sym = a.sym and s.kind = 3)",
}


def prelude() -> str:
    """The WITH clause of all views."""
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in (VIEWS | DERIVED).items())


class Views(Mapping):
    """The raw views as DataFrames, each made when it is asked for. The statement names its tables as arguments, so
    nothing stays registered in the session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            sql = VIEWS[name]
            used = [t for t in BASE if re.search(rf"\b{t}\b", sql)]
            named = re.sub(rf"\b(from|join) ({'|'.join(used)})\b", r"\1 {\2}", sql)
            self.made[name] = self.spark.sql(named, **{t: self.table(t) for t in used})
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)


def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)


def signatures(params: DataFrame) -> DataFrame:
    """sym, sig: parameters in order of their ordinal."""
    one = F.struct("ord", "pkey", "ptype", "pname")
    shown = F.transform(F.array_sort(F.collect_list(one)), lambda p: F.concat_ws(" ", p["ptype"], p["pname"]))
    return params.groupBy(F.col("fn").alias("sym")).agg(F.concat(F.lit("o("), F.array_join(shown, ", "), F.lit(")")).alias("sig"))


class Projected(Graph):
    """A graph whose tables are made when they are asked for."""

    def __init__(self, make: dict[str, Callable[[], DataFrame]] | None = None, **tables: DataFrame) -> None:
        object.__setattr__(self, "make", make or {})
        for name, df in tables.items():
            object.__setattr__(self, name, df)

    def __getattr__(self, name: str) -> DataFrame:
        make = object.__getattribute__(self, "make")
        if name not in make:
            raise AttributeError(name)
        object.__setattr__(self, name, make[name]())
        return object.__getattribute__(self, name)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    v = views(spark, sf_dir)
    make = {t: (lambda t=t: v[f"pg_{t}"]) for t in ("syms", "files", "xrefs", "inh", "calls", "childof")}
    make["names"] = lambda: name_rows(v["pg_syms"], v["pg_aliases"])
    make["typed"] = lambda: least_text(v["pg_typed_raw"], "typed")
    make["sig"] = lambda: signatures(v["pg_sig_params"])
    return Projected(make)
