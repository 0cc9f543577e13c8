"""The tables of a code graph, their columns and enumerations.

Symbol ids are unsigned 64-bit hashes kept as the signed BIGINT of the same bits; wherever their order
shows, ``functions.scalar.sym_order`` gives the unsigned one.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

VERSION = 2

#: Roles, kinds and languages by number, with the labels that replies show.
DECL, DEF, REF, CALL = 0, 1, 2, 3
ROLES = {DECL: "decl", DEF: "def", REF: "ref", CALL: "call"}
UNKNOWN, FUNCTION, TYPE, VARIABLE, FIELD, PACKAGE = 0, 1, 2, 3, 4, 5
KINDS = {FUNCTION: "fn", TYPE: "type", VARIABLE: "var", FIELD: "field", PACKAGE: "pkg"}
LANGS = {1: "cxx", 2: "java", 3: "jvm", 4: "go", 5: "proto", 6: "rust", 7: "kt"}
CONTAINERS = (TYPE, PACKAGE)

COLUMNS = {
    "syms": "sym long, kind int, lang int, name string",
    "names": "name string, sym long",
    "files": "file long, path string",
    "xrefs": "sym long, role int, file long, off long",
    "inh": "child long, parent long",
    "calls": "caller long, callee long, role int",
    "childof": "parent long, child long",
    "typed": "sym long, typed string",
    "sig": "sym long, sig string",
}
#: Columns that the files of a stored table are ordered by, and in which look-ups prune row groups.
SORTED = {
    "syms": ["sym"],
    "names": ["name", "sym"],
    "files": ["file"],
    "xrefs": ["sym", "role", "file", "off"],
    "inh": ["child", "parent"],
    "calls": ["caller", "callee", "role"],
    "childof": ["parent", "child"],
    "typed": ["sym"],
    "sig": ["sym"],
}
VNAME = "struct<signature:string,corpus:string,root:string,path:string,language:string>"
ENTRY = f"cu_id string, source {VNAME}, edge_kind string, target {VNAME}, fact_name string, fact_value binary"


@dataclass(frozen=True)
class Graph:
    """The tables of one code graph."""

    syms: DataFrame
    names: DataFrame
    files: DataFrame
    xrefs: DataFrame
    inh: DataFrame
    calls: DataFrame
    childof: DataFrame
    typed: DataFrame
    sig: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def by(self, table: str, column: str) -> DataFrame:
        """The table, in the form that is best looked up by a column."""
        return getattr(self, table)

    def likely(self, needle: str) -> DataFrame | None:
        """Name rows among which are all that hold the needle in any case; None: all name rows."""
        return None

    @property
    def spark(self) -> SparkSession:
        return self.syms.sparkSession

    @classmethod
    def of_rows(cls, spark: SparkSession, **rows: list[tuple]) -> Graph:
        """A graph of literal rows; tables that aren't given are empty."""
        return cls(**{t: spark.createDataFrame(rows.get(t, []), kinds) for t, kinds in COLUMNS.items()})
