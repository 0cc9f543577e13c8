"""Archives of compilation units: zip files with ``ROOT/pbunits/SHA`` (protocol buffers), ``ROOT/units/SHA`` (JSON)
and ``ROOT/files/DIGEST`` members.

One archive is one file, so its members are listed once and read by range in parallel: the member table
is a DataFrame, and units are decoded where its rows are. A filter on the primary path first looks at the fields that
tell it, without building the unit; units that it rejects are not decoded further.

Units run through external indexers once: what the programs say and how they ended is written before anything reads it.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wire import field, fields, text
from .entries import vname

VNAME = "struct<signature:string,corpus:string,root:string,path:string,language:string>"
UNIT = f"v_name {VNAME}, required_input array<struct<v_name:{VNAME},info:struct<path:string,digest:string>>>, argument array<string>, source_file array<string>, output_key string, working_directory string, entry_context string"
SCHEMA = f"archive string, sha string, is_proto boolean, unit struct<{UNIT.replace(' array', ':array').replace(' string', ':string').replace(' struct', ':struct')}>"
#: Which languages go to which kind of indexer.
INDEXERS = {"c++": "cxx", "java": "java", "jvm": "jvm", "go": "go", "protobuf": "proto", "proto": "proto", "textproto": "textproto"}
#: Compiler flags that name profile, coverage and sanitizer files which archives don't hold.
DROPPED = (
    "-fprofile-sample-use",
    "-fprofile-use",
    "-fprofile-instr-use",
    "-fprofile-list",
    "-fprofile-remapping-file",
    "-fsanitize-coverage-allowlist",
    "-fsanitize-coverage-ignorelist",
    "-fsanitize-ignorelist",
    "-fsanitize-blacklist",
    "-fxray-attr-list",
    "-fxray-always-instrument",
    "-fxray-never-instrument",
)
_FIELDS = {7: "output_key", 8: "working_directory", 9: "entry_context"}


def _info(data: bytes) -> dict:
    out = {"path": "", "digest": ""}
    for n, _, own in fields(data, only_bytes=True):
        if n in (1, 2):
            out[("path", "digest")[n - 1]] = text(own)
    return out


def _blank() -> dict:
    empty = {"signature": "", "corpus": "", "root": "", "path": "", "language": ""}
    return {"v_name": empty, "required_input": [], "argument": [], "source_file": [], "output_key": "", "working_directory": "", "entry_context": ""}


def decode_unit(data: bytes) -> dict:
    """A unit from an indexed compilation's bytes."""
    out = _blank()
    for n, _, body in fields(data, only_bytes=True):
        if n != 1:
            continue
        for k, wire, own in fields(body):
            if wire != 2:
                continue
            if k == 1:
                out["v_name"] = vname(own)
            elif k == 3:
                one = {"v_name": _blank()["v_name"], "info": {"path": "", "digest": ""}}
                for m, _, part in fields(own, only_bytes=True):
                    if m == 1:
                        one["v_name"] = vname(part)
                    elif m == 2:
                        one["info"] = _info(part)
                out["required_input"].append(one)
            elif k == 5:
                out["argument"].append(text(own))
            elif k == 6:
                out["source_file"].append(text(own))
            elif k in _FIELDS:
                out[_FIELDS[k]] = text(own)
    return out


def encode_unit(unit: dict) -> bytes:
    """An indexed compilation's bytes; what is empty isn't written."""
    names = lambda v: b"".join(field(i, v[k]) for i, k in enumerate(("signature", "corpus", "root", "path", "language"), 1) if v.get(k))
    own = names(unit["v_name"])
    out = field(1, own) if own else b""
    for one in unit["required_input"]:
        v, i = names(one["v_name"]), b"".join(field(n, one["info"][k]) for n, k in ((1, "path"), (2, "digest")) if one["info"].get(k))
        out += field(3, (field(1, v) if v else b"") + (field(2, i) if i else b""))
    out += b"".join(field(5, a) for a in unit["argument"]) + b"".join(field(6, s) for s in unit["source_file"])
    out += b"".join(field(n, unit[k]) for n, k in _FIELDS.items() if unit[k])
    return field(1, out)


def decode_json(data: bytes) -> dict:
    """A unit from JSON with names of either style."""
    whole = json.loads(data)
    own = whole.get("unit", whole)
    get = lambda d, snake: d.get(snake, d.get("".join(p.title() if i else p for i, p in enumerate(snake.split("_")))))
    out = _blank()
    blank = out["v_name"]
    out["v_name"] = blank | (get(own, "v_name") or {})
    for one in get(own, "required_input") or []:
        info = one.get("info") or {}
        out["required_input"].append({"v_name": blank | (get(one, "v_name") or {}), "info": {"path": info.get("path", ""), "digest": info.get("digest", "")}})
    for k in ("argument", "source_file", "output_key", "working_directory", "entry_context"):
        out[k] = get(own, k) or out[k]
    out["v_name"] = {k: out["v_name"].get(k, "") for k in blank}
    for one in out["required_input"]:
        one["v_name"] = {k: one["v_name"].get(k, "") for k in blank}
    return out


def peek(data: bytes, is_proto: bool) -> str | None:
    """The primary path by a look at the few fields that tell it; "" for a unit without one, None where it takes a whole
    decoding to tell."""
    if not is_proto:
        return None
    unit = next((own for n, _, own in fields(data, only_bytes=True) if n == 1), None)
    if unit is None:
        return None
    first, name = None, ""
    for n, wire, own in fields(unit):
        if wire != 2:
            continue
        if n == 6:
            return text(own)
        if n == 3 and first is None:
            first = own
        elif n == 1:
            name = vname(own)["path"]
    parts = {n: own for n, _, own in fields(first, only_bytes=True)} if first is not None else {}
    return parts.get(1) and vname(parts[1])["path"] or parts.get(2) and _info(parts[2])["path"] or name


@contextmanager
def _zip(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive by a local path or by the address of a file system."""
    if "://" not in path:
        with zipfile.ZipFile(path) as z:
            yield z
        return
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(root) as f, zipfile.ZipFile(f) as z:
        yield z


def primary_path(unit: dict) -> str | None:
    first = unit["required_input"][0] if unit["required_input"] else None
    if unit["source_file"]:
        return unit["source_file"][0]
    return (first and (first["v_name"]["path"] or first["info"]["path"])) or unit["v_name"]["path"] or None


def members(archive: str) -> list[tuple[str, bool, str]]:
    """(sha, is_proto, member) of the units; a protocol buffer hides JSON of the same sha."""
    found: dict[tuple[str, bool], str] = {}
    with _zip(archive) as z:
        for name in z.namelist():
            parts = name.split("/")
            if len(parts) == 3 and parts[2] and parts[1] in ("pbunits", "units"):
                found[parts[2], parts[1] == "pbunits"] = name
    return sorted((sha, proto, name) for (sha, proto), name in found.items() if proto or (sha, True) not in found)


def read_units(spark: SparkSession, archive: str, accept: Callable[[str | None], bool] | None = None, parts: int = 0) -> DataFrame:
    """archive, sha, is_proto, unit of the units of an archive that every executor can open. ``accept``: of the primary
    path; units that it rejects are not built."""
    listed = spark.createDataFrame(members(archive), "sha string, is_proto boolean, member string")
    listed = listed.repartition(parts or max(1, spark.sparkContext.defaultParallelism), "sha")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _zip(archive) as z:
            for batch in batches:
                out = []
                for sha, proto, name in zip(batch["sha"], batch["is_proto"], batch["member"], strict=True):
                    data = z.read(name)
                    if accept is not None and (path := peek(data, proto)) is not None and not accept(path or None):
                        continue
                    unit = decode_unit(data) if proto else decode_json(data)
                    if accept is None or accept(primary_path(unit)):
                        out.append((archive, sha, proto, unit))
                if out:
                    yield pd.DataFrame(out, columns=["archive", "sha", "is_proto", "unit"])

    return listed.mapInPandas(run, SCHEMA)


def plan(units: DataFrame, langs: list[str] | None = None, in_: list[str] | None = None, not_in: list[str] | None = None) -> DataFrame:
    """Units with ``indexer`` and ``path``, that an indexer is known for and that the filters let pass."""
    from ..functions.scalar import primary_path as path_of

    out = units.withColumn("path", path_of(F.col("unit"))).withColumn("lang", F.lower("unit.v_name.language"))
    table = F.create_map(*[F.lit(x) for pair in INDEXERS.items() for x in pair])
    out = out.withColumn("indexer", F.element_at(table, F.col("lang"))).filter("indexer is not null")
    path = F.coalesce("path", F.lit(""))
    some = lambda needles: F.exists(F.array([F.lit(n) for n in needles]), lambda n: path.contains(n))
    if langs:
        out = out.filter(F.col("indexer").isin(*langs))
    if in_:
        out = out.filter(some(in_))
    if not_in:
        out = out.filter(~some(not_in))
    return out


def rewritten(argument: Column, path: Column, drop: tuple[str, ...] = DROPPED, inject: list[tuple[str, str]] = ()) -> Column:
    """Arguments without those that begin with a dropped prefix, and with the injected ones of the path's prefixes in
    front, in order of the rules, unless they are there."""
    kept = F.filter(argument, lambda a: ~F.exists(F.array([F.lit(d) for d in drop]), lambda d: a.startswith(d))) if drop else argument
    for prefix, arg in reversed(inject):
        kept = F.when(path.startswith(prefix) & ~F.array_contains(kept, arg), F.concat(F.array(F.lit(arg)), kept)).otherwise(kept)
    return kept


def digest(tag: Column, unit: Column, version: int = 1) -> Column:
    """What a unit's result depends on: version, indexer, language, arguments in order, distinct inputs."""
    inputs = F.array_sort(F.array_distinct(F.transform(unit["required_input"], lambda i: F.struct(i["v_name"], i["info"]))))
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), tag.alias("tag"), unit["v_name"]["language"].alias("lang"), unit["argument"].alias("argv"), inputs.alias("inputs"))), 256)


def write_normalized(archive: str, out: str, keep: Callable[[dict], dict | None] = lambda u: u) -> int:
    """Writes an archive of protocol-buffer units and the files that they name. ``keep`` may change a unit or leave it
    out (None). Files that are missing are left out. Gives the number of units."""
    n, wanted = 0, set()
    with _zip(archive) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        names = set(z.namelist())
        root = next(iter(sorted(names)), "root/").split("/")[0]
        to.writestr(f"{root}/", b"")
        for sha, proto, member in members(archive):
            data = z.read(member)
            unit = decode_unit(data) if proto else decode_json(data)
            new = keep(unit)
            if new is None:
                continue
            to.writestr(f"{root}/pbunits/{sha}", data if proto and new == unit else encode_unit(new))
            wanted |= {i["info"]["digest"] for i in new["required_input"] if i["info"]["digest"]}
            n += 1
        for d in sorted(wanted):
            if f"{root}/files/{d}" in names:
                to.writestr(f"{root}/files/{d}", z.read(f"{root}/files/{d}"))
    return n


def sub_archive(archive: str, sha: str, unit: dict, out: str) -> int:
    """Writes an archive of one unit, as it is given, and the files that it names; files that are missing are left out.
    Gives the number of files."""
    n = 0
    with _zip(archive) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as to:
        names = set(z.namelist())
        root = next(iter(sorted(names)), "root/").split("/")[0]
        for folder in ("", "pbunits/", "files/"):
            to.writestr(f"{root}/{folder}", b"")
        to.writestr(f"{root}/pbunits/{sha}", encode_unit(unit))
        for d in sorted({i["info"]["digest"] for i in unit["required_input"] if i["info"]["digest"]}):
            if f"{root}/files/{d}" in names:
                to.writestr(f"{root}/files/{d}", z.read(f"{root}/files/{d}"))
                n += 1
    return n


#: Of the program's error output, this much of the end is kept.
TAIL = 2_000
RESULT = "lang string, ok boolean, empty boolean, failed boolean, entries long, tail string"


def run_indexer(command: list[str], sha: str) -> tuple[list[tuple], tuple[bool, bool, bool, int, str]]:
    """Entries of one unit, and how its program ended: (ok, empty, failed, entries, tail). A program that can't be started
    or fails gives no entries and a failed unit, not an error."""
    from .entries import stream

    try:
        done = subprocess.run(command, capture_output=True, check=False)
    except OSError as error:
        return [], (False, False, True, 0, f"sha={sha} spawn: {error}")
    rows = [(sha, *one) for one in stream(done.stdout, tolerant=True)]
    if done.returncode:
        tail = done.stderr[-TAIL:].decode("utf-8", "replace").strip()
        return [], (False, False, True, len(rows), f"sha={sha} exit={done.returncode}\n{tail}".strip())
    return rows, (bool(rows), not rows, False, len(rows), "")


def indexed(units: DataFrame, command: Callable[[dict, str, str], list[str]], archive: str | None = None, staging: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of external indexers, and a row a unit: sha and ``RESULT``. ``command`` gives the program and its arguments for
    a unit, its sha, and the path of its archive. With ``archive`` each unit is put in an archive of its own, as it is given, in the
    folder ``staging``, and taken away after its program has ended; that is the program's scratch, nothing is read from it later.
    Every program is started once: what comes of it is written."""
    from ..schema import ENTRY
    from .entries import _frame
    from .tables import cut

    names = [x.split(" ")[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sha, unit in zip(batch["sha"], batch["unit"], strict=True):
                at = ""
                try:
                    if archive:
                        if staging:
                            os.makedirs(staging, exist_ok=True)
                        with tempfile.NamedTemporaryFile(dir=staging, prefix=f"{sha}.", suffix=".kzip", delete=False) as f:
                            at = f.name
                        sub_archive(archive, sha, unit, at)
                    rows, result = run_indexer(command(unit, sha, at), sha)
                except (OSError, ValueError, KeyError, zipfile.BadZipFile) as error:
                    rows, result = [], (False, False, True, 0, f"sha={sha} extract: {error}")
                finally:
                    if at and os.path.exists(at):
                        os.unlink(at)
                lang = INDEXERS.get(unit["v_name"]["language"].lower(), unit["v_name"]["language"])
                for begin in range(0, len(rows), 20_000):
                    part = _frame(rows[begin : begin + 20_000])
                    yield part.assign(**dict.fromkeys(names))
                last = _frame([(sha, None, None, None, None, None)])
                yield last.assign(**dict(zip(names, (lang, *result), strict=True)))

    written = cut(units.select("sha", "unit").mapInPandas(run, f"{ENTRY}, {RESULT}"), "indexed")
    entries = written.filter("lang is null").drop(*names)
    return entries, written.filter("lang is not null").select(F.col("cu_id").alias("sha"), *names)


def piped(units: DataFrame, command: Callable[[dict, str], list[str]]) -> DataFrame:
    """Entries of external indexers that read the unit by its sha; units whose program fails give no rows."""
    return indexed(units, lambda unit, sha, _: command(unit, sha))[0]
