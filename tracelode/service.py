"""Requests as dictionaries, replies as JSON: dispatch, a loop over lines, and a command line.

A request is ``{"cmd": VERB, "name": ..., ...}`` with the fields of the verb's function; a reply has the
verb's envelope, with fields that are null left out, except the parent of a root.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable

from .operators import verbs, walk
from .schema import Graph

_SITES = ("substr", "ignore_case", "limit", "in_", "not_in")
_HITS = (*_SITES, "max_hits", "def_in")
_WALK = ("direction", "depth", "max_syms", "substr", "root_limit", "in_", "not_in", "def_in")
#: Verb: its function, the fields that it takes, the key of its rows, and the limit that cuts it.
VERBS: dict[str, tuple[Callable, tuple[str, ...], str]] = {
    "def": (verbs.define, _SITES, "groups"),
    "ref": (verbs.refs, _HITS, "groups"),
    "callers": (verbs.callers, _HITS, "groups"),
    "super": (verbs.supers, ("substr", "limit", "in_", "not_in"), "hits"),
    "sub": (verbs.subs, ("substr", "limit", "in_", "not_in"), "hits"),
    "callgraph": (walk.callgraph, _WALK, "nodes"),
    "inheritance": (walk.inheritance, _WALK, "nodes"),
    "type": (verbs.types, ("substr", "limit"), "hits"),
    "sig": (verbs.signatures, ("substr", "limit"), "hits"),
    "members": (verbs.members, ("substr", "limit"), "members"),
}
_TAGS = {"def": "xrefs", "ref": "xrefs", "callers": "xrefs", "super": "inh", "sub": "inh"}


def _slim(row: dict, keep: tuple[str, ...] = ()) -> dict:
    return {k: v for k, v in row.items() if v is not None or k in keep}


def dispatch(g: Graph, request: dict) -> dict:
    """The reply to a request; what is wrong with it is an ``error`` reply."""
    verb = request.get("cmd")
    if verb == "stat":
        return {"kind": "stat"} | verbs.stat(g).first().asDict()
    if verb not in VERBS or not isinstance(request.get("name"), str):
        return {"kind": "error", "error": f"unknown request: {json.dumps(request)}"}
    function, fields, rows_key = VERBS[verb]
    given = {("in_" if k == "in" else k): v for k, v in request.items()}
    options = {k: given[k] for k in fields if given.get(k) is not None}
    name = request["name"]
    rows = [r.asDict() for r in function(g, name, **options).collect()]  # bounded by the request's limits
    out: dict = {"kind": _TAGS.get(verb, verb)}
    if rows_key == "groups":
        return out | _groups(g, rows, verb, name, options)
    if rows_key == "nodes":
        rows.sort(key=lambda r: r["id"])
        total = sum(r["hop"] > 0 for r in rows)
        return out | {"nodes": [_slim(r, ("parent",)) for r in rows], "total": total, "truncated": total > 0 and len(rows) >= options.get("max_syms", walk.MAX_SYMS)}
    rows.sort(key=lambda r: r["seq"])
    rows = [_slim({k: v for k, v in r.items() if k != "seq"}) for r in rows]
    out |= {rows_key: rows, "total": len(rows)}
    if verb not in ("super", "sub"):
        out["truncated"] = len(rows) >= options.get("limit", verbs.LIMIT)
    if verb == "members":
        out["container"] = _container(g, name, options)
    return out


def _container(g: Graph, name: str, options: dict) -> str:
    from pyspark.sql import functions as F

    from .operators.resolve import lookup
    from .schema import CONTAINERS

    syms = lookup(g, name, options.get("substr", False), max(options.get("limit", verbs.LIMIT), verbs.LEAST_SYMS))
    last = g.syms.filter(F.col("kind").isin(*CONTAINERS)).join(syms, "sym").orderBy(F.desc("seq")).select("name").first()
    return last["name"] if last else name


def _groups(g: Graph, rows: list[dict], verb: str, name: str, options: dict) -> dict:
    order = {"decl": 0, "def": 1, "ref": 2, "call": 3}
    rows.sort(key=lambda r: (r["group_seq"], order.get(r["role"], 9), r["file"], r["off"]))
    groups: dict[int, dict] = {}
    for r in rows:
        head = _slim({k: r.get(k) for k in ("name", "kind", "lang", "typed", "sig")}) | {"rows": []}
        groups.setdefault(r["group_seq"], head)["rows"].append({k: r[k] for k in ("role", "file", "off")})
    limit = options.get("limit", verbs.LIMIT)
    cut = verb != "def" and len(rows) >= max(1, options.get("max_hits", verbs.MAX_HITS))
    if not cut and options.get("substr"):
        from .operators.resolve import substring

        most = limit if verb == "def" else max(limit, verbs.LEAST_SYMS)
        cut = substring(g.names, name, most, options.get("ignore_case", False), g.likely(name)).count() >= most
    return {"groups": list(groups.values()), "total": len(rows), "truncated": cut}


def repl(g: Graph, lines: Iterable[str]) -> Iterable[str]:
    """One reply a request line; blank lines are passed over and bad ones answered with an error."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            reply = dispatch(g, request) if isinstance(request, dict) else {"kind": "error", "error": "not an object"}
        except Exception as error:
            reply = {"kind": "error", "error": str(error)[:500]}
        yield json.dumps(reply, ensure_ascii=False)


def default_socket(index: str) -> str:
    """The socket of an index's server."""
    return f"{index.rstrip('/')}.sock"


def serve(g: Graph, path: str, ready=None, most: int | None = None) -> None:
    """Answers connections one after the other, a reply a line; after ``most`` of them it ends."""
    import os
    import socket

    if os.path.exists(path):
        os.unlink(path)
    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as server:
        server.bind(path)
        server.listen()
        if ready is not None:
            ready.set()
        while most is None or most > 0:
            connection, _ = server.accept()
            most = most if most is None else most - 1
            with connection, connection.makefile("rw", encoding="utf-8") as stream:
                for reply in repl(g, stream):
                    stream.write(reply + "\n")
                    stream.flush()


def client_call(path: str, request: dict) -> dict:
    """The reply of a server to one request."""
    import socket

    with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
        s.connect(path)
        with s.makefile("rw", encoding="utf-8") as stream:
            stream.write(json.dumps(request) + "\n")
            stream.flush()
            s.shutdown(socket.SHUT_WR)
            return json.loads(stream.readline())


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .sources import index, kzip
    from .sources.entries import read

    parser = argparse.ArgumentParser(prog="tracelode")
    parser.add_argument("--index", default="graph.index", type=expanded)
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--socket", type=expanded, help="of a server that answers; with serve, where to listen")
    sub = parser.add_subparsers(dest="cmd", required=True)
    for verb, (_, fields, _) in VERBS.items():
        own = sub.add_parser(verb)
        own.add_argument("name")
        for f in fields:
            flag = "--" + f.rstrip("_").replace("_", "-")
            if f in ("substr", "ignore_case"):
                own.add_argument(*(["-i"] if f == "ignore_case" else []), flag, action="store_true", default=None)
            else:
                own.add_argument(flag, dest="in" if f == "in_" else f, type=int if f in ("limit", "max_hits", "depth", "max_syms", "root_limit") else str)
    own = sub.add_parser("names")
    own.add_argument("name")
    own.add_argument("--limit", type=int, default=32)
    sub.add_parser("stat")
    sub.add_parser("repl")
    sub.add_parser("serve")
    own = sub.add_parser("index")
    own.add_argument("--entries", nargs="+", required=True, type=expanded, help="files or folders; - for the standard input")
    own.add_argument("--tolerant", action="store_true")
    own = sub.add_parser("normalize-kzip")
    own.add_argument("archive", type=expanded)
    own.add_argument("out", type=expanded)
    own = sub.add_parser("debug-marked-source")
    own.add_argument("file", type=expanded)
    own = sub.add_parser("from-kzip")
    own.add_argument("archive", type=expanded)
    own.add_argument("--out", type=expanded, help="the index; --index if it isn't given")
    own.add_argument("--kythe-root", type=expanded, help="folder of the usual indexers, below indexers/")
    own.add_argument("--indexer", action="append", default=[], metavar="KIND=COMMAND", help="program of a kind of unit; {sha}, {archive} and {unit} (an archive of the unit alone) are filled in")
    own.add_argument("--langs", type=lambda x: x.split(","))
    own.add_argument("--in", dest="in_", action="append", type=lambda x: x.split(","))
    own.add_argument("--not-in", action="append", type=lambda x: x.split(","))
    own.add_argument("--jvm-heap", default="8g")
    own.add_argument("--staging", type=expanded, help="folder for archives of single units")
    own.add_argument("--workers", type=int, default=0, help="units at once; 0: as many as there are cores")
    own.add_argument("--inject-cu-arg", action="append", default=[], metavar="PREFIX::ARG")
    own.add_argument("--resume", action="store_true")
    own.add_argument("--snapshot-every", type=int, default=2000)
    own.add_argument("--snapshot-rows", type=int, default=250_000_000)
    own.add_argument("--cache-dir", type=expanded)
    own.add_argument("--clean", action="store_true")
    args = vars(parser.parse_args(argv))
    if args.get("clean") and not args.get("cache_dir"):
        parser.error("--clean needs --cache-dir")
    if args["cmd"] == "debug-marked-source":
        from .functions.render import qualified_name

        with open(args["file"], "rb") as f:
            print(qualified_name(f.read()))
        return 0
    cmd = args["cmd"]
    if args["socket"] and (cmd in VERBS or cmd == "stat"):
        reply = client_call(args["socket"], _request(args))
        return _emit(reply, args["json"])
    spark = SparkSession.builder.getOrCreate()
    if cmd == "normalize-kzip":
        print(kzip.write_normalized(args["archive"], args["out"]))
        return 0
    if cmd == "from-kzip":
        return _from_kzip(spark, args)
    if cmd == "index":
        from .operators.ingest import graph
        from .sources.entries import decode

        files = [e for e in args["entries"] if e != "-"]
        entries = read(spark, *files, tolerant=args["tolerant"]) if files else None
        if "-" in args["entries"]:
            given = decode(spark, sys.stdin.buffer.read(), tolerant=args["tolerant"])
            entries = given if entries is None else entries.unionByName(given)
        index.write(graph(entries), args["index"])
        return 0
    g = index.read(spark, args["index"])
    if cmd == "repl":
        for reply in repl(g, sys.stdin):
            print(reply, flush=True)
        return 0
    if cmd == "serve":
        serve(g, args["socket"] or default_socket(args["index"]))
        return 0
    if cmd == "names":
        from .operators.resolve import prefix

        rows = [r.asDict() for r in prefix(g.names, args["name"], args["limit"]).collect()]
        reply = {"kind": "names", "hits": rows, "total": len(rows)}
    else:
        reply = dispatch(g, _request(args))
    return _emit(reply, args["json"])


def expanded(path: str) -> str:
    """A path with the home folder in place of a leading ``~``."""
    import os

    home = os.environ.get("HOME")
    if home and (path == "~" or path.startswith("~/")):
        return home + path[1:]
    return path


def shown(reply: dict) -> tuple[list[str], list[str]]:
    """A reply as lines for people: what goes to the standard output, and the notes."""
    kind, out, notes = reply["kind"], [], []
    label = lambda h: f"{h['name']}  [{h['kind']}/{h['lang']}]"
    if kind == "error":
        return out, [f"error: {reply['error']}"]
    if kind == "stat":
        return [f"{k + ':':<8}{reply[k]}" for k in ("xrefs", "syms", "files", "inhs", "calls")], notes
    if kind == "xrefs":
        for g in reply["groups"]:
            out.append(f"# {label(g)}" + (f"  : {g['typed']}" if "typed" in g else ""))
            out += [f"  sig: {g['sig']}"] if "sig" in g else []
            out += [f"  {r['role']} {r['file']}@{r['off']}" for r in g["rows"]]
    elif kind in ("type", "sig"):
        for h in reply["hits"]:
            out += [f"# {label(h)}", f"  {h['typed' if kind == 'type' else 'sig']}"]
    elif kind == "members":
        out.append(f"# {reply['container']}")
        out += [f"  {m['name']} [{m['kind']}/{m['lang']}]" + (f"  {m['sig']}" if "sig" in m else "") for m in reply["members"]]
    elif kind in ("inheritance", "callgraph"):
        for n in reply["nodes"]:
            parent = "-" if n["parent"] is None else str(n["parent"])
            out.append(f"  id={n['id']:<3} parent={parent:<3} hop={n['hop']} {n['dir']:<4} {n['kind']:<9} {n['name']}" + (f"  {n['def']}" if "def" in n else ""))
    elif kind == "inh":
        out += [h["name"] + (f"  {h['def']}" if "def" in h else "") for h in reply["hits"]]
    elif kind == "names":
        out += [f"{h['sym']}  {h['name']}" for h in reply["hits"]]
    if reply.get("truncated"):
        if kind == "callgraph":
            notes.append("(callgraph truncated)")
        elif kind == "inheritance":
            notes.append(f"(showing {len(reply['nodes'])}; --max-syms cap reached, more exist — raise --max-syms)")
        else:
            notes.append(f"(showing {reply['total']}; --limit cap reached, more exist — raise --limit)")
    return out, [*notes, f"{'members' if kind == 'members' else 'hits'}={reply['total']}"]


def _emit(reply: dict, as_json: bool) -> int:
    """Prints a reply, as JSON or for people; counts and what was cut off go to the standard error."""
    if as_json:
        print(json.dumps(reply, ensure_ascii=False))
    else:
        out, notes = shown(reply)
        for line in out:
            print(line)
        for line in notes:
            print(line, file=sys.stderr)
    return 1 if reply["kind"] == "error" else 0


def _request(args: dict) -> dict:
    return {k: v for k, v in args.items() if v is not None and k not in ("index", "json", "socket")}


def usual_indexers(root: str, heap: str) -> dict[str, str]:
    """The commands of the usual indexers below a folder, by kind of unit."""
    java = f"java -Xmx{heap} -jar {root}/indexers/{{}}_indexer.jar --ignore_empty_kzip --temp_directory {{{{scratch}}}} {{{{unit}}}}"
    return {
        "cxx": f"{root}/indexers/cxx_indexer {{unit}}",
        "go": f"{root}/indexers/go_indexer {{unit}}",
        "java": java.format("java"),
        "jvm": java.format("jvm"),
        "proto": f"{root}/indexers/proto_indexer -index_file={{unit}}",
        "textproto": f"{root}/indexers/textproto_indexer --index_file={{unit}}",
    }


def injections(rules: list[str]) -> list[tuple[str, str]]:
    """(prefix, argument) of rules ``PREFIX::ARG``."""
    out = []
    for rule in rules:
        prefix, mark, arg = rule.partition("::")
        if not mark or not arg:
            raise SystemExit(f"--inject-cu-arg {rule!r} is not PREFIX::ARG")
        out.append((prefix, arg))
    return out


def _from_kzip(spark, args: dict) -> int:
    """An index of an archive's units, by the indexers that are given. Units are ingested in batches into a cache: the given
    one, or one beside the index that is taken away when the index is there, and from which ``--resume`` goes on."""
    import os
    import shlex
    import tempfile

    from pyspark.sql import functions as F

    from .operators.ingest import run_stats
    from .sources import index, kzip
    from .sources.cache import UnitCache, build

    out, archive = args["out"] or args["index"], args["archive"]
    programs = usual_indexers(args["kythe_root"], args["jvm_heap"]) if args["kythe_root"] else {}
    programs |= dict(x.split("=", 1) for x in args["indexer"])
    flat = lambda parts: [x for p in parts or [] for x in p if x]
    in_, not_in = flat(args["in_"]), flat(args["not_in"])
    accept = None
    if in_ or not_in:
        accept = lambda path: (not in_ or any(x in (path or "") for x in in_)) and not any(x in (path or "") for x in not_in)
    plan = kzip.plan(kzip.read_units(spark, archive, accept, args["workers"]), args["langs"], in_, not_in)
    plan = plan.filter(F.col("indexer").isin(*programs))
    if plan.isEmpty():
        raise SystemExit("no unit passes the filters and has an indexer")
    argument = kzip.rewritten(F.col("unit.argument"), F.coalesce("path", F.lit("")), inject=injections(args["inject_cu_arg"]))
    plan = plan.withColumn("unit", F.col("unit").withField("argument", argument)).withColumn("cu_id", F.col("sha"))
    alone = any("{unit}" in p for p in programs.values())

    def command(unit: dict, sha: str, at: str) -> list[str]:
        kind = kzip.INDEXERS[unit["v_name"]["language"].lower()]
        scratch = os.path.dirname(at) or tempfile.gettempdir()
        return [p.format(sha=sha, archive=archive, unit=at, scratch=scratch) for p in shlex.split(programs[kind])]

    if args["cache_dir"]:
        cache = UnitCache(spark, args["cache_dir"])
        if args["clean"]:
            cache.clear()
        plan = plan.withColumn("digest", kzip.digest(F.col("indexer"), F.col("unit")))
    else:
        cache = UnitCache(spark, f"{out.rstrip('/')}.partial")
        if not args["resume"]:
            cache.clear()
        plan = plan.withColumn("digest", F.col("sha"))
    results = []

    def ingest(missing):
        if args["workers"]:
            missing = missing.repartition(args["workers"])
        entries, result = kzip.indexed(missing, command, archive if alone else None, args["staging"])
        results.append(result)
        # a unit that failed or said nothing isn't stored, so a later run asks for it again
        return entries.join(result.filter("ok").select(F.col("sha").alias("cu_id")), "cu_id", "left_semi")

    g = build(spark, cache, plan, ingest, args["snapshot_every"], args["snapshot_rows"])
    index.write(g, out)
    if not args["cache_dir"]:
        cache.clear()
    if results:
        every = results[0]
        for r in results[1:]:
            every = every.unionByName(r)
        for r in run_stats(every).orderBy("lang").collect():  # a row a language
            print(f"{r['lang']}: units={r['units']} ok={r['ok']} empty={r['empty']} failed={r['failed']} entries={r['entries']}", file=sys.stderr)
            for i, tail in enumerate(r["tails"], 1):
                print(f"{r['lang']} failure {i}/{len(r['tails'])}: {tail}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
