import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracelode.plans.sample import unit, units
from tracelode.sources import kzip


@pytest.fixture
def archive(tmp_path):
    path = str(tmp_path / "x.kzip")
    a, b = unit("src/a.cc", ["-c", "a.cc", "-fprofile-use=x"]), unit("src/B.java", ["B"])
    b["v_name"] = b["v_name"] | {"language": "java"}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("root/pbunits/s1", kzip.encode_unit(a))
        z.writestr("root/units/s1", b"{}")
        camel = {"unit": {"vName": {"language": "Java"}, "requiredInput": [{"vName": {"path": "src/B.java"}, "info": {"path": "src/B.java", "digest": "d2"}}], "sourceFile": [], "argument": ["B"]}}
        z.writestr("root/units/s2", json.dumps(camel))
        z.writestr("root/units/deep/s3", b"{}")
        z.writestr("root/files/d1", b"int a;")
    return path


def test_unit_round_trip():
    u = unit("a.cc", ["x", "y"])
    assert kzip.decode_unit(kzip.encode_unit(u)) == u


def test_read_units(spark, archive):
    rows = {r["sha"]: r for r in kzip.read_units(spark, archive).collect()}
    assert set(rows) == {"s1", "s2"} and rows["s1"]["is_proto"] and rows["s1"]["unit"]["argument"][0] == "-c"
    assert rows["s2"]["unit"]["required_input"][0]["info"]["digest"] == "d2"
    assert [r["sha"] for r in kzip.read_units(spark, archive, accept=lambda p: p.endswith(".java")).collect()] == ["s2"]


def test_plan(spark, archive):
    found = kzip.plan(kzip.read_units(spark, archive))
    assert {(r["sha"], r["indexer"], r["path"]) for r in found.collect()} == {("s1", "cxx", "src/a.cc"), ("s2", "java", "src/B.java")}
    assert kzip.plan(found.drop("path", "lang", "indexer"), langs=["java"], in_=["src/"], not_in=["zzz"]).count() == 1


def test_arguments(spark, archive):
    rows = kzip.read_units(spark, archive).filter("sha = 's1'")
    args = kzip.rewritten(F.col("unit.argument"), F.lit("src/a.cc"), inject=[("src/", "-DX"), ("other/", "-DY"), ("src/", "-c")])
    assert rows.select(args.alias("a")).first()["a"] == ["-DX", "-c", "a.cc"]


def test_digest(spark):
    got = {r["sha"]: r["d"] for r in units(spark).select("sha", kzip.digest(F.lit("t"), F.col("unit")).alias("d")).collect()}
    assert got["same1"] == got["same2"] and len({got["same1"], got["argv"], got["input"]}) == 3


def test_normalize(spark, archive, tmp_path):
    out = str(tmp_path / "y.kzip")
    assert kzip.write_normalized(archive, out) == 2
    with zipfile.ZipFile(out) as z:
        assert {"root/pbunits/s1", "root/pbunits/s2", "root/files/d1"} <= set(z.namelist())
    assert kzip.read_units(spark, out).count() == 2


def test_piped(spark, archive):
    from tracelode.sources.entries import encode
    from tracelode.plans.sample import vname

    data = encode(vname("x"), fact_name="/kythe/node/kind", fact_value=b"record").hex()
    command = lambda u, sha: ["python", "-c", f"import sys; sys.stdout.buffer.write(bytes.fromhex('{data}')); sys.exit({0 if u['argument'][0] == 'B' else 3})"]
    assert [r["cu_id"] for r in kzip.piped(kzip.read_units(spark, archive), command).collect()] == ["s2"]


def test_cache(spark, tmp_path):
    """Only units whose digest changed are ingested again; the graph is that of a build from scratch."""
    from tracelode.operators.ingest import graph
    from tracelode.plans.sample import Stream, named, stream, vname
    from tracelode.sources.cache import UnitCache, build

    streams = {"u1": stream(), "u2": Stream().node(vname("#z"), "record", named("Zed")).anchor("@z", "z.cc", 9, 12, ("defines/binding", vname("#z")))}
    for k, s in streams.items():
        s.unit = k
        s.rows = [(k, *r[1:]) for r in s.rows]
    asked = []

    def ingest(missing):
        ids = sorted(r["cu_id"] for r in missing.collect())
        asked.append(ids)
        return spark.createDataFrame([r for i in ids for r in streams[i].rows], streams["u1"].frame(spark).schema)

    cache = UnitCache(spark, str(tmp_path / "cache"))
    plan = lambda **d: spark.createDataFrame(sorted(d.items()), "cu_id string, digest string")
    rows = lambda g: {n: sorted(map(tuple, df.collect())) for n, df in g.tables().items()}
    whole = rows(graph(streams["u1"].frame(spark).union(streams["u2"].frame(spark))))
    assert rows(build(spark, cache, plan(u1="a", u2="b"), ingest)) == whole
    assert rows(build(spark, cache, plan(u1="a", u2="b"), ingest)) == whole and asked == [["u1", "u2"]]
    assert rows(build(spark, cache, plan(u1="a", u2="c"), ingest)) == whole and asked[-1] == ["u2"]
    assert sorted(r["digest"] for r in cache.digests().collect()) == ["a", "c"]
    assert rows(build(spark, cache, plan(u1="a"), ingest)) == rows(graph(streams["u1"].frame(spark))) and len(asked) == 2


def test_peek_tells_what_decoding_tells(archive):
    a = unit("src/a.cc", ["-c"])
    bare = a | {"source_file": []}
    info = bare | {"required_input": [{"v_name": a["v_name"], "info": {"path": "i.cc", "digest": "d"}}]}
    named_ = bare | {"required_input": [], "v_name": a["v_name"] | {"path": "v.cc"}}
    for u in (a, bare, info, named_, bare | {"required_input": []}):
        assert (kzip.peek(kzip.encode_unit(u), True) or None) == kzip.primary_path(u)
    assert kzip.peek(b"", True) is None and kzip.peek(b"{}", False) is None


def test_rejected_units_are_not_decoded(spark, archive, tmp_path, monkeypatch):
    """A unit whose rest can't be decoded is no error where its path is rejected."""
    path = str(tmp_path / "bad.kzip")
    good = kzip.encode_unit(unit("src/a.cc", ["-c"]))
    broken = kzip.field(1, kzip.field(6, "other/b.cc") + b"\x2a\xff")  # ends early, behind its path
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("root/pbunits/s1", good)
        z.writestr("root/pbunits/s2", broken)
    assert [r["sha"] for r in kzip.read_units(spark, path, accept=lambda p: p.startswith("src/")).collect()] == ["s1"]


def test_archive_of_one_unit(spark, archive, tmp_path):
    out = str(tmp_path / "one.kzip")
    u = unit("src/a.cc", ["new"])
    assert kzip.sub_archive(archive, "s1", u, out) == 1
    (row,) = kzip.read_units(spark, out).collect()
    assert row["sha"] == "s1" and row["unit"]["argument"] == ["new"]
    with zipfile.ZipFile(out) as z:
        assert z.read("root/files/d1") == b"int a;"


def test_archives_by_address(spark, archive):
    assert kzip.read_units(spark, f"file://{archive}").count() == 2


@pytest.fixture
def programs(tmp_path):
    """An indexer that counts its starts, notes the arguments of its unit and says one node; one that fails; none for java."""
    from tracelode.plans.sample import named, stream

    s = stream()
    from tracelode.sources.entries import encode

    data = b"".join(encode(r[1], r[2], r[3], r[4], r[5]) for r in s.rows)
    (tmp_path / "entries").write_bytes(data)
    (tmp_path / "run.py").write_text(f"""
import sys, zipfile
sys.path.insert(0, {str(__file__).rsplit("/tests/", 1)[0]!r})
from tracelode.sources.kzip import decode_unit
with zipfile.ZipFile(sys.argv[2]) as z:
    (name,) = [n for n in z.namelist() if "pbunits/" in n and not n.endswith("/")]
    unit = decode_unit(z.read(name))
open({str(tmp_path)!r} + "/log", "a").write(sys.argv[1] + " " + " ".join(unit["argument"]) + "\\n")
if "fail" in unit["argument"]:
    sys.stderr.write("it broke")
    sys.exit(3)
if "empty" not in unit["argument"]:
    sys.stdout.buffer.write(open({str(tmp_path)!r} + "/entries", "rb").read())
""")
    return tmp_path


def many(tmp_path, kinds):
    path = str(tmp_path / "many.kzip")
    with zipfile.ZipFile(path, "w") as z:
        for i, kind in enumerate(kinds):
            u = unit(f"src/{i}.cc", [kind, "-fprofile-use=x"])
            u["v_name"] = u["v_name"] | {"language": "java" if kind == "java" else "c++"}
            z.writestr(f"root/pbunits/s{i}", kzip.encode_unit(u))
    return path


def test_each_indexer_is_started_once_and_failures_are_units(spark, programs, capfd):
    from tracelode import service

    path = many(programs, ["ok", "ok", "fail", "empty", "java"])
    index = str(programs / "g.index")
    run = ["--index", index, "from-kzip", path, "--indexer", f"cxx=python {programs}/run.py {{sha}} {{unit}}", "--indexer", "java=/no/such/program {unit}", "--inject-cu-arg", "src/::-DX", "--snapshot-every", "2"]
    assert service.main(run) == 0
    log = sorted((programs / "log").read_text().split("\n"))
    assert log == ["", "s0 -DX ok", "s1 -DX ok", "s2 -DX fail", "s3 -DX empty"]
    notes = capfd.readouterr().err
    assert "cxx: units=4 ok=2 empty=1 failed=1" in notes and "sha=s2 exit=3" in notes and "it broke" in notes
    assert "java: units=1 ok=0 empty=0 failed=1" in notes and "sha=s4 spawn:" in notes
    assert service.main(["--index", index, "--json", "stat"]) == 0
    from tracelode.operators.ingest import graph
    from tracelode.plans.sample import stream

    assert json.loads(capfd.readouterr().out.strip().split("\n")[-1])["syms"] == graph(stream().frame(spark)).syms.count()


def test_resume_goes_on(spark, programs, capfd):
    """What a run has stored is not asked for again with --resume; without it a run begins anew."""
    from tracelode import service
    from tracelode.sources.cache import UnitCache, build

    path = many(programs, ["ok", "ok", "ok"])
    index = str(programs / "g.index")
    plan = kzip.read_units(spark, path).withColumns({"cu_id": F.col("sha"), "digest": F.col("sha")})
    command = lambda u, sha, at: ["python", f"{programs}/run.py", sha, at]
    ended = []

    def ingest(missing):
        if ended:
            raise RuntimeError("killed")
        ended.append(1)
        return kzip.indexed(missing, command, path)[0]

    with pytest.raises(RuntimeError):
        build(spark, UnitCache(spark, f"{index}.partial"), plan, ingest, every=2)
    assert sorted((programs / "log").read_text().split()[::3]) == ["s0", "s1"]
    run = ["--index", index, "from-kzip", path, "--indexer", f"cxx=python {programs}/run.py {{sha}} {{unit}}", "--resume"]
    assert service.main(run) == 0
    assert [line.split()[0] for line in (programs / "log").read_text().strip().split("\n")][2:] == ["s2"]
    assert service.main(run[:-1]) == 0
    assert len((programs / "log").read_text().strip().split("\n")) == 6


def test_batches_by_rows(spark, tmp_path):
    from tracelode.plans.sample import stream
    from tracelode.sources.cache import UnitCache, build

    plan = spark.createDataFrame([(f"u{i}", f"d{i}") for i in range(7)], "cu_id string, digest string")
    rows, sizes = stream().rows, []

    def ingest(missing):
        ids = [r["cu_id"] for r in missing.collect()]
        sizes.append(len(ids))
        return spark.createDataFrame([(i, *r[1:]) for i in ids for r in rows], stream().frame(spark).schema)

    build(spark, UnitCache(spark, str(tmp_path / "c")), plan, ingest, every=3, rows=2 * len(rows))
    assert sizes == [3, 2, 2]
