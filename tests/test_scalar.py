import xxhash
from pyspark.sql import functions as F

from tracelode.functions import scalar as S
from tracelode.operators.resolve import trigrams


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "v string").select(*columns).first())


def test_sym_of_is_seed_zero(spark):
    for text in ("", "a", "kythe:c++:c#r#p#s", "é" * 50):
        want = xxhash.xxh64_intdigest(text, 0)
        got = one(spark, text, S.sym_of(F.col("v")), S.sym_hex(S.sym_of(F.col("v"))))
        assert got == (want - (1 << 64) if want >= 1 << 63 else want, f"0x{want:016x}")


def test_unsigned_order(spark):
    rows = [(n - (1 << 64) if n >= 1 << 63 else n,) for n in (5, 1 << 63, (1 << 64) - 1, 0, (1 << 63) - 1)]
    got = [r[0] % (1 << 64) for r in spark.createDataFrame(rows, "v long").orderBy(S.sym_order(F.col("v"))).collect()]
    assert got == sorted(got)


def test_keys_and_names(spark):
    t = "kythe:java:c#r#p/A.java#SIG"
    assert one(spark, t, S.logical_key(F.col("v"))) == ("SIG",)
    assert one(spark, "a.B#c", S.logical_key(F.col("v"))) == ("a.B#c",)
    shown = lambda p, o: S.display_name(F.col("v"), F.lit(p).cast("string"), F.lit(o).cast("long"))
    assert one(spark, t, shown("x/Y.java", 7), shown(None, None)) == ("anon@x/Y.java@7", "SIG")
    assert one(spark, "kythe:java:c#r#p#", shown(None, None)) == ("kythe:java:c#r#p#",)
    assert one(spark, "ns::C.m", S.short_name(F.col("v")), S.bare_param(F.lit("xs[4] "))) == ("m", "xs")


def test_descriptors(spark):
    got = {v: one(spark, v, S.strip_descriptor(F.col("v")))[0] for v in ("a.m()V", "a.m(ILjava/lang/String;)J", "f(x)", "()V", "plain", "a.m(I)")}
    assert got == {"a.m()V": "a.m", "a.m(ILjava/lang/String;)J": "a.m", "f(x)": None, "()V": None, "plain": None, "a.m(I)": None}


def test_fold_is_ascii_only(spark):
    assert one(spark, "ÀBc", S.fold(F.col("v"))) == ("Àbc",)


def test_clamp_keeps_characters(spark):
    long = "é" * 40_000
    (got,) = one(spark, long, S.clamp(F.col("v")))
    assert len(got.encode()) <= 65_535 and got == "é" * len(got) and len(got) == 32_767
    assert one(spark, "short", S.clamp(F.col("v"))) == ("short",)


def test_numbers_and_ordinals(spark):
    assert one(spark, "4294967295", S.decimal(F.col("v"))) == (4294967295,)
    for bad in ("4294967296", "-1", "1x", ""):
        assert one(spark, bad, S.decimal(F.col("v"))) == (None,)
    assert one(spark, "/kythe/edge/param.3", S.param_ordinal(F.col("v"))) == (3,)
    assert one(spark, "/kythe/edge/param", S.param_ordinal(F.col("v"))) == (None,)


def test_builtin_op(spark):
    got = [one(spark, v, S.builtin_op(F.col("v")))[0] for v in ("ptr#builtin", "#builtin", "ptr")]
    assert got == ["ptr", None, None]


def test_trigrams_are_bytes(spark):
    (got,) = one(spark, "aÉbA", trigrams(F.col("v")))
    data = "aÉba".encode()
    assert got == [data[i : i + 3].hex().upper() for i in range(len(data) - 2)]
    assert one(spark, "ab", trigrams(F.col("v"))) == ([],)


def test_path_filter_is_literal(spark):
    rows = spark.createDataFrame([("a%b",), ("a_b",), ("axb",)], "p string")
    keep = lambda **f: [r[0] for r in rows.filter(S.passes(F.col("p"), **f)).collect()]
    assert keep(in_="a%") == ["a%b"] and keep(not_in="_") == ["a%b", "axb"] and S.passes(F.col("p"), in_="", not_in=None) is None
