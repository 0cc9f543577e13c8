"""Secret scans, in DataFrame functions only.

Base spans are the matches of three patterns: ``assign`` (a key word, ``:`` or ``=``, a value of six
or more characters), ``access`` (an access key id of 20 or more) and ``hex`` (a run of 24 or more).

Further spans, of kind ``random``, come from a battery of randomness tests. A token of 20 or more
characters of the base64 alphabets is given the encoding that its characters fit (hex, base32,
base36, base64); a token of letters of one case, or a word with a capital, fits none. Its
characters' places in that alphabet are tested against uniform independent draws:

* chi-squared over eight equal cells of the alphabet,
* chi-squared over kinds of characters (vowels, frequent consonants, other small letters, capitals,
  digits and signs), each weighed by how much of the alphabet it is,
* runs above and below the alphabet's middle, two-sided,
* serial correlation at lag one, two-sided.

The p-value of a token is the chance that the least of four such values is as small. Random tokens have even p-values; others
have small ones. Tokens of one encoding and one class of length (powers of two) are a family, as long tokens
have far more power than short ones, and each family has its own threshold, by which false discoveries among the *reported* tokens are
controlled: ``EVEN`` and more has only random tokens, so their number there tells how many random ones there are in all; what a
family has above a threshold beyond their share of that is false. The threshold is the least for which this is at most ``RATE`` of
what is reported. P-values are counted in bins of a hundredth of a decade, so the rule needs only a small table of counts.

Defined results: a null or empty text has no spans; repeated rows are repeated; tokens of equal p-values are reported alike; other columns are
ignored; a text of very many spans takes time about in proportion to its length; offsets are code points, ends exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, table

#: Kinds in the order in which spans of one start are listed, with their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
RATE = 0.05  # of tokens that aren't random among those that are reported, about
EVEN = -30  # bin (p of about one half) from which on tokens are taken to be random
MASK = "<SECRET>"
_SLICE = 512  # matches of a text that are placed at once
_PIECES = (1 << 22, 1 << 17, 1 << 12)  # code points of the pieces that a text is masked in
_CELLS = 8
_BIN = 100  # bins to a decade of p
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: A token has encoding X if it fits the pattern; the first that fits counts.
_FITS = {
    "hex": "^[0-9a-f]*[0-9][0-9a-f]*$",
    "base32": "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$",
    "base36": "^(?=.*[0-9].*[0-9])(?=.*[a-z])[a-z0-9]+$",
    "base64": "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+=*$",
}


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, value); value is ``group``'s text, or the match.
    An array that grows is copied at each step, so matches are placed in slices, and slices are put together."""
    kind = "array<struct<start:int,end:int,value:string>>"
    empty = F.array().cast(kind)

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("all"))

    def placed(rows: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(rows, i, F.lit(_SLICE)), F.struct(acc["at"].alias("at"), empty.alias("all")), one)
            return _bound(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["all"], F.array(p["all"])).alias("all")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(rows), F.lit(_SLICE)), begin, step, lambda acc: acc["all"]))

    def spans(hits: Column) -> Column:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"), value.alias("value"))
        sizes = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["value"].alias("value")))
        return F.when(F.size(hits) > 0, _bound(sizes, placed)).otherwise(empty)

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, arrays of (start, kind, end)."""
    word = F.when(text.rlike("(?i)password|passwd|secret|token|api_?key"), text).otherwise("")
    assign = F.filter(_found(word, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    access = _found(F.when(text.contains("AKIA"), text).otherwise(""), ACCESS)
    return {"assign": _spans(assign, "assign"), "access": _spans(access, "access"), "hex": _spans(_found(text, HEX), "hex")}


def _tail(z: Column) -> Column:
    """About the chance that a normal variable is above z (logistic form, within 0.0002 near 0)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _chi_tail(x: Column, free: float) -> Column:
    """About the chance of a chi-squared value above x (cube root form)."""
    return _tail((F.pow(x / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5)


def _kind(c: str) -> str:
    """Kind of a character: written natural text has its own shares of them."""
    if c in "aeiou":
        return "v"
    if c in "tnsrhld":
        return "c"
    return "o" if c.islower() else "U" if c.isupper() else "0"


def _battery(token: Column, alphabet: str) -> Column:
    """P-value of the token's characters as independent uniform draws from ``alphabet``."""
    own = F.rtrim(token, F.lit("="))
    size = float(len(alphabet) if alphabet != _ALPHABETS["base64"] else 64)
    at = F.transform(F.split(own, ""), lambda c: F.least(F.instr(F.lit(alphabet), c).cast("double") - 1, F.lit(size - 1)))

    kinds = "".join(_kind(c) for c in alphabet)
    shape = F.translate(own, alphabet, kinds)

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        counts = F.transform(F.array([F.lit(float(i)) for i in range(_CELLS)]), lambda i: F.size(F.filter(v, lambda x: F.floor(x * _CELLS / size) == i)).cast("double"))
        chi = total(F.transform(counts, lambda c: (c - n / _CELLS) * (c - n / _CELLS) / (n / _CELLS)))
        p_chi = _chi_tail(chi, _CELLS - 1.0)
        parts = {k: kinds[: int(size)].count(k) / size for k in sorted(set(kinds))}
        seen = {k: n - F.length(F.replace(shape, F.lit(k), F.lit(""))) for k in parts}
        p_kinds = _chi_tail(sum((seen[k] - n * p) * (seen[k] - n * p) / (n * p) for k, p in parts.items()), len(parts) - 1.0)
        pairs = F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = total(F.transform(v, lambda x: (x >= size / 2).cast("double")))
        runs = 1 + total(F.transform(pairs, lambda p: ((p["a"] >= size / 2) != (p["b"] >= size / 2)).cast("double")))
        mean = 2 * high * (n - high) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(var > 0, 2 * _tail(F.abs(runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
        mid = (size - 1) / 2
        square = total(F.transform(v, lambda x: (x - mid) * (x - mid)))
        lag = total(F.transform(pairs, lambda p: (p["a"] - mid) * (p["b"] - mid)))
        p_serial = F.when(square > 0, 2 * _tail(F.abs(lag / F.greatest(square, F.lit(1e-9))) * F.sqrt(n))).otherwise(0.0)
        low = F.least(F.lit(1.0), F.greatest(F.lit(1e-30), F.least(p_chi, p_kinds, p_runs, p_serial)))
        return F.when(low < 1e-9, 4 * low).otherwise(1 - F.pow(1 - low, F.lit(4.0)))

    return _bound(at, tests)


def candidates(text: Column) -> Column:
    """Tokens of an inferred encoding: array of (start, end, family, bin of p)."""
    kind = lambda t: F.coalesce(*[F.when(t.rlike(p), F.lit(k)) for k, p in _FITS.items()])
    named = F.transform(_found(text, TOKEN), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), kind(x["value"]).alias("kind")))

    def tested(x: Column) -> Column:
        p = F.coalesce(*[F.when(x["kind"] == k, _battery(x["value"], a)) for k, a in _ALPHABETS.items()])
        family = F.concat(x["kind"], F.lit(":"), F.floor(F.log2(F.length(x["value"]).cast("double"))).cast("string"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), family.alias("family"), F.floor(F.log10(F.greatest(p, F.lit(1e-30))) * _BIN).cast("int").alias("bin"))

    return F.transform(F.filter(named, lambda x: x["kind"].isNotNull()), tested)


def thresholds(tokens: DataFrame, rate: float = RATE) -> dict[str, int]:
    """For each family the bin of p above which its tokens are reported. ``tokens``: family and bin of
    each token. There are four encodings and 32 classes of length at most, so it is a small table."""
    from pyspark.sql import Window

    by = Window.partitionBy("family")
    counts = tokens.groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(by.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    random = F.coalesce(F.sum(F.when(F.col("bin") >= EVEN, F.col("n"))).over(by), F.lit(0)) / (1 - 10 ** (EVEN / _BIN))
    counts = counts.withColumn("above", above).withColumn("random", random)
    false = F.col("above") - F.col("random") * (1 - F.pow(F.lit(10.0), F.col("bin") / _BIN))
    allowed = F.min(F.when(false <= rate * F.col("above"), F.col("bin")))
    return {r["family"]: min(EVEN, EVEN if r["bin"] is None else r["bin"]) - 1 for r in counts.groupBy("family").agg(allowed.alias("bin")).collect()}


def random_spans(tokens: Column, limits: dict[str, int], base: Column) -> Column:
    """Spans of the tokens above their family's limit that don't lie in a base span."""
    if not limits:
        return _spans(F.filter(tokens, lambda x: F.lit(False)), "random")
    names = F.create_map(*[F.lit(v) for pair in sorted(limits.items()) for v in pair])  # 128 families at most
    kept = F.filter(tokens, lambda x: x["bin"] > F.element_at(names, x["family"]))

    def outside(v: Column) -> Column:
        def part(own: Column) -> Column:
            first, last = F.get(own, F.lit(0))["start"], F.get(own, F.size(own) - 1)["end"]
            near = F.filter(v["base"], lambda b: (b["start"] < last) & (b["end"] > first))
            return _bound(near, lambda n: F.filter(own, lambda x: ~F.exists(n, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))))

        starts = F.sequence(F.lit(1), F.greatest(F.size(v["kept"]), F.lit(1)), F.lit(_SLICE))
        return F.flatten(F.transform(starts, lambda i: _bound(F.slice(v["kept"], i, F.lit(_SLICE)), part)))

    return _spans(_bound(F.struct(kept.alias("kept"), base.alias("base")), outside), "random")


def _joined(spans: Column) -> Column:
    names = F.array([F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(one, ",")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with columns assign, access, hex (base spans) and tokens (candidates), in one struct ``found``."""
    text = F.coalesce("text", F.lit(""))
    found = base_spans(text) | {"tokens": candidates(text)}
    return docs.withColumn(free_name(docs, "found"), F.struct(*[c.alias(k) for k, c in found.items()]))


def _masked(v: Column, sizes: tuple[int, ...] | None = None) -> Column:
    """``text`` of ``v``, which begins at ``low``, with its part of the ``spans`` (in order) replaced. A long text is cut in pieces,
    and these again, each with the spans that reach into it, as to find a place in a text takes time in proportion to its length."""
    sizes = _PIECES if sizes is None else sizes
    if sizes:

        def piece(i: Column) -> Column:
            low = v["low"] + i
            near = F.filter(v["spans"], lambda x: (x["start"] < low + sizes[0]) & (x["end"] > low))
            own = F.struct(F.substring(v["text"], i + 1, F.lit(sizes[0])).alias("text"), low.alias("low"), near.alias("spans"))
            return _bound(own, lambda w: _masked(w, sizes[1:]))

        starts = F.sequence(F.lit(0), F.greatest(F.length(v["text"]) - 1, F.lit(0)), F.lit(sizes[0]))
        return F.array_join(F.transform(starts, piece), "")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        told = F.when(fresh, F.concat(F.substring(v["text"], acc["at"] - v["low"] + 1, x["start"] - acc["at"]), F.lit(MASK))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(told)).alias("out"))

    begin = F.struct(v["low"].alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(v["text"], acc["at"] - v["low"] + 1, F.length(v["text"])))
    return F.aggregate(v["spans"], begin, step, rest)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, base or random, of ``text`` replaced by ``MASK`` and ``n_chars`` recounted;
    all rows stay. Spans that overlap are one."""
    scanned = cut(scan(docs), "scanned")  # texts are scanned once
    name = scanned.columns[-1]
    families = scanned.select(F.explode(f"{name}.tokens").alias("t")).select("t.family", "t.bin")
    limits = thresholds(families)
    f, at = F.col(name), free_name(scanned, "spans_of")
    base = F.concat(f["assign"], f["access"], f["hex"])
    scanned = scanned.withColumn(at, F.array_sort(F.concat(base, random_spans(f["tokens"], limits, base))))
    spans = F.col(at)

    whole = F.struct(F.col("text").alias("text"), F.lit(0).alias("low"), spans.alias("spans"))
    out = scanned.withColumn("text", F.when(F.size(spans) > 0, _bound(whole, lambda v: _masked(v))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(name, at)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of spans), spans (all) for every row of ``docs`` (doc_id, text)."""
    scanned = cut(scan(docs.select("doc_id", "text")).select("doc_id", "found.*"), "secrets")
    limits = thresholds(scanned.select(F.explode("tokens").alias("t")).select("t.family", "t.bin"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    out = scanned.withColumn("base", base)
    return out.withColumn("spans", F.array_sort(F.concat("base", random_spans(F.col("tokens"), limits, F.col("base")))))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
