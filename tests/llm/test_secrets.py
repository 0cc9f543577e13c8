import hashlib
import random
import re
import time

from tests.llm.helpers import SF, documents, no_documents, odd_documents
from tracelode.llm import secrets as S
from tracelode.llm.common import table

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def held(docs):
    rows = docs.select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    got = S.secret_spans(docs).collect()
    assert len(got) == rows.count()
    for r in got:
        assert [tuple(x) for x in r["base"]] == [(s, k, e) for s, k, e in base(texts[r["doc_id"]])]
        assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}
    return got


def test_whole_table(spark):
    held(documents(spark))
    rows = S.op4_secret_scan(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in rows:
        own = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in own).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in own) for i in range(3))


def test_hard_texts(spark):
    rng = random.Random(2)
    parts = ["token", "secret=", "api_key", ": ", "'", '"', "=", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0" * 24, "pass", "PASSWD:", " ", "é\U0001f600", "\n", "xyz.abc", "token=token:abcdefgh", "f" * 23]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(400)]
    held(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(spark):
    held(odd_documents(spark).filter("doc_id is not null"))
    assert S.secret_spans(no_documents(spark)).count() == 0
    assert S.mask_secrets(no_documents(spark)).columns == no_documents(spark).columns


def _tokens(rng, n):
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return ["".join(rng.choices(alphabet, k=40)) for _ in range(n)]


def test_random_tokens_are_found_and_others_are_not(spark):
    rng = random.Random(4)
    keys = [t for t in _tokens(rng, 200) if re.search("[0-9]", t)]
    plain = ["Path/to/2021/SomeModuleName/IndexOfTheThing" + str(i) for i in range(200)] + ["aaaaaaaaaaaaaaaaaaaaB1" * 2, "abcdefghijklmnopqrstuvwxyzABCDEFGH1"]
    rows = [(i, f"see {t} there") for i, t in enumerate(keys + plain)]
    found = {r["doc_id"] for r in S.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["spans"]}
    assert len(found & set(range(len(keys)))) >= 0.9 * len(keys)
    assert len(found - set(range(len(keys)))) <= 0.02 * len(plain)


def test_battery_is_calibrated(spark):
    """Under the null few p-values are small."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = spark.createDataFrame([(t,) for t in _tokens(rng, 2000)], "t string")
    small = rows.select(S._battery(F.col("t"), S._ALPHABETS["base64"]).alias("p")).filter("p < 0.05").count()
    assert small < 0.09 * 2000


WORDS = "get set index user account module parser stream handle config value buffer render widget session query table node path name list map count total service manager factory builder".split()


def _natural(rng):
    """Identifiers and paths as programmers write them."""
    words = rng.choices(WORDS, k=rng.randint(4, 8))
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(w.title() for w in words) + str(rng.randint(1, 99))
    if kind == 1:
        return "/".join(words) + f"/V{rng.randint(1, 9)}"
    if kind == 2:
        return "_".join(words) + str(rng.randint(10, 2030))
    return words[0] + "".join(w.title() for w in words[1:]) + f"{rng.randint(0, 9)}x{rng.randint(0, 9)}"


def test_false_discoveries_are_controlled(spark):
    """Planted random tokens of each encoding among natural ones: precision and recall of what is reported."""
    rng = random.Random(11)
    alphabets = {"base64": S._ALPHABETS["base64"][:62], "base36": S._ALPHABETS["base36"], "base32": S._ALPHABETS["base32"]}
    planted = ["".join(rng.choices(a, k=rng.choice((24, 32, 40, 64)))) for a in alphabets.values() for _ in range(150)]
    planted = [t for t in planted if any(re.search(p, t) for p in S._FITS.values())]
    natural = [t for t in (_natural(rng) for _ in range(3_000)) if len(t) >= 20]
    rows = [(i, f"a word {t} and more") for i, t in enumerate(planted + natural)]
    found = {r["doc_id"] for r in S.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["spans"]}
    hits, false = len([i for i in found if i < len(planted)]), len([i for i in found if i >= len(planted)])
    assert hits >= 0.9 * len(planted) and false <= 2 * S.RATE * (hits + false), (hits, len(planted), false)


def test_natural_tokens_alone_are_hardly_reported(spark):
    rng = random.Random(12)
    rows = [(i, f"a word {_natural(rng)} and more") for i in range(3_000)]
    found = S.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).filter("size(spans) > 0").count()
    assert found <= 30


def test_thresholds_by_plain_counting(spark):
    rng = random.Random(3)
    bins = [("a", int(-abs(rng.gauss(0, 300)))) for _ in range(400)] + [("a", -rng.randint(0, 60)) for _ in range(100)] + [("b", -2500)] * 50 + [("c", 0)]
    got = S.thresholds(spark.createDataFrame(bins, "family string, bin int"))
    for family in "abc":
        own = [b for f, b in bins if f == family]
        random_ = sum(b >= S.EVEN for b in own) / (1 - 10 ** (S.EVEN / 100))
        fine = [b for b in own if sum(x >= b for x in own) - random_ * (1 - 10 ** (b / 100)) <= S.RATE * sum(x >= b for x in own)]
        assert got[family] == min([S.EVEN, *fine]) - 1


def test_masking(spark):
    docs = spark.createDataFrame([(1, "my password: hunter22 ok", 24), (2, "nothing here", 12), (3, "x=" + "ab12" * 8 + " token=abcdef token=ghijkl", 0), (4, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.mask_secrets(docs).collect()}
    assert got == {1: ("my <SECRET> ok", 14), 2: ("nothing here", 12), 3: ("x=<SECRET> <SECRET> <SECRET>", 28), 4: (None, None)}


def _plainly(text, spans):
    out, at = "", 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += text[at:start] + S.MASK
        at = max(at, end)
    return out + text[at:]


def test_slices_and_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    parts = ["token=", "secret: ", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0" * 24, " ", "é\U0001f600", "\n", "some words", *_tokens(rng, 6)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r["spans"] for r in held(docs)}
    monkeypatch.setattr(S, "_SLICE", 3)
    monkeypatch.setattr(S, "_PIECES", (64, 7))
    small = {r["doc_id"]: r["spans"] for r in held(docs)}
    assert small == whole and any(x["kind"] == 3 for own in whole.values() for x in own)
    masked = {r["doc_id"]: r["text"] for r in S.mask_secrets(docs).collect()}
    assert masked == {i: _plainly(t, whole[i]) for i, t in rows}


def test_many_spans_take_time_in_proportion(spark):
    text = "\n".join(hashlib.sha1(str(i).encode()).hexdigest() + " line é" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    assert S.mask_secrets(docs).first()["text"] == re.sub("[0-9a-f]{24,}", S.MASK, text)
    assert time.monotonic() - began < 60  # minutes, if each span is copied or looked for once a span
