import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import SF, no_documents, odd_documents
from tracelode.llm import toxicity as T
from tracelode.llm.common import table


def test_grammar_composes():
    g = T.Grammar({"^vequ": 4.0, "grimble": 3.0})
    f = g.factors
    w = lambda t: pytest.approx(g.weight(t)[0])
    assert w("all is well here") == 0 and w("") == 0 and w(None) == 0
    assert w("what a grimble thing") == 3.0 and w("what a vequmo thing") == 4.0 and w("a vequ") == 0
    assert w("you are a grimble") == 3.0 * f[T.TARGET] and w("a grimble is what you are") == 3.0 * f[T.TARGET]
    assert w("this is not a grimble") == 3.0 * f[T.NEGATED]
    assert w("he said the thing there is now a grimble") == 3.0 * f[T.REPORTED]
    assert w('the word "grimble" is old') == 3.0 * f[T.REPORTED] and w('the word "old" is grimble') == 3.0
    assert w("we will kill the process") == 0 and w("i will kill you") == f[T.THREAT] * f[T.TARGET]
    assert w("you grimble, i will kill you") == 3.0 * f[T.TARGET] + f[T.THREAT] * f[T.TARGET]
    assert w("he said so. what a grimble thing") == 3.0  # reported speech ends with its clause
    assert w("grimble!! grimble!!") == 3.0 and g.weight("a grimble. the grimble.") == (6.0, 2)
    assert g.score("x") < g.score("a grimble") < g.score("a grimble. the grimble.")


def plain(words, g, reach=T.REACH):
    """The rules of the grammar word by word, without states."""
    read = [g.read(w) for w in words]
    said = quoted = False
    out = {}
    for i, (label, weight) in enumerate(read):
        quoted |= "(" in label
        if label[0] in "ih":
            near = lambda k, a, b: any(read[j][0][0] == k for j in range(max(0, a), min(len(read), b)))
            tags = T.THREAT * (label[0] == "h") + T.NEGATED * near("n", i - reach, i) + T.REPORTED * (said or quoted)
            person = near("t", i - reach, i) or near("t", i + 1, i + reach + 1)
            if person or label[0] == "i":
                out[tags + T.TARGET * person] = out.get(tags + T.TARGET * person, 0) + weight
        said |= label[0] == "r"
        quoted &= ")" not in label
    return out


VOCABULARY = ["you", "them", "grimble", "vequmo", "kill", "not", "said", "a", "thing", '"a', 'thing"', '"grimble"', '"kill', 'you"', "never"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(VOCABULARY), max_size=30))
def test_machine_reads_as_the_rules_say(words):
    g = T.Grammar({"^vequ": 4.0, "grimble": 3.0})
    assert g.clause(tuple(words)) == pytest.approx(plain(words, g))


def test_each_transducer_is_unambiguous_and_composition_keeps_its_paths():
    parts = T.grammar_parts()
    assert list(parts) == ["insult", "threat", "target", "negation", "report"]
    together = T.machine()
    assert 50 < len(together.arcs) < 5000
    # all marks of a clause are single: the number of paths is the number of words that may be marked
    assert sum(together.paths(["i", "o", "h", "t", "i"], [1.0] * 5).values()) == 3


def test_a_long_clause_takes_time_in_proportion():
    import time

    g = T.Grammar({"grimble": 3.0})
    took = []
    for n in (4_000, 16_000):
        text = "you grimble not " * n
        g.weight(text)
        begin = time.perf_counter()
        g.weight(text)
        took.append(time.perf_counter() - begin)
    assert took[1] < 8 * took[0]


def test_context_is_learned_and_decides(spark):
    """Negated and reported insults are harmless in these rows: without either transducer, held-out rows are judged wrong."""
    rows, labels = [], []
    for i in range(1600):
        kind = i % 4
        insult = ("idiot", "moron", "scum", "loser")[i % 16 // 4]
        clause = (f"you are now a {insult} here", f"you are never a {insult} here", f"it claimed that you are now a {insult} here", f"here is a {insult} machine")[kind]
        rows.append((i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(20)) + f". {clause}. " + " ".join(f"w{(i * 3 + j) % 50}" for j in range(20))))
        labels.append((i, 1, int(kind == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    g = T.train(docs, marks)
    held = [(t, y[2]) for (i, t), y in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = lambda g: sum((g.score(t) >= T.THRESHOLD) == bool(y) for t, y in held) / len(held)
    assert right(g) > 0.97
    for tag in (T.NEGATED, T.REPORTED):
        assert g.factors[tag] < g.factors[T.TARGET]
        without = T.Grammar(g.lexicon, g.slope, g.middle, g.factors | {tag: 1.0})
        assert right(without) < right(g) - 0.1
    without = T.Grammar(g.lexicon, g.slope, g.middle, g.factors | {T.TARGET: 1.0})
    assert right(without) < right(g) - 0.1


def test_learns_from_rows_that_are_not_held_out(spark):
    words = [f"w{i}" for i in range(50)]
    bad = lambda i: zlib.crc32(str(i).encode()) % 4
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        insult = "zorp" + words[i % 50] if bad(i) != 2 else "held" + words[i % 50]
        rows.append((i, " ".join([words[(i * 7 + j) % 50] for j in range(30)] + [insult if toxic else "fine"])))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    g = T.train(docs, marks)
    assert "^zorp" in g.lexicon and not any("held" in f for f in g.lexicon)
    again = T.train(docs.repartition(3), marks.repartition(2))
    assert again.lexicon == g.lexicon


def test_accuracy_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    labels = table(spark, sf, "labels")
    rows = T.op7_toxicity(spark, sf).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows)
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    assert right >= 0.97 * len(rows) and caught >= 0.85 * sum(r["toxic"] for r in rows)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 1), (77, 0, 1), (None, 0, 1), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    g = T.train(docs, labels)
    out = T.score(docs, g)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "clauses"]
    out = out.collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out) and {r["scored"] for r in out} == {7, None}
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert T.drop_toxic(no_documents(spark), labels).count() == 0
    assert T.train(docs, labels.limit(0)).lexicon == {}


def test_query_columns(spark):
    rows = T.op7_toxicity(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)


def test_any_white_space_parts_words(spark):
    g = T.Grammar({})
    text = "You are an idiot\nthey said nothing\nI will not hurt you, loser\nyou are trash"
    want = g.weight(text)
    assert want[1] == 3
    for space in "\t\r\x0b\x0c\xa0\u2003\u3000":
        assert g.weight(text.replace(" ", space)) == want and g.weight(text.replace(" ", f" {space}")) == want
    assert g.weight(text.replace("\n", "\r\n")) == want
    rows = spark.createDataFrame([(text.replace(" ", "\xa0").replace("\n", "\r\n"), 1)], "text string, toxic int")
    plain = spark.createDataFrame([(text, 1)], "text string, toxic int")
    assert sorted(map(tuple, T.features(rows).collect())) == sorted(map(tuple, T.features(plain).collect()))
