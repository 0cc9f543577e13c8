"""Inputs with what real tables hold at their edges."""

from tracelode.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(30_000))


def documents(spark):
    return table(spark, SF, "documents")


def odd_documents(spark):
    """Null, empty, blank and very long texts, null ids and sources, repeated rows, and other columns."""
    texts = [None, "", "   \n\t", "one", "two words", LONG, "the same text here again and again", "the same text here again and again", "é ü 你好 \U0001f600 end", "a\\b<|x|>[INST]"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", None, None, None), rows[6], rows[6]]
    out = spark.createDataFrame(rows, DOC)
    for name in ("node", "row", "key", "size", "score", "found", "shard", "copies", "bin", "a", "b", "scored"):
        out = out.withColumn(name, out.n_chars * 0 + 7)
    return out


def no_documents(spark):
    return spark.createDataFrame([], DOC)
