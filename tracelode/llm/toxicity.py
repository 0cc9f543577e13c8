"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause (up to ``.``, ``!``, ``?``, ``;``, ``:`` or a line break) are read as classes, and five
transducers over these classes are composed, state by state and arc by arc, into one machine:

* insult: marks one word of the lexicon, with its weight;
* threat: marks one verb of harm instead, with a weight of its own; a path marks exactly one word;
* target: a marked word with a person addressed or named within ``REACH`` words before or after is tagged; a
  marked verb of harm without one has no path. What comes after is guessed and then verified by states;
* negation: a marked word with a word of denial within ``REACH`` words before it is tagged;
* reported speech: a marked word behind a verb of saying, or between quotes, is tagged.

The weight of a clause is the sum over the paths that end in a final state, each the product of the marked word's weight and
of the weights of its tags. The machine is run once over a clause with all paths side by side, and the states are
few, so a text takes time in proportion to its length. A clause without a marked word has weight 0. A document's
weight is the sum over its clauses, each different one once, and its score a logistic function of its logarithm.

What the lexicon holds is learned: whole words and word beginnings of four to six letters that stand
in toxic documents with high odds, and too often for chance (log likelihood ratio), with their log
odds as weights. What counts is different contexts, so copies of one text are one witness. The weights of the
tags and of verbs of harm, and the parameters of the score, are fitted to the same rows, from those given here where the rows don't tell. It is
learned from labelled rows that are not held out (crc32 of doc_id as text, mod 4, is 2 for held-out
rows), from ``TRAIN`` rows of either label at most, those with the smallest hashes of doc_id. Scores
see the text alone.

Defined results: a null or empty text has weight 0 and so the lowest score; repeated rows are scored
alike, and equal weights have equal scores; other columns are kept, but for those named score or clauses, which the results replace; labels that are null, or whose doc_id has no document, count for
nothing; without labelled rows only the words given here are the lexicon; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, table

THRESHOLD = 0.3
TRAIN = 3_000  # labelled rows of either label that are learned from, at most
ODDS = 8.0  # of a feature between toxic and other documents, at least
EVIDENCE = 10.0  # log likelihood ratio of a feature against chance, at least
ENDINGS = 3  # different words that a beginning stands for, at least
STARTS = (4, 5, 6)
REACH = 4

#: Word classes of the grammar. Learned words add to "insult" only.
CLASSES = {
    "insult": "idiot moron scum loser stupid pathetic worthless disgusting trash imbecile",
    "threat": "kill hurt murder destroy beat burn shoot stab punish",
    "target": "you your yours yourself he she him her they them their these those people everyone",
    "negation": "not no never neither nor without isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine ne pas jamais no nunca",
    "report": "said says say wrote writes quoted quotes called calls reported reports claimed claims allegedly according",
}
SEED_WEIGHT = 2.0
#: The parts of a path's weight, by the bit of its tag, before they are fitted.
THREAT, TARGET, NEGATED, REPORTED = 1, 2, 4, 8
GIVEN = {THREAT: 3.0, TARGET: 1.25, NEGATED: 0.4, REPORTED: 0.6}
TRUST = 4.0  # in what is given: precision of the logarithms
OPENING, CLOSING = "\"“„«", "\"”“»"
#: White space other than the space and the line feed; all of it parts words like a space.
_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDS, _STRIP = ".!?;:\n", ".,!?;:\"'()[]{}<>«»“”„*|%#$&"


class Transducer:
    """Arcs by state and input label: (output label, tags, next state). A word is marked by an output in capitals."""

    def __init__(self, start) -> None:
        self.start, self.arcs, self.final = start, {}, set()

    def arc(self, state, label: str, out: str, to, tags: int = 0) -> None:
        self.arcs.setdefault(state, {}).setdefault(label, []).append((out, tags, to))


#: Labels: the class of a word, and whether quotes open before it or close behind it.
KINDS = {"insult": "i", "threat": "h", "target": "t", "negation": "n", "report": "r"}
_QUOTES = ("", "(", ")", "()")
_PLAIN = [k + q for k in "ohitnr" for q in _QUOTES]
_MARKED = [k + q for k in "IH" for q in _QUOTES]


def marker(kind: str, other: list[str]) -> Transducer:
    """Marks at most one word of a kind. ``other``: marks that may pass, instead of its own."""
    t = Transducer(0)
    for label in _PLAIN:
        t.arc(0, label, label, 0)
        t.arc(1, label, label, 1)
        if label[0] == kind:
            t.arc(0, label, kind.upper() + label[1:], 1, THREAT if kind == "h" else 0)
    for label in other:
        t.arc(0, label, label, 1)
    t.final = {0, 1} if not other else {1}
    return t


def target(reach: int = REACH) -> Transducer:
    """States before the mark: words since a target, up to one more than ``reach``. After it: that one must come within
    so many words, that none may come within so many, or anything."""
    t, far = Transducer(reach + 1), reach + 1
    for d in range(1, far + 1):
        for label in _PLAIN:
            t.arc(d, label, label, 1 if label[0] == "t" else min(far, d + 1))
        for label in _MARKED:
            if d <= reach:
                t.arc(d, label, label, "any", TARGET)
                continue
            t.arc(d, label, label, ("some", reach), TARGET)
            if label[0] == "I":
                t.arc(d, label, label, ("none", reach))
    for k in range(1, reach + 1):
        for label in _PLAIN:
            if label[0] == "t":
                t.arc(("some", k), label, label, "any")
                continue
            if k > 1:
                t.arc(("some", k), label, label, ("some", k - 1))
            t.arc(("none", k), label, label, ("none", k - 1) if k > 1 else "any")
    for label in _PLAIN:
        t.arc("any", label, label, "any")
    t.final = {"any"} | {("none", k) for k in range(1, reach + 1)}
    return t


def negation(reach: int = REACH) -> Transducer:
    """States before the mark: words since a denial, up to one more than ``reach``; one state after it."""
    t, far = Transducer(reach + 1), reach + 1
    for d in range(1, far + 1):
        for label in _PLAIN:
            t.arc(d, label, label, 1 if label[0] == "n" else min(far, d + 1))
        for label in _MARKED:
            t.arc(d, label, label, "any", NEGATED if d <= reach else 0)
    for label in _PLAIN:
        t.arc("any", label, label, "any")
    t.final = {"any"}
    return t


def report() -> Transducer:
    """States before the mark: whether a verb of saying came, and whether quotes are open; one state after it."""
    t = Transducer((False, False))
    for said in (False, True):
        for quoted in (False, True):
            for label in _PLAIN + _MARKED:
                within = quoted or "(" in label
                if label in _MARKED:
                    t.arc((said, quoted), label, label, "any", REPORTED if said or within else 0)
                else:
                    t.arc((said, quoted), label, label, (said or label[0] == "r", within and ")" not in label))
    for label in _PLAIN:
        t.arc("any", label, label, "any")
    t.final = {"any"}
    return t


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``b`` makes of the output of ``a``: pairs of states that can be reached and from which a final one can."""
    out = Transducer((a.start, b.start))
    todo, seen, back = [out.start], {out.start}, {}
    while todo:
        here = todo.pop()
        for label, first in a.arcs.get(here[0], {}).items():
            for middle, tags, to_a in first:
                for end, more, to_b in b.arcs.get(here[1], {}).get(middle, ()):
                    to = (to_a, to_b)
                    out.arc(here, label, end, to, tags | more)
                    back.setdefault(to, set()).add(here)
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
    out.final = {s for s in seen if s[0] in a.final and s[1] in b.final}
    live, todo = set(out.final), list(out.final)
    while todo:
        for s in back.get(todo.pop(), ()):
            if s not in live:
                live.add(s)
                todo.append(s)
    kept = {s: {i: [x for x in own if x[2] in live] for i, own in arcs.items()} for s, arcs in out.arcs.items() if s in live}
    out.arcs = {s: {i: own for i, own in arcs.items() if own} for s, arcs in kept.items()}
    return out


def grammar_parts() -> dict[str, Transducer]:
    """The five transducers, in the order of their composition."""
    return {"insult": marker("i", []), "threat": marker("h", _MARKED[:4]), "target": target(), "negation": negation(), "report": report()}


class Machine:
    """A composed transducer with its states numbered. ``paths`` runs all paths over the labels of a clause at once."""

    def __init__(self, composed: Transducer) -> None:
        number = {s: i for i, s in enumerate(sorted(composed.arcs.keys() | composed.final, key=repr))}
        own = lambda arcs: [(number[to], tags, out[0] in "IH") for out, tags, to in arcs]
        self.start = number[composed.start]
        self.arcs = [{}] * len(number)
        for s, by in composed.arcs.items():
            self.arcs[number[s]] = {label: own(arcs) for label, arcs in by.items()}
        self.final = {number[s] for s in composed.final}
        # final states that nothing leads out of and that tag nothing: a path there is done
        self.done = {i for i in self.final if self.arcs[i].keys() == set(_PLAIN) and all(arcs == [(i, 0, False)] for arcs in self.arcs[i].values())}

    def paths(self, labels: list[str], weights: list[float]) -> dict[int, float]:
        """The sum of the marked words' weights by the tags of their paths."""
        out: dict[int, float] = {}
        active = {(self.start, 0): 1.0}
        for label, weight in zip(labels, weights, strict=True):
            new: dict[tuple[int, int], float] = {}
            for (state, tags), w in active.items():
                for to, more, mark in self.arcs[state].get(label, ()):
                    own, all_ = w * weight if mark else w, tags | more
                    if to in self.done:
                        out[all_] = out.get(all_, 0.0) + own
                    else:
                        new[to, all_] = new.get((to, all_), 0.0) + own
            active = new
        for (state, tags), w in active.items():
            if state in self.final:
                out[tags] = out.get(tags, 0.0) + w
        return out


_machine: list[Machine] = []


def machine() -> Machine:
    """The composition of the five, made once in a process."""
    if not _machine:
        first, *rest = grammar_parts().values()
        for part in rest:
            first = compose(first, part)
        _machine.append(Machine(first))
    return _machine[0]


class Grammar:
    """The machine and its weights. ``lexicon``: weight of each insulting word or ``^`` beginning. ``factors``: weight of
    each tag. The score is logistic in the logarithm of the weight, one half at ``middle``."""

    def __init__(self, lexicon: dict[str, float], slope: float = 3.0, middle: float = 2.5, factors: dict[int, float] | None = None) -> None:
        self.lexicon, self.slope, self.middle, self.factors = lexicon, slope, middle, dict(factors or GIVEN)
        self.fixed = {w: KINDS[k] for k in ("target", "negation", "report", "threat") for w in CLASSES[k].split()}
        self.seeds = dict.fromkeys(CLASSES["insult"].split(), SEED_WEIGHT)
        self.known: dict[str, tuple[str, float]] = {}

    def read(self, token: str) -> tuple[str, float]:
        """Label and weight of a token; the weight is 0 for one that can't be marked."""
        word = token.strip(_STRIP)
        kind, weight = self.fixed.get(word), 0.0
        if kind is None:
            weight = max(self.lexicon.get(word, 0.0), self.seeds.get(word, 0.0), *[self.lexicon.get(f"^{word[:n]}", 0.0) for n in STARTS if len(word) > n], 0.0)
            kind = "i" if weight else "o"
        elif kind == "h":
            weight = 1.0
        behind = token.rstrip(".,!?;:")
        return kind + ("(" if token[:1] in OPENING and token else "") + (")" if behind[-1:] in CLOSING and len(behind) > 1 else ""), weight

    def parts(self, text: str | None) -> tuple[dict[int, float], int]:
        """Sums of the weights of the marked words of a text's different clauses by their tags, and the number of matched clauses."""
        text = (text or "").lower()
        for space in _SPACES:
            text = text.replace(space, " ")
        words = text.replace("\n", " \n ").split(" ")
        known = self.known
        if len(known) > 150_000:
            known.clear()
        hits = []
        for i, token in enumerate(words):
            try:
                got = known[token]
            except KeyError:
                got = known[token] = self.read(token)
            if got[1]:
                hits.append(i)
        total: dict[int, float] = {}
        clauses, done, seen = 0, -1, set()
        for hit in hits:
            if hit <= done:
                continue
            start = end = hit
            while start > done + 1 and (words[start - 1] == "" or words[start - 1][-1:] not in _ENDS):
                start -= 1
            while end < len(words) - 1 and (words[end] == "" or words[end][-1:] not in _ENDS):
                end += 1
            done = end
            clause = tuple(w for w in words[start : end + 1] if w.strip())
            if clause in seen:
                continue
            seen.add(clause)
            found = self.clause(clause)
            clauses += bool(found)
            for tags, w in found.items():
                total[tags] = total.get(tags, 0.0) + w
        return total, clauses

    def clause(self, words: tuple[str, ...]) -> dict[int, float]:
        """Sums of the weights of a clause's marked words by their tags."""
        read = [self.known.get(w) or self.read(w) for w in words]
        return machine().paths([label for label, _ in read], [weight for _, weight in read])

    def sum(self, parts: dict[int, float]) -> float:
        return sum(w * math.prod(f for tag, f in self.factors.items() if tags & tag) for tags, w in sorted(parts.items()))

    def weight(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of the matched clauses, and their number."""
        parts, clauses = self.parts(text)
        return self.sum(parts), clauses

    def score(self, text: str | None) -> float:
        return self.squash(self.weight(text)[0])

    def squash(self, weight: float) -> float:
        z = self.slope * (math.log1p(weight) - math.log1p(self.middle))
        return 1 / (1 + math.exp(-z))

    def fit(self, parts: list[dict[int, float]], toxic: list[int], counts: dict[int, float]) -> None:
        """Slope, middle and the weights of the tags, by Newton's method on the penalised likelihood; the logarithms of the
        weights of tags are held near what is given. ``counts``: how many rows a row of each label stands for."""
        if len(set(toxic)) < 2:
            return
        kinds = sorted({t for p in parts for t in p})
        sums = np.array([[p.get(t, 0.0) for t in kinds] for p in parts]).reshape(len(parts), len(kinds))
        has = np.array([[bool(t & tag) for tag in GIVEN] for t in kinds], float).reshape(len(kinds), len(GIVEN))
        y, prior = np.array(toxic, float), np.array([-2.0, 1.0, *[math.log(f) for f in GIVEN.values()]])
        firm = np.array([0.05, 0.05, *[TRUST] * len(GIVEN)])
        each, theta = np.where(y == 1, counts[1], counts[0]), prior.copy()

        def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
            own = sums * np.exp(has @ theta[2:])
            w = own.sum(axis=1)
            z = theta[0] + theta[1] * np.log1p(w)
            design = np.hstack([np.ones((len(y), 1)), np.log1p(w)[:, None], theta[1] * (own @ has) / (1 + w)[:, None]])
            loss = float((each * (np.logaddexp(0, z) - y * z)).sum() + (firm * (theta - prior) ** 2).sum() / 2)
            return loss, z, design, w

        loss, z, design, _ = at(theta)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            grad = design.T @ (each * (y - p)) - firm * (theta - prior)
            step = np.linalg.solve((design * (each * p * (1 - p))[:, None]).T @ design + np.diag(firm), grad)
            scale = 1.0
            while scale > 1e-6 and at(theta + scale * step)[0] > loss:
                scale /= 2
            if scale <= 1e-6 or np.abs(scale * step).max() < 1e-9:
                break
            theta = theta + scale * step
            loss, z, design, _ = at(theta)
        # with too few rows to tell, a text without a matched clause might seem toxic: what was given then holds
        if theta[1] > 0.05 and theta[0] < -1.5:
            self.slope, self.middle = float(theta[1]), float(math.expm1(min(50.0, -theta[0] / theta[1])))
            self.factors = {tag: float(math.exp(x)) for tag, x in zip(GIVEN, theta[2:], strict=True)}


def split_of(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4; 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def features(rows: DataFrame) -> DataFrame:
    """feature, p, n, words: words of ``rows`` (text, toxic), and beginnings, marked by ``^``; in how many contexts of
    toxic and of other texts they stand; and how many words of toxic texts are behind it. A context is the words
    before and after, so what copies of a text repeat counts once."""
    words = F.split(F.translate(F.lower(F.coalesce("text", F.lit(""))), _SPACES, " " * len(_SPACES)), r"\s+")
    at = lambda w, i: F.coalesce(F.get(w, i), F.lit(""))
    rows = rows.withColumn("w", words)
    pairs = F.transform("w", lambda x, i: F.struct(F.btrim(x, F.lit(_STRIP)).alias("word"), F.xxhash64(at(F.col("w"), i - 1), at(F.col("w"), i + 1)).alias("context")))
    pairs = rows.select("toxic", F.explode(pairs).alias("x")).select("toxic", "x.*").filter("word <> ''").distinct()
    own = pairs.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    starts = F.filter(F.array(*[F.when(F.length("word") > k, F.concat(F.lit("^"), F.substring("word", 1, k))) for k in STARTS]), lambda x: x.isNotNull())
    starts = own.select("p", "n", F.explode(starts).alias("feature")).groupBy("feature")
    starts = starts.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum((F.col("p") > 0).cast("int")).alias("words"))
    return own.select(F.col("word").alias("feature"), "p", "n", F.lit(1).alias("words")).unionByName(starts)


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar learned from the labelled rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(split_of() != 2).withColumn("hash", F.xxhash64("doc_id"))
    every = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    pick = lambda y: marked.filter(F.col("toxic") == y).orderBy("hash", "doc_id").limit(TRAIN)
    marked = pick(0).union(pick(1)).select("doc_id", "toxic")  # 2 TRAIN rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "toxic")
    bad, good = min(TRAIN, every.get(1, 0)), min(TRAIN, every.get(0, 0))
    if not bad or not good:
        return Grammar({})
    found = features(rows)
    odds = ((F.col("p") + 0.5) / (bad + 1)) / ((F.col("n") + 0.5) / (good + 1))
    share = bad / (bad + good)
    part = lambda c, at: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (F.col("p") + F.col("n")) / at)).otherwise(0.0)
    found = found.withColumns({"odds": odds, "evidence": part("p", share) + part("n", 1 - share)})
    chosen = found.filter((F.col("odds") >= ODDS) & (F.col("evidence") >= EVIDENCE)).filter(F.col("words") >= F.when(F.col("feature").startswith("^"), ENDINGS).otherwise(1))
    chosen = chosen.select("feature", "odds").collect()  # words of the training rows, which are bounded
    grammar = Grammar({r["feature"]: min(6.0, math.log(r["odds"])) for r in chosen})
    lexicon = grammar.lexicon

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Grammar(lexicon)
        for batch in batches:
            yield pd.DataFrame({"parts": [json.dumps(own.parts(t)[0], sort_keys=True) for t in batch["text"]], "toxic": batch["toxic"]})

    found = rows.mapInPandas(weighed, "parts string, toxic int").groupBy("parts", "toxic").count().collect()  # a few numbers a training row, at most
    found = sorted((r["parts"], r["toxic"], r["count"]) for r in found for _ in range(r["count"]))
    grammar.fit([{int(k): v for k, v in json.loads(p).items()} for p, _, _ in found], [y for _, y, _ in found], {0: every[0] / good, 1: every[1] / bad})
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` with ``score`` and ``clauses`` (matched ones)."""
    small_batches(docs.sparkSession)
    made = grammar.lexicon, grammar.slope, grammar.middle, grammar.factors

    @F.pandas_udf("struct<score double, clauses int>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        own = scored.grammar = getattr(scored, "grammar", None) or Grammar(*made)
        got = [own.weight(t) for t in texts]
        return pd.DataFrame({"score": [own.squash(w) for w, _ in got], "clauses": np.array([c for _, c in got], np.int32)})

    name = free_name(docs, "scored")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "clauses")]
    return docs.withColumn(name, scored(F.col("text"))).select(*kept, f"{name}.score", f"{name}.clauses")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``."""
    grammar = train(docs, labels)
    plain = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score(plain, grammar).filter(F.col("score") < threshold).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, clauses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (split_of() == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses")
