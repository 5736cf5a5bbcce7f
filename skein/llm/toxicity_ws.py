"""Toxicity by weak supervision.

Voters: lexicon voters, whose words are those most tied to the label among labelled training rows; density voters, for beginnings of words; and pattern voters (shouting,
runs of marks, address in the second person, noise between letters, repetition and others). Each votes 1, 0 or abstains.
Generative label model: given the class, a voter casts its votes at rates of its own (its accuracy and its readiness to vote), and voters whose votes agree beyond what the class
explains share their weight. Rates come from expectation maximisation over the vote patterns of ALL documents, started at and tied to the rates among labelled
training rows; the correlations that remain are then estimated, the weights follow, and the rates are estimated anew under them, in turn.
The posterior of each document then labels the training rows of a logistic regression over hashed words, which scores every text.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, texts, written

#: Labelled rows from which lexicons and starting rates are learned, and documents that train the classifier.
LABELLED_ROWS = 10_000
TRAIN_DOCS = 10_000
LEXICON_VOTERS, DENSITY_VOTERS = 10, 2
#: A word is in a lexicon if, discounted for few documents, it is this many times likelier in texts with the label.
LEAST_ODDS = 60
#: Lengths of the beginnings of words that count as terms of their own.
STARTS = (4, 5, 7)
MIN_DENSITY = 0.008
MIN_WORD_DOCS = 5
FEATURES = 1 << 17
#: Rounds of expectation maximisation under one set of weights, and turns of estimating weights.
ROUNDS, TURNS = 8, 3
#: Correlation from which votes count as saying the same.
LINKED = 0.2
#: No unbounded repeat of a group: the JVM would recurse for each turn and overflow its stack on long texts.
PATTERNS = {
    "shouting": r"(?:\b\p{Lu}{2,}\b[^\p{L}]*){4}",
    "marks": r"[!?]{2,}",
    "address": r"(?i)\b(?:you(?:'re| are)?|du bist|tu es|eres)\b",
    "noise": r"\p{L}(?:[#$%&*]{2,})",
    "repetition": r"\b(\p{L}++)(?: \1\b){3}",
    "stretched": r"(\p{L})\1{3}",
    "long capitals": r"\b\p{Lu}{5,}+\b",
    "digits in words": r"\p{L}[0134@$]\p{L}",
    "last mark": r"!\s{0,3}$",
}


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def runs(text: Column) -> Column:
    """The lower-cased letter runs of a text, repeats included."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def _start(n: int):
    return lambda w: F.when(F.length(w) >= n, F.substring(w, 1, n)).otherwise("")


def starts(every: Column) -> Column:
    """Beginnings of words of the lengths in STARTS, repeats included: inflected and compound forms share evidence."""
    return F.array_remove(F.flatten(F.array(*(F.transform(every, _start(n)) for n in STARTS))), "")


class Lexicons:
    """words: lists of whole words whose presence speaks for the label. starts: (pattern, least density) of beginnings that are frequent in texts with the label."""

    def __init__(self, words: list[list[str]], starts: list[tuple[str, float]]):
        self.words, self.starts = words, starts
        self.voters = len(words) + len(starts) + 1 + len(PATTERNS)


def votes(text: Column, every: Column, found: Column, lex: Lexicons) -> tuple[Column, Column]:
    """(known, code): the lexicons' words among found, which the row must carry as a column known, and one number, base 3, of all voters' votes: 0 abstains, 1 votes clean, 2 votes toxic. every: the text's letter runs; found: the distinct ones.

    A word voter votes toxic if one of its words occurs, a density voter if its beginnings are frequent enough, else they abstain; one more votes
    clean if no word of any lexicon occurs. A pattern voter votes toxic where its pattern occurs; the model may learn that this means nothing.
    """
    words = [w for x in lex.words for w in x]
    known = F.array_intersect(found, F.array(*map(F.lit, words))) if words else F.array().cast("array<string>")
    low = F.lower(text)
    hits = [F.when(F.arrays_overlap("known", F.array(*map(F.lit, x))), 2).otherwise(0) for x in lex.words]
    hits += [F.when(F.regexp_count(low, F.lit(p)) >= least * (F.size(every) + 10), 2).otherwise(0) for p, least in lex.starts]
    hits.append(F.when(F.size("known") > 0, 0).otherwise(1) if words else F.lit(0))
    hits += [F.when(text.rlike(p), 2).otherwise(0) for p in PATTERNS.values()]
    code = F.lit(0).cast("long")
    for k, h in enumerate(hits):
        code = code + h * F.lit(3**k).cast("long")
    return known, code


def _unpack(codes: np.ndarray, voters: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(voters, dtype=np.int64) % 3


class LabelModel:
    """Vote rates by class, (voter, class, vote), the correlation of votes that the class does not explain, and the voters' weights."""

    def __init__(self, gold: np.ndarray, voters: int):
        """gold: (code, class, n) of labelled training rows; rates start there."""
        self.tied, self.klass = np.zeros((voters, 2, 3)), np.array([1.0, 1.0])
        for row, (_, y, n) in zip(_unpack(gold[:, 0], voters) if len(gold) else (), gold, strict=True):
            self.tied[np.arange(voters), y, row] += n
            self.klass[y] += n
        self.prior = np.log(self.klass / self.klass.sum())
        self.rates = (self.tied + 0.5) / (self.tied + 0.5).sum(2, keepdims=True)
        self.weight, self.correlation = np.ones(voters), np.eye(voters)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        ratio = np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])
        score = self.prior[1] - self.prior[0] + (self.weight * ratio[np.arange(v.shape[1]), v]).sum(1)
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def sums(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the next estimate needs of these vote patterns: expected votes (voter, class, vote), and sums of products of toxic votes' residuals."""
        voters = len(self.weight)
        v = _unpack(codes, voters)
        p, n = self.posterior(v), counts.astype(float)
        soft = np.zeros((voters, 2, 3))
        for s in range(3):
            at = (v == s) * n[:, None]
            soft[:, 1, s], soft[:, 0, s] = p @ at, (1 - p) @ at
        res = (v == 2) - (p[:, None] * self.rates[None, :, 1, 2] + (1 - p[:, None]) * self.rates[None, :, 0, 2])
        return soft, (res * n[:, None]).T @ res

    def maximise(self, soft: np.ndarray) -> None:
        """Rates from expected votes; unlabelled rows refine them but weigh no more than the labelled ones."""
        share = np.minimum(1, self.klass[None, :, None] / np.maximum(soft.sum(2, keepdims=True), 1e-9))
        total = self.tied + share * soft + 0.5
        self.rates = total / total.sum(2, keepdims=True)

    def reweigh(self, products: np.ndarray) -> float:
        """Weights from the residuals' correlations: votes that say the same count once among them. Returns the greatest change."""
        scale = np.sqrt(np.maximum(np.diag(products), 1e-12))
        self.correlation = products / np.outer(scale, scale)
        linked = np.where(self.correlation > LINKED, self.correlation, 0)  # votes against each other explain each other away
        np.fill_diagonal(linked, 1)
        was, self.weight = self.weight, 1 / linked.sum(1)
        return float(np.abs(self.weight - was).max())

    def fit(self, gather) -> LabelModel:
        """gather(model) gives the sums over all documents' vote patterns."""
        for _ in range(TURNS):
            for _ in range(ROUNDS):
                soft, _ = gather(self)
                was = self.rates
                self.maximise(soft)
                if np.abs(self.rates - was).max() < 1e-3:
                    break
            if self.reweigh(gather(self)[1]) < 0.02:
                break
        return self

    def column(self, code: Column) -> Column:
        """The posterior as an expression over a packed vote column."""
        ratio = np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])
        score = F.lit(float(self.prior[1] - self.prior[0]))
        for k in range(len(self.weight)):
            score = score + F.element_at(F.array(*(F.lit(float(self.weight[k] * x)) for x in ratio[k])), _vote(code, k) + 1)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def _vote(code: Column, k: int) -> Column:
    # exact in doubles: a code is below 3 to the 30th
    return (F.floor(code / F.lit(3**k)) % 3).cast("int")


def _gather(patterns: DataFrame):
    """The label model's sums over a table of vote patterns (code, n), added up in the tasks that read it; what reaches the driver depends on the number of voters alone."""

    def gather(model: LabelModel) -> tuple[np.ndarray, np.ndarray]:
        voters = len(model.weight)

        def run(batches):
            for b in batches:
                soft, products = model.sums(b.column(0).to_numpy(), b.column(1).to_numpy())
                x = np.concatenate((soft.ravel(), products.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x)], ["k", "x"])

        rows = patterns.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        x = np.zeros(voters * 6 + voters * voters)
        for r in rows:
            x[r["k"]] = r["x"]
        return x[: voters * 6].reshape(voters, 2, 3), x[voters * 6 :].reshape(voters, voters)

    return gather


def _lexicons(labelled: DataFrame) -> Lexicons:
    """From labelled rows (every, found, toxic), of which there is a bounded number: words by smoothed log odds of presence, beginnings by the ratio of their mean densities; all that pass are dealt in turn to the voters."""
    n = {int(r["toxic"]): r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos:
        return Lexicons([], [])
    per = labelled.select(F.explode("found").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
    # the evidence is discounted for rare words
    top = per.where(F.col("p") >= MIN_WORD_DOCS).withColumn("s", odds - 1.5 / F.sqrt(F.col("p"))).where(F.col("s") > math.log(LEAST_ODDS))
    top = [r["word"] for r in top.orderBy(F.desc("s"), "word").collect()]
    each = labelled.select("toxic", "every")
    each = each.withColumn("share", 1.0 / (F.size("every") + 10))
    # a beginning counts once for each word of a text and start, by the text's share
    dense = each.select("toxic", "share", F.explode(starts(F.col("every"))).alias("start")).groupBy("start").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("share"))).alias("p"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("share"))), F.lit(0.0)).alias("n"), F.sum("toxic").alias("hits")
    )
    dense = dense.where(F.col("hits") >= 4 * MIN_WORD_DOCS).select("start", (F.col("p") / pos).alias("p"), ((F.col("n") + 0.5 / 500) / max(1, neg)).alias("n"))
    dense = dense.where("p >= 4 * n AND p > 1e-4").orderBy(F.desc(F.col("p") * F.log(F.col("p") / F.col("n"))), "start").collect()
    rows = [r for r in dense if not any(r["start"] != o["start"] and r["start"].startswith(o["start"]) for o in dense)]
    groups = [x for k in range(DENSITY_VOTERS) if (x := rows[k::DENSITY_VOTERS])]
    # the class of first letters rules out most places before the look behind
    firsts = lambda x: "".join(sorted({r["start"][0] for r in x}))
    least = MIN_DENSITY
    patterns = [(f"(?=[{firsts(x)}])(?<!\\p{{L}})(?:" + "|".join(sorted(r["start"] for r in x)) + ")", least) for x in groups]
    return Lexicons([x for k in range(LEXICON_VOTERS) if (x := top[k::LEXICON_VOTERS])], patterns)


def terms(found: Column, code: Column, voters: int) -> Column:
    """What the classifier sees: a text's words, and a term for each voter that voted, by its vote."""
    said = [F.when(_vote(code, k) > 0, F.concat(F.lit(f"#{k}="), _vote(code, k).cast("string"))) for k in range(voters)]
    return F.concat(found, F.array_compact(F.array(*said)))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           labelled_rows: int = LABELLED_ROWS, train_docs: int = TRAIN_DOCS, row_col: str | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, and row_col of docs if one is named.

    Labels are used only where the id is not held out; a label that is null, or an id labelled twice with
    different labels, is left out. Null ids have no label and are never held out. Null and empty texts are scored by the model like any other (by its intercept). With no usable positive
    label every score is 0. Repeated rows get equal scores; an empty table gives an empty result.
    """
    # imported here, since tasks load this module for the label model's sums and need not hold the library of learners
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    kept = [row_col] if row_col else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *kept)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    # a bounded number of labelled rows, first by a hash of the id
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    share = max(1, docs.count() // max(1, train_docs))
    sampled = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(share)) == 0
    labelled = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").withColumn("every", runs(F.col("text")))  # at most labelled_rows ids
    labelled = written(labelled.withColumn("found", F.array_distinct("every")), "toxic-gold")
    lexicons = _lexicons(labelled)
    if not lexicons.words and not lexicons.starts:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *kept)
    voters = lexicons.voters
    known, code = votes(F.col("text"), F.col("every"), F.col("found"), lexicons)
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")

    def seen(rows: DataFrame, *keep: str) -> DataFrame:
        rows = rows.withColumn("known", known).select(*keep, "found", code.alias("code"))  # computed once, used for each voter
        return hashing.transform(rows.withColumn("terms", terms(F.col("found"), F.col("code"), voters))).select(*keep, "code", "features")

    # every text is read and split once; counting, training and scoring read what is written here
    each = docs.withColumn("every", runs(F.col("text"))).withColumn("found", F.array_distinct("every"))
    each = written(seen(each, "doc_id", *kept), "toxic-votes")
    gold = written(seen(labelled, "toxic"), "toxic-gold-votes")
    patterns = written(each.groupBy("code").agg(F.count("*").alias("n")), "toxic-patterns")
    said = gold.groupBy("code", "toxic").agg(F.count("*").alias("n")).collect()  # at most labelled_rows
    model = LabelModel(np.array([[r["code"], r["toxic"], r["n"]] for r in said]), voters).fit(_gather(patterns))
    train = each.where(sampled & ~held_out(F.col("doc_id"))).select("features", "code").unionByName(gold.select("features", "code"))
    p = model.column(F.col("code"))
    pair = F.array(*(F.struct(F.lit(y).alias("label"), w.alias("weight")) for y, w in ((1.0, F.col("p")), (0.0, 1 - F.col("p")))))
    train = written(train.select("features", p.alias("p")).select("features", F.inline(pair)).where("weight > 0.001"), "toxic-train")
    fitted = LogisticRegression(weightCol="weight", regParam=2e-4, maxIter=40, standardization=False, aggregationDepth=2).fit(train)
    discard(labelled, gold, patterns, train)
    scored = fitted.transform(each).select("doc_id", held, vector_to_array("probability")[1].alias("score"), *kept)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *kept)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs without the rows that are predicted toxic; columns and other rows are as they are.

    Rows are numbered once, in a written copy, and go by their own texts, so null and repeated ids need no care. Rows with equal texts fare alike, null and empty
    texts fare like a text without words, and an empty table gives an empty result.
    """
    number = f"row_{uuid.uuid4().hex}"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "toxic-rows")
    # written first: a filter pushed below the model would compute all votes anew for each term
    toxic = written(scores(rows, labels, id_col, text_col, row_col=number, **more), "toxic-scores").where("predicted = 1").select(number)
    return rows.join(toxic.hint("merge"), number, "left_anti").select(*(f"`{c}`" for c in docs.columns))
