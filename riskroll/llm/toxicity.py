"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Lexicon: words and word stems that mark toxic documents among the labelled training rows (a bounded sample by hash
   order), with a short seed list.  Terms are dealt to ``LEXICON_VOTERS`` voters by family (first four letters).
2. All documents are voted on: lexicon voters, and patterns (density, several families, terms beside a word of address,
   no term at all).  There are at most 2**16 vote patterns, so their counts over the whole corpus have a proven bound.
3. A generative label model is fitted to the counts by expectation-maximisation: accuracies per voter, and correlations
   between voters within a class, by which correlated voters share their weight.
4. The posterior labels of all documents train a logistic regression on the documents' features (Spark ML).

Labels are learned only from rows whose ``crc32(doc_id as text) mod 3`` is not 1, at most ``SAMPLE_ROWS`` a class.

How it scales: texts are scanned three times (sample, votes, scores) and never shuffled; votes are summed map-side.

Defined results: null text is scored as the empty one; without labels only the seed list votes; repeated rows are
scored each; an empty table gives no rows; other columns are ignored or, in ``keep_clean``, untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_collect, pieces, table, text_of, whole_rows, written
from .quality import held_out, labelled_sample, sampled_texts

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
SAMPLE_ROWS = 10_000
MAX_TERMS = 5000
MIN_CONTEXTS = 5  # toxic documents that first use a term between different neighbours: copies of one count once
MAX_CLEAN_RATE = 0.002  # of a term's rate among toxic documents, its rate among clean ones
LEXICON_VOTERS = 12
PATTERN_VOTERS = ("dense", "several", "addressed", "clean")
VOTERS = LEXICON_VOTERS + len(PATTERN_VOTERS)
STEMS = (4, 5, 6, 7)
SEED = ("idiot", "moron", "stupid", "imbecile", "loser", "scum", "trash", "pathetic", "worthless", "disgusting",
        "connard", "salaud", "abruti", "arschloch", "dummkopf", "vollidiot", "cabrón", "gilipollas", "estúpido")
ADDRESS = frozenset("you your yours are tu toi vous du dich dein sie eres usted te".split())
_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """A word and its stems (marked by a hyphen)."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) >= k)]


def _term_counts(sample: DataFrame) -> DataFrame:
    """Documents of each class that hold a term, for the terms of toxic documents."""
    def run(batches):
        for batch in pieces(batches):
            counts: dict[str, list[int]] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                for t in {t for w in set(_WORD.findall(text.lower())) for t in terms(w)}:
                    counts.setdefault(t, [0, 0])[label] += 1
            yield pa.RecordBatch.from_pydict({
                "term": list(counts), "clean": pa.array([c[0] for c in counts.values()], pa.int64()),
                "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})

    counted = sample.select("label", "text").mapInArrow(run, "term string, clean long, toxic long")
    return counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _first_contexts(sample: DataFrame, wanted) -> DataFrame:
    """term, context: the neighbours of each wanted term where a document first uses it."""
    def run(batches):
        for batch in pieces(batches):
            out = set()
            for text in batch.column("text").to_pylist():
                words, seen = ["", *_WORD.findall(text.lower()), ""], set()
                for before, word, after in zip(words, words[1:], words[2:]):
                    for t in terms(word):
                        if t in wanted.value and t not in seen:
                            seen.add(t)
                            out.add((t, f"{before} {after}"))
            yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in out], pa.string()),
                                              "context": pa.array([c for _, c in out], pa.string())})

    return sample.select("text").mapInArrow(run, "term string, context string")


@dataclass
class Lexicon:
    """Term to voter; a document's votes and features."""

    voter: dict[str, int] = field(default_factory=dict)

    @classmethod
    def learn(cls, sample: DataFrame) -> Lexicon:
        n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        rare = F.col("clean") * n.get(1, 0) <= F.col("toxic") * MAX_CLEAN_RATE * n.get(0, 0)
        likely = (_term_counts(sample).filter(rare & (F.col("toxic") >= MIN_CONTEXTS))
                  .orderBy(F.desc("toxic"), "term").limit(8 * MAX_TERMS).collect())
        shared = sample.sparkSession.sparkContext.broadcast(frozenset(r.term for r in likely))
        contexts = _first_contexts(sample.filter("label = 1"), shared).distinct().groupBy("term").count()
        marks = (contexts.filter(F.col("count") >= MIN_CONTEXTS).orderBy(F.desc("count"), "term").limit(MAX_TERMS).collect())
        own = cls()
        families: dict[str, int] = {}
        for t in [*(r.term for r in marks), *SEED]:
            family = families.setdefault(t[:4], len(families))
            own.voter.setdefault(t, family % LEXICON_VOTERS)
        return own

    def read(self, text: str) -> tuple[int, list[float]]:
        """(votes as bits, features) of a text: a lexicon voter's feature is the log count of its terms."""
        words = _WORD.findall(text.lower())
        marked: dict[str, int] = {}
        for w in set(words):
            for t in reversed(terms(w)):
                if t in self.voter:
                    marked[w] = self.voter[t]
                    break
        counts = [0] * LEXICON_VOTERS
        beside = hits = 0
        if marked:
            for i, w in enumerate(words):
                if w in marked:
                    hits += 1
                    counts[marked[w]] += 1
                    beside += not ADDRESS.isdisjoint(words[max(0, i - 3):i + 4])
        share = hits / max(len(words), 1)
        bits = sum(1 << k for k, c in enumerate(counts) if c)
        flags = (share >= 0.005, sum(map(bool, counts)) >= 2, beside > 0, not hits)
        bits |= sum(1 << (LEXICON_VOTERS + k) for k, f in enumerate(flags) if f)
        x = [*np.log1p(counts), np.log1p(hits), min(share, 0.1) * 10, *map(float, flags)]
        return bits, [float(v) for v in x]


FEATURES = LEXICON_VOTERS + 2 + len(PATTERN_VOTERS)


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(VOTERS) & 1).astype(np.float64)


class LabelModel:
    """Voters' accuracies by class, and their correlations within a class, from counted vote patterns."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, rounds: int = 60):
        self.fires = _bits(masks)
        toxic_votes = self.fires[:, :VOTERS - 1].sum(axis=1)
        belief = np.where(toxic_votes > 0, 0.9, 0.02)
        self.weight = np.ones(VOTERS)
        for step in range(rounds):
            mass = np.stack([counts * (1 - belief), counts * belief])
            total = mass.sum(axis=1)
            self.prior = (total[1] + 1) / (total.sum() + 2)
            self.rate = (mass @ self.fires + 0.5) / (total[:, None] + 1)
            if step == 2:  # the correlations follow once the classes have taken shape
                self.weight = 1 / (1 + self._correlations(mass, total))
            belief = self._posterior(self.fires)
        self.belief = dict(zip(masks.tolist(), belief.tolist()))

    def _correlations(self, mass: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Per voter, the sum of its positive correlations with the others, in the class where it is larger."""
        summed = np.zeros(VOTERS)
        for c in (0, 1):
            mean = self.rate[c]
            both = (self.fires * mass[c][:, None]).T @ self.fires / max(total[c], 1)
            sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
            r = np.clip((both - np.outer(mean, mean)) / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(r, 0)
            summed = np.maximum(summed, r.sum(axis=1))
        return summed

    def _posterior(self, fires: np.ndarray) -> np.ndarray:
        yes = np.log(self.rate[1] / self.rate[0]) * self.weight
        no = np.log((1 - self.rate[1]) / (1 - self.rate[0])) * self.weight
        odds = np.log(self.prior / (1 - self.prior)) + fires @ yes + (1 - fires) @ no
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray  # the constant last

    def score(self, x: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.beta[:-1], x) + self.beta[-1], -30, 30))))


def _votes(docs: DataFrame, lexicon) -> DataFrame:
    """votes (bits) and features of each document, summed over equal ones."""
    def run(batches):
        for batch in pieces(batches):
            read = [lexicon.value.read(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in read], pa.int64()),
                                              pa.array([r[1] for r in read], pa.list_(pa.float64()))],
                                             names=["votes", "x"])

    return docs.select("text").mapInArrow(run, "votes long, x array<double>").groupBy("votes", "x").agg(
        F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Model:
    spark = docs.sparkSession
    train = ~held_out(F.col("doc_id"), FOLDS, HELD_OUT) if train is None else train
    lexicon = Lexicon.learn(sampled_texts(docs, labelled_sample(labels, "toxic", train, SAMPLE_ROWS, 3), SAMPLE_ROWS))
    votes = written(_votes(docs, spark.sparkContext.broadcast(lexicon)), "votes")
    patterns = bounded_collect(votes.groupBy("votes").agg(F.sum("n").alias("n")), 1 << VOTERS, "vote patterns")
    none = Model(lexicon, np.array([0.0] * FEATURES + [-30.0]))
    if not patterns:
        return none
    masks = np.array([r.votes for r in patterns], dtype=np.int64)
    if (masks == masks[0]).all() or not (masks & ((1 << LEXICON_VOTERS) - 1)).any():
        return none  # nobody votes toxic
    label_model = LabelModel(masks, np.array([r.n for r in patterns], dtype=np.float64))
    belief = spark.createDataFrame([(k, b) for k, b in label_model.belief.items()], "votes long, belief double")
    examples = (votes.join(F.broadcast(belief), "votes")  # at most 2**16 patterns
                .withColumn("label", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
                .select(array_to_vector("x").alias("features"), "label", (F.col("n") * F.when(
                    F.col("label") == 1, F.col("belief")).otherwise(1 - F.col("belief"))).alias("weight")))
    linear = LogisticRegression(weightCol="weight", regParam=1e-5, maxIter=60).fit(examples)
    return Model(lexicon, np.array([*linear.coefficients, linear.intercept]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the whole input row) and its score."""
    df = whole_rows(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            scores = [shared.value.score(shared.value.lexicon.read(t or "")[1]) for t in text_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    return df.mapInArrow(run, df.select("row", F.lit(0.0).alias("score")).schema)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored toxic."""
    return score(docs, fit(docs, labels)).filter(F.col("score") < THRESHOLD).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: a toxicity score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select(
        "row.doc_id", F.coalesce(held_out(F.col("row.doc_id"), FOLDS, HELD_OUT), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
