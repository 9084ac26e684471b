"""Records of two sources without a common key: a label model over matching functions.

Matching functions vote on each candidate pair: for one business, against it, or not at all. How often each pattern of votes
occurs is counted over all candidates; the counts, at most 3 to the number of functions, fit a model in which the hidden truth
makes the votes. Functions whose votes depend on each other given the truth are found by their mutual information and modelled
jointly. The posterior of a pair's pattern is its confidence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import business as B
from leadloom.llm.candidates import pairs_between
from leadloom.shared import cut_lineage

FUNCTIONS = ("phone", "host", "email", "own_name", "any_name", "branch", "line", "alone")
#: Functions of more than this mutual information given the truth are modelled jointly, at most so many together.
DEPENDENT, TOGETHER = 0.03, 3
#: Rows with equal compared columns from which they are judged as one.
COPIES = 4
#: Pairs of at least this confidence are matches.
SURE = 0.5


class LabelModel:
    """Two classes, cliques of functions with joint vote distributions, fitted by expectation maximisation."""

    def __init__(self, smoothing: float = 8.0, rounds: int = 500):
        self.smoothing, self.rounds = smoothing, rounds

    def fit(self, votes: np.ndarray, counts: np.ndarray, start: np.ndarray) -> LabelModel:
        """votes: distinct patterns of -1, 0, 1. counts: how many pairs have each. start: first guess of each pattern's truth."""
        codes = votes.astype(int) + 1
        truth = np.clip(start.astype(float), 0.05, 0.95)
        self.cliques = [(k,) for k in range(codes.shape[1])]
        for stage in range(2):
            if stage:
                self.cliques = self._dependent(codes, counts, truth)
            for _ in range(self.rounds):
                self._learn(codes, counts, truth)
                fresh = self._posterior(codes)
                moved = np.abs(fresh - truth).max(initial=0.0)
                truth = fresh
                if moved < 1e-6:
                    break
        return self

    def _cells(self, codes: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
        cell = np.zeros(len(codes), int)
        for k in clique:
            cell = cell * 3 + codes[:, k]
        return cell

    def _learn(self, codes, counts, truth) -> None:
        mass = np.stack([counts * (1 - truth), counts * truth])
        self.prior = (mass.sum(1) + 1) / (mass.sum() + 2)
        self.tables = []
        for clique in self.cliques:
            cell = self._cells(codes, clique)
            # Before any pair is seen, functions are held to be right more often than wrong: that weighs as much as a few pairs.
            prior = np.ones((2, 1))
            for _ in clique:
                prior = (prior[:, :, None] * np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])[:, None, :]).reshape(2, -1)
            table = np.stack([np.bincount(cell, m, 3 ** len(clique)) for m in mass]) + self.smoothing * prior
            self.tables.append(table / table.sum(1, keepdims=True))

    def _posterior(self, codes) -> np.ndarray:
        score = np.log(self.prior)[:, None] + sum(np.log(t[:, self._cells(codes, c)]) for c, t in zip(self.cliques, self.tables, strict=True))
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60)))

    def _dependent(self, codes, counts, truth) -> list[tuple[int, ...]]:
        found = []
        for i in range(codes.shape[1]):
            for j in range(i):
                info = 0.0
                for weight in (counts * truth, counts * (1 - truth)):
                    joint = np.bincount(codes[:, i] * 3 + codes[:, j], weight, 9).reshape(3, 3)
                    total = joint.sum()
                    if total <= 0:
                        continue
                    p = joint / total
                    free = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
                    info += total / counts.sum() * float((p[p > 0] * np.log(p[p > 0] / free[p > 0])).sum())
                found.append((info, j, i))
        group = {k: {k} for k in range(codes.shape[1])}
        for info, i, j in sorted(found, reverse=True):
            if info < DEPENDENT:
                break
            if group[i] is not group[j] and len(group[i]) + len(group[j]) <= TOGETHER:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
        return sorted({tuple(sorted(g)) for g in group.values()})

    def confidence(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior(votes.astype(int) + 1)


def votes_of(pairs: DataFrame) -> DataFrame:
    """The votes of the functions on candidate pairs with both records' features. Besides those of business.evidence, alone speaks
    against a line shared by different hosts without a name of their own in common, and against namesakes: a name that matches
    while no contact does and some differ."""
    name, phone, contacts = F.col("name"), F.col("phone"), (F.col("phone"), F.col("host"), F.col("email"))
    agree = sum((F.when(c == 1, 1).otherwise(0) for c in contacts[1:]), F.when(contacts[0] == 1, 1).otherwise(0))
    line = (agree == 1) & (phone == 1) & (F.col("host") == -1) & (F.col("generic") | (name != 1))
    namesake = (agree == 0) & (name == 1) & (F.least(*contacts) == -1)
    return B.evidence(pairs).withColumns({"alone": F.when(line | namesake, -1).otherwise(0), "own_name": F.when(~F.col("generic"), name).otherwise(0), "any_name": F.when(F.col("generic"), name).otherwise(0)}).select("a", "b", *FUNCTIONS)


def judged(pairs: DataFrame) -> DataFrame:
    """Votes and confidence of candidate pairs with both records' features. The model starts from the majority of votes."""
    votes = cut_lineage(votes_of(pairs))
    seen = votes.groupBy(*FUNCTIONS).count().collect()  # at most 3 to the number of functions
    if not seen:
        return votes.withColumn("confidence", F.lit(0.0))
    patterns = np.array([[r[f] for f in FUNCTIONS] for r in seen])
    model = LabelModel().fit(patterns, np.array([r["count"] for r in seen], float), (patterns.sum(1) > 0).astype(float))
    rows = [(*map(int, p), float(c)) for p, c in zip(patterns, model.confidence(patterns), strict=True)]
    table = votes.sparkSession.createDataFrame(rows, ", ".join(f"{f} int" for f in FUNCTIONS) + ", confidence double")
    return votes.join(F.broadcast(table), list(FUNCTIONS))


def link(left: DataFrame, right: DataFrame, sure: float = SURE) -> DataFrame:
    """(left_id, right_id, confidence): all pairs of rows of two keyed tables (see business.prepare) that are one business.

    Exact copies (in all compared columns) are judged once as a class and expanded at the end, as every pair is asked for.
    Records without any name and contact match nothing; rows with null ids are left out; repeated ids give their pairs once.
    Ties don't occur: every pair over ``sure`` counts. Empty tables give an empty result.
    """
    kept = ["words", "phones", "web", "mails", "mail_host"]
    some = "id is not null and (size(words) > 0 or size(phones) > 0 or web is not null or size(mails) > 0)"
    both = cut_lineage(left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).filter(some).withColumn("class", F.xxhash64(*kept)))
    common = B.common_words(B.word_counts(both))
    kinds = cut_lineage(B.host_kinds(B.host_counts(B.classify(both, common))))
    # Only what has many copies is collapsed: the rest are classes of one row.
    many = cut_lineage(both.groupBy("side", "class").count().filter(F.col("count") > COPIES).select("side", "class", F.lit(True).alias("many")))
    alone = F.xxhash64("side", "id", "class")
    if many.isEmpty():
        both = each = both.withColumn("class", alone)
    else:
        both = both.join(many, ["side", "class"], "left").withColumn("class", F.when(F.col("many"), F.col("class")).otherwise(alone))
        each = both.filter("many is null").unionByName(both.filter("many").dropDuplicates(["side", "class"]))
    named = each.select("side", F.col("class").alias("id"), *kept)
    full = cut_lineage(B.with_hosts(B.classify(named, common), kinds).select("side", "id", *B.FEATURES))
    a, b = full.filter("side = 0").drop("side"), full.filter("side = 1").drop("side")
    pairs = cut_lineage(pairs_between(a, b))
    sure_pairs = judged(B.sides(pairs, a, b)).filter(F.col("confidence") >= sure).select("a", "b", "confidence")
    ids = both.select("id", "class", "side").distinct()
    return (
        sure_pairs.join(ids.filter("side = 0").select(F.col("class").alias("a"), F.col("id").alias("left_id")), "a")
        .join(ids.filter("side = 1").select(F.col("class").alias("b"), F.col("id").alias("right_id")), "b").select("left_id", "right_id", "confidence")
    )


def lead_records(leads: DataFrame) -> DataFrame:
    return B.prepare(leads, "lead_id", "business_name", ["phone", "phone_number"], "website", "email")


def sheet_records(sheet: DataFrame) -> DataFrame:
    return B.prepare(sheet, "sheet_id", "business_name", ["phone", "phone_whatsapp"], "website", "email")
