"""How well suggested maps agree with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import paging

LABELS = ("I", "R", "E")


def labels_of(text: Column) -> Column:
    """Known labels of a comma-separated list, upper-cased, distinct, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x.isin(*LABELS)))


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, accuracy and the four confusion counts of 0/1 columns."""
    t, g = F.col(truth), F.col(guess)
    count = lambda a, b: F.count_if((t == a) & (g == b))
    return rows.agg(F.count("*").alias("n"), F.avg((t == g).cast("double")).alias("accuracy"), count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))


def match_class(truth: Column, guess: Column) -> Column:
    """full if all true labels are guessed (more or not), partial if some are, else mismatch; so where one has none."""
    one_empty = (F.size(truth) == 0) != (F.size(guess) == 0)
    shared = F.size(F.array_intersect(truth, guess))
    return F.when(one_empty, "mismatch").when(shared == F.size(truth), "full").when(shared > 0, "partial").otherwise("mismatch")


def new_label(truth: Column, guess: Column) -> Column:
    """Whether a label is guessed that is not a true one."""
    return F.size(F.array_except(guess, truth)) > 0


def label_summary(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: matches by class; accuracy, the share that is full or partial; share with a new label (four places)."""
    kind, n = match_class(F.col(truth), F.col(guess)), F.count("*")
    counts = [F.count_if(kind == c) for c in ("full", "partial", "mismatch")]
    share = lambda c: F.round(c / F.when(n > 0, n), 4)
    news = F.count_if(new_label(F.col(truth), F.col(guess)))
    return rows.agg(*[c.alias(name) for c, name in zip(counts, ("full", "partial", "mismatch"), strict=True)], news.alias("new_labels"), share(counts[0] + counts[1]).alias("accuracy"), share(news).alias("new_share"))


def hamming_loss(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean share of LABELS on which two label arrays differ."""
    differ = F.size(F.array_except(truth, guess)) + F.size(F.array_except(guess, truth))
    return rows.agg(F.avg(differ / len(LABELS)).alias("hamming_loss"))


def balanced(rows: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """All positives and exactly as many negatives, or all of them: those whose seeded hash is lowest."""
    positives = rows.where(F.col(label) == 1)
    negatives = paging.hashed(rows.where(F.col(label) == 0), seed)
    return positives.unionByName(paging.lowest(negatives, positives.count()).drop(paging.HASH))


def split(rows: DataFrame, seed: int = 42) -> list[DataFrame]:
    """80, 10 and 10 % of the rows in the order of a seeded hash, exactly but for rounding down and equal rows."""
    some = paging.parts(paging.hashed(rows, seed), [0.8, 0.1, 0.1])
    return [p.drop(paging.HASH) for p in some]


def shuffled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """rows in the order of a seeded hash, sorted in ranges."""
    return paging.hashed(rows, seed).orderBy(paging.HASH).drop(paging.HASH)
