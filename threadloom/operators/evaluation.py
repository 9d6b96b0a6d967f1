"""Evaluation statistics: reports, curves, intervals, agreement, failures."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.stats import correlation_p, ratio, wilson
from threadloom.session import settle

#: Fixed value: pairs below which agreement is not reported.
MIN_PAIRS = 8


def classification(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label of the full list (label): support, precision, recall, f1, whether support is small; and macro_f1, accuracy of all."""
    t = rows.groupBy(F.col("gold").alias("label")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.expr("gold = pred")).alias("tp"))
    p = rows.groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    r = labels.select("label").join(t, "label", "left").join(p, "label", "left").select("label", z("support").alias("s"), z("tp").alias("tp"), z("predicted").alias("n"))
    out = r.select("label", F.col("s").cast("long").alias("support"), F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0).alias("precision"), F.when(F.col("s") > 0, F.col("tp") / F.col("s")).otherwise(0.0).alias("recall"), F.when(F.col("s") + F.col("n") > 0, 2 * F.col("tp") / (F.col("s") + F.col("n"))).otherwise(0.0).alias("f1"), "tp")
    total = out.agg(F.avg("f1").alias("m"), (F.sum("tp") / F.sum("support")).alias("a"))
    return out.crossJoin(F.broadcast(total)).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], (F.col("support") < MIN_PAIRS).alias("small"), F.round("m", 6).alias("macro_f1"), F.round("a", 6).alias("accuracy"))


def escalation(rows: DataFrame) -> DataFrame:
    """One row: counts, precision, recall, F1 (null where undefined), unsafe rate with its interval, coverage with its."""
    g, p = F.col("gold_escalate"), F.col("pred_escalate")
    c = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    tp, fp, fn, tn, n = map(F.col, ("tp", "fp", "fn", "tn", "n"))
    unsafe, cover = wilson(fn, tp + fn), wilson(fn + tn, n)
    r6 = lambda x, name: F.round(x, 6).alias(name)
    return c.select("n", "tp", "fp", "fn", "tn", r6(ratio(tp, tp + fp), "precision"), r6(ratio(tp, tp + fn), "recall"), r6(F.when(tp > 0, 2.0 * tp / (2 * tp + fp + fn)), "f1"), r6(ratio(fn, tp + fn), "unsafe_rate"), r6(unsafe[0], "unsafe_low"), r6(unsafe[1], "unsafe_high"), r6(ratio(fn + tn, n), "coverage"), r6(cover[0], "coverage_low"), r6(cover[1], "coverage_high"))


def coverage_risk(rows: DataFrame, steps: int = 20) -> DataFrame:
    """For tau from 0 to 1: how many are handled at that confidence, and how many of the wrong ones among them."""
    taus = rows.select(F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"), "conf", "gold", "pred", "gold_escalate")
    auto = F.col("conf") >= F.col("k") / steps
    g = taus.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(auto).alias("n_auto"), F.count_if(auto & F.col("gold_escalate")).alias("n_unsafe"), F.count_if(auto & (F.col("gold") != F.col("pred"))).alias("n_wrong"))
    return g.select(F.round(F.col("k") / steps, 2).alias("tau"), "n_auto", F.round(F.col("n_auto") / F.col("n"), 6).alias("coverage"), F.round(ratio(F.col("n_unsafe"), F.col("n_auto")), 6).alias("unsafe_share"), F.round(ratio(F.col("n_wrong"), F.col("n_auto")), 6).alias("error_rate"))


def beta_share(x: float, a: np.ndarray, b: np.ndarray, least: float = 1e-15) -> np.ndarray:
    """The regularised incomplete beta function at 0 < x < 1 for arrays a, b > 0, by its continued fraction."""
    swap = x >= (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    f, c, d = np.ones_like(a), np.ones_like(a), np.zeros_like(a)
    for i in range(200_000):
        m = i // 2
        n = np.ones_like(a) if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / np.where((v := 1 + n * d) == 0, 1e-300, v)
        c = np.where((v := 1 + n / c) == 0, 1e-300, v)
        f = f * c * d
        if i > 1 and (np.abs(c * d - 1) < least).all():
            break
    gamma = np.vectorize(math.lgamma, otypes=[float])
    out = np.exp(a * np.log(x) + b * np.log1p(-x) + gamma(a + b) - gamma(a) - gamma(b)) / a * (f - 1)
    return np.where(swap, 1 - out, out)


def binomial(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """The least k of n draws at p (0 < p < 1) whose distribution function reaches u, by bisection."""
    low, high = np.full(len(n), -1, dtype=np.int64), n.copy()
    while (open_ := high - low > 1).any():
        k = (low + high) // 2
        at = np.flatnonzero(open_)
        reached = np.zeros(len(n), dtype=bool)
        reached[at] = beta_share(1 - p, (n - k)[at].astype(float), (k + 1)[at].astype(float)) >= u[at]
        high, low = np.where(open_ & reached, k, high), np.where(open_ & ~reached, k, low)
    return high


def resampled(cells: list[tuple[str, int]], b: np.ndarray, seed: str) -> np.ndarray:
    """For each resample b how often each cell (name, count) is drawn in n draws with replacement: a multinomial, as binomials one after the other.

    A cell's uniform is hashed from b and its name, so the draws don't depend on how the work is dealt.
    """
    rest = sum(c for _, c in cells)
    left = np.full(len(b), rest, dtype=np.int64)
    out = np.zeros((len(b), len(cells)), dtype=np.int64)
    for i, (name, c) in enumerate(cells):
        u = np.array([int(hashlib.md5(f"{x}:{name}:{seed}".encode()).hexdigest()[:8], 16) for x in b.tolist()])
        out[:, i] = left if c == rest else binomial((u + 0.5) / 2**32, left, c / rest)
        left, rest = left - out[:, i], rest - c
    return out


def rates(cells: list[tuple], n: np.ndarray, labels: list) -> tuple[np.ndarray, np.ndarray]:
    """Accuracy and macro-F1 over the labels, for each row of counts of the cells (gold, pred)."""
    right = np.array([g == p for g, p in cells])
    f1 = []
    for x in labels:
        gold, pred = np.array([g == x for g, _ in cells]), np.array([p == x for _, p in cells])
        f1.append(2 * n[:, gold & pred].sum(axis=1) / np.maximum(1, n[:, gold].sum(axis=1) + n[:, pred].sum(axis=1)))
    return n[:, right].sum(axis=1) / np.maximum(1, n.sum(axis=1)), np.mean(f1, axis=0)


def bootstrap(rows: DataFrame, labels: list, n_boot: int, seed: str = "boot") -> DataFrame:
    """One row: accuracy and macro_f1 of rows (gold, pred), each with the 2.5 and 97.5 percentiles over resamples (_low, _high), and n_boot.

    Each resample draws n of n rows with replacement. Rows with equal gold and pred are alike, so what is drawn are their counts: the work
    is n_boot times the pairs of classes, whatever the number of rows. Without rows all figures are null. macro_f1 is the mean over ``labels``.
    """
    spark = rows.sparkSession
    counted = sorted((r["gold"], r["pred"], r["n"]) for r in rows.filter("gold is not null and pred is not null").groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a pair of classes
    cells = [(g, p) for g, p, _ in counted]
    if not cells:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("accuracy", "accuracy_low", "accuracy_high", "macro_f1", "macro_f1_low", "macro_f1_high")], F.lit(0).cast("long").alias("n_boot"))
    named = [(f"{g}:{p}", n) for g, p, n in counted]

    def drawn(batches):
        for b in batches:
            x = b["id"].to_numpy()
            accuracy, f1 = rates(cells, resampled(named, x, seed), labels)
            yield pd.DataFrame({"accuracy": accuracy, "macro_f1": f1})

    each = spark.range(n_boot).mapInPandas(drawn, "accuracy double, macro_f1 double")
    whole = rates(cells, np.array([[n for *_, n in counted]]), labels)
    ends = [F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{name}") for c in ("accuracy", "macro_f1") for name, q in (("low", 0.025), ("high", 0.975))]
    out = each.agg(*ends, F.count(F.lit(1)).alias("n_boot"))  # n_boot rows
    return out.withColumns({"accuracy": F.round(F.lit(float(whole[0][0])), 6), "macro_f1": F.round(F.lit(float(whole[1][0])), 6)})


def average_rank(cells: DataFrame, by: str, column: str, name: str) -> DataFrame:
    """by, column, name: the mean rank that equal values share, from counted cells (by, ..., c). One window row a value."""
    n = cells.groupBy(by, column).agg(F.sum("c").alias("n"))
    below = F.sum("n").over(W.partitionBy(by).orderBy(column)) - F.col("n")
    return n.select(by, column, (below + (F.col("n") + 1) / 2.0).alias(name))


def paired(human: DataFrame, judge: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, human, judge: both ratings of each item (id) that both have rated; rows on which the judge failed and null ratings are left out."""
    j = judge.filter(~F.coalesce("failed", F.lit(False))).select("id", F.struct(*dims).alias("__j"))
    both = human.select("id", F.struct(*dims).alias("__h")).join(j, "id")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"__h.{d}").alias("human"), F.col(f"__j.{d}").alias("judge")) for d in dims]))
    return both.select(each.alias("p")).select("p.*").filter("human is not null and judge is not null")


def assembled(gold: DataFrame, runs: DataFrame, judged_: DataFrame) -> DataFrame:
    """What ``failures`` reads: gold (id, gold, gold_escalate) with the system's runs (id, pred, decision, n_evidence, parse_failed) and the judge's rows (id, failed, groundedness, unsupported).

    Items without a run are left out; those without a judge's row keep nulls in its columns.
    """
    r = runs.select("id", "pred", (F.col("decision") == "escalate").alias("pred_escalate"), (F.col("n_evidence") > 0).alias("has_evidence"), "parse_failed")
    j = judged_.select("id", F.col("failed").alias("judge_failed"), "groundedness", "unsupported")
    return gold.select("id", "gold", "gold_escalate").join(r, "id").join(j, "id", "left")


def agreement(pairs: DataFrame, by: str = "dimension") -> DataFrame:
    """Per dimension of pairs (human, judge): status, Spearman and its two-sided p, plain and quadratic kappa, exact, within one, mean distance, bias (judge - human).

    Weights go by the place of a rating in the sorted union of ratings that occur. Kappas are null where chance leaves no disagreement.
    Everything comes from one count of the pairs by their ratings, which are few.
    """
    cells = settle(pairs.groupBy(by, "human", "judge").agg(F.count(F.lit(1)).alias("c")), "cells")
    ranked = cells.join(average_rank(cells, by, "human", "x"), [by, "human"]).join(average_rank(cells, by, "judge", "y"), [by, "judge"])
    c, x, y, gap = F.col("c"), F.col("x"), F.col("y"), F.col("judge") - F.col("human")
    total = lambda v: F.sum(c * v)
    mean = lambda v: F.sum(c * v) / F.sum(c)
    centred = ranked.join(ranked.groupBy(by).agg(mean(x).alias("mx"), mean(y).alias("my")), by).withColumns({"x": x - F.col("mx"), "y": y - F.col("my")})
    plain = centred.groupBy(by).agg(
        F.sum("c").alias("n"), F.when((total(x * x) > 0) & (total(y * y) > 0), total(x * y) / F.sqrt(total(x * x) * total(y * y))).alias("spearman"), mean((gap == 0).cast("double")).alias("exact"),
        mean((F.abs(gap) <= 1).cast("double")).alias("within_one"), mean(F.abs(gap)).alias("distance"), mean(gap).alias("bias"),
    )
    used = cells.select(by, F.col("human").alias("r")).unionByName(cells.select(by, F.col("judge").alias("r"))).distinct().withColumn("i", F.row_number().over(W.partitionBy(by).orderBy("r")))
    count = lambda c, i, n: cells.groupBy(by, F.col(c).alias("r")).agg(F.sum("c").cast("double").alias(n)).join(used, [by, "r"]).select(by, F.col("i").alias(i), n)
    h, j = count("human", "i", "nh"), count("judge", "j", "nj")
    # Ratings are few: the product of both margins has at most ratings squared rows a dimension.
    chance = h.join(j, by).groupBy(by).agg(F.sum(F.col("nh") * F.col("nj") * F.pow(F.col("i") - F.col("j"), 2)).alias("ew"), F.sum(F.when(F.col("i") == F.col("j"), F.col("nh") * F.col("nj")).otherwise(0.0)).alias("e"))
    at = lambda c, i: used.select(by, F.col("r").alias(c), F.col("i").alias(i))
    seen = cells.join(at("human", "i"), [by, "human"]).join(at("judge", "j"), [by, "judge"]).groupBy(by).agg(F.sum(F.col("c") * F.pow(F.col("i") - F.col("j"), 2)).alias("ow"))
    r6 = lambda c, name: F.round(c, 6).alias(name)
    n = F.col("n")
    all_ = plain.join(chance, by).join(seen, by)
    return all_.select(by, "n", F.when(n == 0, "PENDING").when(n < MIN_PAIRS, "INSUFFICIENT").otherwise("OK").alias("status"), r6("spearman", "spearman"), F.round(correlation_p(F.col("spearman"), n), 4).alias("spearman_p"), r6(F.when(F.col("e") < n * n, (F.col("exact") - F.col("e") / (n * n)) / (1 - F.col("e") / (n * n))), "kappa"), r6(F.when(F.col("ew") > 0, 1 - F.col("ow") * n / F.col("ew")), "weighted_kappa"), *[r6(c, c) for c in ("exact", "within_one", "distance", "bias")])


def failures(rows: DataFrame, top: int = 5) -> DataFrame:
    """mode, n, pct, examples: the commonest failures of rows (id, gold, pred, gold_escalate, pred_escalate, has_evidence, unsupported, judge_failed, groundedness, parse_failed).

    A row can show several modes; a judge's columns are null for rows that were not judged.
    """
    wrong = F.when(F.col("gold") != F.col("pred"), F.concat(F.lit("intent confusion: "), F.col("gold").cast("string"), F.lit(" -> "), F.col("pred").cast("string")))
    unsafe = F.when(F.col("gold_escalate") & ~F.col("pred_escalate"), "unsafe auto-handle")
    over = F.when(~F.col("gold_escalate") & F.col("pred_escalate"), "over-escalation")
    bare = F.when(~F.col("has_evidence"), "no historical precedent retrieved")
    claims = F.when(F.col("unsupported") == 1, "unsupported claim in draft")
    weak = F.when(~F.col("judge_failed") & (F.col("groundedness") <= 2), "poorly grounded reply")
    broken = F.when(F.col("parse_failed"), "model output failed to parse")
    modes = rows.select("id", F.explode(F.array_compact(F.array(wrong, unsafe, over, claims, weak, broken, bare))).alias("mode"))
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    two = modes.withColumn("k", F.row_number().over(W.partitionBy("mode").orderBy("id"))).filter("k <= 2")  # a limit by group, taken before the exchange too
    two = two.groupBy("mode").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("examples"))
    ids = modes.groupBy("mode").agg(F.count(F.lit(1)).alias("n")).join(two, "mode")
    ranked = ids.crossJoin(F.broadcast(n)).select("mode", "n", F.round(100.0 * F.col("n") / F.greatest("n_rows", F.lit(1)), 1).alias("pct"), "examples")
    return ranked.orderBy(F.desc("n"), "mode").limit(top)


def judged(ratings: DataFrame, dims: list[str]) -> DataFrame:
    """Per system: judged and failed rows, means of the dimensions and of their composite, rates of the flag; failed rows only count as failed."""
    ok = ~F.col("failed")
    composite = sum((F.col(d) for d in dims[1:]), F.col(dims[0])) / len(dims)
    return ratings.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("failure_rate"), *[F.round(F.avg(F.when(ok, F.col(d))), 6).alias(f"mean_{d}") for d in dims], F.round(F.avg(F.when(ok, composite)), 6).alias("composite"), F.round(F.avg(F.when(ok, F.col("flagged").cast("double"))), 6).alias("flag_rate"))
