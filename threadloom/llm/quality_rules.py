"""Quality rules whose cutoffs limit the false rejections of each stratum, by exact binomial bounds.

A rule rejects a document of which some share (symbols, repeated lines, ...) lies above a cutoff. Cutoffs are levels of a
fixed grid. For each stratum (a language) one part of the labelled documents orders the candidates into a path: step after step
one cutoff falls, first where it costs the least good documents. The other part, the holdout, tests the path in
this order: a step is safe if the exact (Clopper-Pearson) upper bound of the share of good documents that all cutoffs
so far reject stays within RISK. The test of a path ends at its first step that is not safe, so no correction for
its length is needed; the error probability is divided by the number of strata (Bonferroni). With
probability 1 - DELTA no stratum then loses more than RISK of its good documents that pass the base rules. Of the safe steps the
first is taken that catches as many bad documents as any. All labelled documents count.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, materialise, unit_hash

#: Fixed values of the contract: symbols; words that a text needs; the share of words in repeated windows that is too much, in per cent.
SYMBOLS, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 50, 50
#: Good documents of a stratum that the rules may cost, the probability that any stratum loses more, the share of the labelled documents held out.
RISK, DELTA, HOLDOUT = 0.04, 0.05, 2 / 3
#: Steps of the grid: level k begins above the share ((k - 1) / LEVELS) squared.
LEVELS = 64
#: What is measured of a text, and the rules: a share is the first measure over the second, times the factor.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks")
RULES = {"symbols": ("n_symbols", "word_chars", 1.0), "repeated lines": ("n_dup_lines", "n_lines", 1.0), "repeated words": ("n_repeat_words", "n_words", 1.0), "capitals": ("n_upper", "n_letters", 1.0), "marks": ("n_marks", "word_chars", 1.0), "long words": ("word_chars", "n_words", 1 / 32)}
_BLANKS = " \t\n\x0b\x0c\r"
_NEVER = 1 << 30


@functools.cache
def kind(code: int) -> tuple[int, int, int, int, int]:
    """Of a code point: whether it stands in words, is a symbol, a letter, a capital, a mark."""
    c = chr(code)
    blank = c in _BLANKS
    return int(not blank), int(c in SYMBOLS), int(c.isalpha()), int(c.isupper()), int(not blank and not c.isalnum())


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that stand at two places or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = np.r_[n[at] > 1, False, False]
    return int((again | np.r_[False, again[:-1]] | np.r_[False, False, again[:-2]]).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; a null one is empty."""
    text = text or ""
    codes, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
    in_words, symbols, letters, upper, marks = (n @ np.array([kind(c) for c in codes.tolist()], dtype=np.int64).reshape(-1, 5)).tolist()
    words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(words), in_words, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), letters, upper, marks


def measures(text: Column) -> Column:
    """struct of COUNTS as longs."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def measured(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([measure(t) for t in text], dtype=np.int64).reshape(-1, len(COUNTS)), columns=list(COUNTS))

    return measured.asNondeterministic()(text)


def level(part: Column, whole: Column, factor: float) -> Column:
    """The grid's level of a share, 0 to LEVELS."""
    share = F.least(F.lit(1.0), part * factor / F.greatest(whole, F.lit(1)))
    return F.ceil(LEVELS * F.sqrt(share)).cast("int")


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, COUNTS, levels (of each rule), base_failed: one row a row of ``docs``."""
    m = docs.select("doc_id", F.col(stratum).alias("stratum"), measures(F.col("text")).alias("__m")).select("doc_id", "stratum", "__m.*")
    levels = F.array(*[level(F.col(a), F.col(b), factor) for a, b, factor in RULES.values()])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return m.withColumns({"levels": levels, "base_failed": base})


def at_most(x: int, n: int, p: float) -> float:
    """P(X <= x) of the binomial distribution of n draws at p."""
    k = np.arange(min(x, n) + 1)
    steps = np.log(np.maximum(n - k[:-1], 1)) - np.log(k[1:]) + math.log(p) - math.log1p(-p)
    terms = n * math.log1p(-p) + np.r_[0.0, np.cumsum(steps)]
    top = terms.max()
    return min(1.0, float(np.exp(terms - top).sum() * math.exp(top)))


def paths(hist: pd.DataFrame) -> list[tuple[int, int]]:
    """Steps (rule, cutoff) from counts (rule, level, quality, n): by the good documents that a cutoff alone costs, then by the bad ones that it catches.

    A cutoff is a step only if it catches more than any higher one of its rule, and a larger share of the bad than of the good.
    It then moves a third of the way to the lowest that costs no more, so that documents a little less bad are caught too.
    """
    steps = []
    for rule in range(len(RULES)):
        own = hist[hist["rule"] == rule]
        over = []
        for quality in (0, 1):
            n = np.bincount(own.loc[own["quality"] == quality, "level"], weights=own.loc[own["quality"] == quality, "n"], minlength=LEVELS + 1)
            over.append(np.r_[n[::-1].cumsum()[::-1][1:], 0] / max(1, n.sum()))  # above each level
        caught = 0.0
        for cut in range(LEVELS - 1, -1, -1):
            bad, good = over[0][cut], over[1][cut]
            if bad > caught:
                caught = bad
                if bad > good:
                    low = int(np.flatnonzero(over[1] == good).min())
                    steps.append((good, -bad, rule, cut - (cut - low) // 3))
    return [(rule, cut) for *_, rule, cut in sorted(steps)]


def first_steps(path: list[tuple[int, int]]) -> list[int]:
    """For each rule and level the first step (from 1) that rejects it, one after the other."""
    out = np.full((len(RULES), LEVELS + 1), _NEVER)
    for k, (rule, cut) in reversed(list(enumerate(path, 1))):
        out[rule, cut + 1 :] = k
    return out.ravel().tolist()


def safe_steps(lost: list[int], n: int, error: float, risk: float = RISK) -> int:
    """How many steps pass one after the other, by the good documents of n that each and all before it reject."""
    for k, x in enumerate(lost):
        if n == 0 or at_most(x, n, risk) > error:
            return k
    return len(lost)


def cutoffs(path: list[tuple[int, int]], steps: int) -> list[int]:
    out = [LEVELS] * len(RULES)
    for rule, cut in path[:steps]:
        out[rule] = min(out[rule], cut)
    return out


def calibrate(known: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs (a level for each rule; LEVELS rejects nothing), n_good, n_lost (of the holdout), steps, from known (doc_id, stratum, levels, quality).

    One row a stratum that has labelled documents. Only counts meet: at most 2 x LEVELS x rules rows, then a row a step, in a group.
    """
    rows = known.withColumn("held", unit_hash(F.col("doc_id").cast("string"), "holdout") < HOLDOUT)
    hist = rows.filter(~F.col("held")).select("stratum", "quality", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level", "quality").agg(F.count(F.lit(1)).alias("n"))
    kind_ = known.schema["stratum"].dataType.simpleString()

    def ordered(hist: pd.DataFrame) -> pd.DataFrame:
        path = paths(hist)
        return pd.DataFrame({"__stratum": hist["stratum"].iloc[:1], "rules": [[r for r, _ in path]], "cuts": [[c for _, c in path]], "first": [first_steps(path)]})

    found = materialise(hist.groupBy("stratum").applyInPandas(ordered, f"__stratum {kind_}, rules array<int>, cuts array<int>, first array<int>"), "paths")
    same = F.col("stratum").eqNullSafe(F.col("__stratum"))
    step = F.least(*[F.get("first", F.lit(r * (LEVELS + 1)) + F.get("levels", F.lit(r))) for r in range(len(RULES))], F.lit(_NEVER))
    counts = rows.join(found.select("__stratum", "first"), same).groupBy("stratum", "held", "quality", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    n_strata = found.count()
    error = delta / max(1, n_strata)

    def chosen(counts: pd.DataFrame) -> pd.DataFrame:
        path = list(zip(counts["rules"].iloc[0], counts["cuts"].iloc[0], strict=True))
        by = lambda held, quality: counts[(counts["held"] == held) & (counts["quality"] == quality)]
        upto = lambda own: np.bincount(np.minimum(own["step"], len(path) + 1), weights=own["n"], minlength=len(path) + 2).cumsum().astype(int)
        good, bad = upto(by(True, 1)), upto(by(False, 0))
        safe = safe_steps(good[1 : len(path) + 1].tolist(), int(good[-1]), error, risk)
        steps = int(np.argmax(bad[: safe + 1]))  # the first of those that catch the most
        return pd.DataFrame({"stratum": counts["stratum"].iloc[:1], "cutoffs": [cutoffs(path, steps)], "n_good": [int(good[-1])], "n_lost": [int(good[steps])], "steps": [steps]})

    both = counts.join(found.select("__stratum", "rules", "cuts"), same).drop("__stratum")
    return materialise(both.groupBy("stratum").applyInPandas(chosen, f"stratum {kind_}, cutoffs array<int>, n_good long, n_lost long, steps int"), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the five counts of the contract, base_failed, kept: one row a row of ``docs``.

    ``labels`` (doc_id, quality: 1 good, 0 bad) calibrate the cutoffs; other values are left out, a document with
    several takes the smallest. A stratum (null is one) with too few labelled documents to prove a cutoff safe keeps all that passes the
    base rules. A null or empty text has no words and fails them; texts are read whole, however long. Equal
    texts of a stratum are judged alike, repeated rows give repeated rows, an empty table an empty one. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    f = materialise(features(docs, stratum), "measures")
    labels = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("quality"))
    known = f.filter(~F.col("base_failed")).join(labels, F.col("doc_id") == F.col("__id")).select("doc_id", "stratum", "levels", "quality")
    cuts = calibrate(materialise(known, "labelled"))
    over = F.exists(F.arrays_zip("levels", "cutoffs"), lambda x: x["levels"] > x["cutoffs"])
    out = f.join(cuts.select(F.col("stratum").alias("__stratum"), "cutoffs"), F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).alias("kept"))
