"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of byte trigrams (lower case, letters only) hashed into a fixed number of
buckets, compared by cosine with centroids that spherical k-means finds among each language's documents.
A text is rejected if it is too far from every centroid for its length: the bound is calibrated on pieces of
the training documents, and on the same pieces with their letters shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import bound_batches, fresh, materialise

#: Documents a language that the centroids are fitted on at most, those with the smallest hashes.
SAMPLE = 400
#: Languages up to which their counted table is broadcast; more meet the texts by an exchange, each in so many parts.
BROADCAST, SALTS = 10_000, 32
BUCKETS = 8192
CENTROIDS = 3
#: The share of the training pieces of a length that rejection may cost at most.
COST = 0.02
#: Documents a language that the bounds are calibrated on. Bounds are by the power of two of a text's trigrams.
PIECES, LENGTHS = 100, 24
UNDETERMINED = "und"
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_SLICE = 1 << 20


def counts(text: str) -> np.ndarray:
    """Trigram counts by bucket, over the whole text in slices."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_LETTERS), dtype=np.uint8)
    out = np.zeros(BUCKETS, dtype=np.float32)
    for s in range(0, len(data) - 2, _SLICE):
        d = data[s : s + _SLICE + 2].astype(np.uint32)
        gram = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
        out += np.bincount(((gram * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)
    out[_BLANK] = 0
    return out


_BLANK = int(((0x202020 * 2654435761) & 0xFFFFFFFF) >> 19)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray
    weighted: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[int, float]:
        """The nearest centroid and its cosine (0 for an empty vector)."""
        norm = float(np.sqrt(np.square(x * self.idf).sum()))
        if norm == 0:
            return 0, 0.0
        cosine = self.weighted @ x / norm
        best = int(np.argmax(cosine))
        return best, float(min(1.0, max(0.0, cosine[best])))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine from 0 to 1, whether it is rejected."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        x = counts(text)
        best, score = self.nearest(x)
        return self.languages[int(self.owner[best])], score, score == 0 or score < float(self.floor[length(x)])


def length(x: np.ndarray) -> int:
    """The power of two of a text's trigrams."""
    return min(LENGTHS - 1, int(np.log2(1 + float(x.sum()))))


def pieces(model: Model, texts: list[str]) -> pd.DataFrame:
    """length, true, noise: the cosines of pieces of the texts, one of each length that a text has, and of the same with their letters shuffled."""
    rng, out = np.random.default_rng(0), []
    for t in texts:
        for k in range(min(LENGTHS, len(t).bit_length())):
            at = int(rng.integers(0, len(t) - (1 << k) + 1))
            piece = t[at : at + (1 << k)]
            if any(map(str.isalpha, piece)):
                x = counts(piece)
                if length(x) == k:
                    out.append((k, model.nearest(x)[1], model.nearest(counts("".join(rng.permutation(list(piece)))))[1]))
    return pd.DataFrame(out, columns=["length", "true", "noise"])


def floors(rows: list) -> np.ndarray:
    """For each length the least cosine that is not rejected, from rows (length, n, noise_most, middle, cost).

    It lies half way between what 99 % of shuffled pieces stay below and the middle of the true ones, but
    never above what COST of the true ones stay below. A length without enough pieces has the next shorter one's.
    """
    by, floor = {r["length"]: r for r in rows}, np.zeros(LENGTHS)
    for k in range(LENGTHS):
        floor[k] = floor[k - 1] if k else 0.0
        if k in by and by[k]["n"] >= 20:
            floor[k] = min((by[k]["noise_most"] + by[k]["middle"]) / 2, by[k]["cost"])
    return floor


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; the start is the first row, then again and again the row least like those chosen."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


NOTHING = Model([], np.zeros(0, int), np.zeros((0, BUCKETS), np.float32), np.ones(BUCKETS, np.float32), np.zeros(LENGTHS))


def centroids_of(texts: list[str], idf: np.ndarray, k: int = CENTROIDS) -> np.ndarray | None:
    """Unit centroids of a language's weighted vectors, None if no text has a trigram; the texts' order counts."""
    x = np.stack([counts(t) for t in texts]) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
    return spherical_kmeans(x, k) if len(x) else None


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Every language learned from at most ``sample`` of its documents, none of them held out.

    Each language is fitted in a group of its own, at most ``sample`` vectors; the driver gets the centroids, 32 KB each, and a row a length.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    known = known.withColumn("__h", F.xxhash64("doc_id", "text", F.lit("langid")))
    if sizes.count() <= BROADCAST:
        sized = known.join(F.broadcast(sizes), "lang")
    else:
        salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = known.withColumn("salt", F.pmod("__h", F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    near = sized.filter(F.pmod("__h", F.lit(1 << 30)) < F.least(F.lit(1.0), 3 * sample / F.col("n")) * (1 << 30))
    one = near.groupBy("lang", "__h").agg(F.min("text").alias("text")).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("__h", F.lit(1 << 30)), "__h")))
    rows = materialise(one.filter(F.col("r") <= sample).select("lang", "r", "text"), "language-samples")

    def seen(batches):
        for b in batches:
            df, n = np.zeros(BUCKETS, dtype=np.int64), 0
            for t in b["text"]:
                df += counts(t) > 0
                n += 1
            yield pd.DataFrame({"at": np.arange(BUCKETS + 1), "df": np.r_[df, n]})

    df = rows.select("text").mapInPandas(seen, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()  # BUCKETS rows
    if not len(df):
        return NOTHING
    in_order = df.sort_values("at")["df"].to_numpy()
    idf = (np.log((1 + in_order[-1]) / (1 + in_order[:-1])) + 1).astype(np.float32)

    def learned(name: tuple, own: pd.DataFrame) -> pd.DataFrame:
        c = centroids_of(own.sort_values("r")["text"].tolist(), idf, k)
        return pd.DataFrame({"lang": [name[0]], "n": [len(c)], "c": [c.astype(np.float32).tobytes()]}) if c is not None else pd.DataFrame({"lang": [], "n": [], "c": []})

    got = rows.groupBy("lang").applyInPandas(learned, "lang string, n int, c binary").orderBy("lang").collect()
    if not got:
        return NOTHING
    weighted = np.concatenate([np.frombuffer(r["c"], np.float32).reshape(-1, BUCKETS) for r in got]) * idf
    model = Model([r["lang"] for r in got], np.repeat(np.arange(len(got)), [r["n"] for r in got]), weighted.astype(np.float32), idf, np.zeros(LENGTHS))
    tried = rows.filter(F.col("r") <= PIECES).groupBy("lang").applyInPandas(lambda own: pieces(model, own.sort_values("r")["text"].tolist()), "length int, true double, noise double")
    each = tried.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.percentile("noise", F.lit(0.99)).alias("noise_most"), F.percentile("true", F.lit(0.5)).alias("middle"), F.percentile("true", F.lit(COST)).alias("cost"))
    model.floor = floors(each.collect())
    return model


def language_column(model: Model, text: Column) -> Column:
    """struct<lang_pred string, score double, rejected boolean>."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score", "rejected"])

    return predict.asNondeterministic()(text)


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row a row of ``docs``, predicted from the text alone.

    A null text, or one without a letter, is 'und' with score 0 and rejected; so is every text if no
    document could be learned from. Very long texts are read whole, in slices. Extra columns are not read; repeated rows give repeated
    rows; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    model = model or fit(docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_column(model, F.col("text")).alias("__p"))
    return out.select("doc_id", "held_out", "__p.lang_pred", "__p.score", "__p.rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected; null texts, and texts without a letter, are.

    Repeated rows share a decision; an empty table gives an empty one; other columns, whatever their names, are carried along.
    """
    bound_batches(docs.sparkSession)
    model = fit(docs.select("doc_id", "text", "lang"))
    own = fresh(docs, "__language")
    return docs.withColumn(own, language_column(model, F.col("text"))).filter(~F.col(f"{own}.rejected")).drop(own)
