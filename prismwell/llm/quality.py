"""Quality scores by regularised quadratic discriminant analysis.

Every whole text becomes a vector of transformed statistics. Each class has a mean and a covariance,
shrunk towards the pooled covariance and its diagonal; a score is the logistic of the difference of
the two log densities, each from a Mahalanobis distance by a Cholesky factor that is computed once.
Sums and outer products of all labelled training rows are gathered by Spark; the driver gets one row
for each class.

Edge cases: null and empty texts have the statistics of an empty text and a score; a document with
several labels counts once for each, one with a null label or id is not learned from; repeated rows
are scored each; an empty table gives no rows; without labels of both classes, scores are 0.5; extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, text_bytes, whole_rows
from .filters import HashFilter

#: Share of the pooled covariance in each class's, then of the diagonal in the result.
POOLED, DIAGONAL = 0.5, 0.02
#: From this score on a document counts as of class 1.
THRESHOLD = 0.3
FEATURES = ("words", "word_length", "upper", "digit", "exclamation", "symbol", "pipe", "stop", "line", "non_ascii", "distinct", "adjacent", "top_word")
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SYMBOLS = list(b"#$%&*@^~<>=+_\\{}[]")


def statistics(data: bytes) -> np.ndarray:
    """The transformed statistics of one text, in the order of FEATURES."""
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = len(words)
    seen = Counter(words)
    size = len(data)
    share = lambda count, of: np.log((count + 0.5) / (of + 50.0))  # noqa: E731  of short texts nearer to the usual
    upper, lower = int(chars[_UPPER].sum()), int(chars[_LOWER].sum())
    top = max(seen.values(), default=0)
    return np.array([
        np.log1p(n), np.log((size + 5.0) / (n + 1.0)), share(upper, upper + lower), share(int(chars[48:58].sum()), size),
        share(int(chars[33]), n), share(int(chars[_SYMBOLS].sum()), n), share(int(chars[124]), n), share(int(chars[46] + chars[44]), n),
        share(int(chars[10]), n), share(int(chars[128:].sum()), size), np.log((len(seen) + 5.0) / (n + 5.0)),
        share(sum(map(eq, words, words[1:])), n), np.log((top + 2.0) / (n + 20.0)),
    ])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of classes 0 and 1, and a calibration."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
        """From each class's number of rows, sum of vectors and sum of outer products."""
        means = sums / counts[:, None]
        cov = squares / counts[:, None, None] - means[:, :, None] * means[:, None, :]
        both = (cov * counts[:, None, None]).sum(0) / counts.sum()
        cov = (1 - pooled) * cov + pooled * both
        diag = np.zeros_like(cov)
        k = np.arange(cov.shape[1])
        diag[:, k, k] = cov[:, k, k]
        cov = (1 - diagonal) * cov + diagonal * diag
        cov[:, k, k] += 1e-6
        chol = np.linalg.cholesky(cov)
        return cls(means, np.linalg.inv(chol), 2 * np.log(chol[:, k, k]).sum(1), float(np.log(counts[1] / counts[0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        z = np.stack([(x - m) @ f.T for m, f in zip(self.means, self.factors, strict=True)])
        density = -0.5 * ((z**2).sum(2) + self.log_dets[:, None])
        margin = np.clip(density[1] - density[0] + self.prior, -500, 500)
        return 1 / (1 + np.exp(-margin))


def with_statistics(docs: DataFrame, text: str = "text", out: str = "x") -> DataFrame:
    """``docs`` with an array of the text's transformed statistics."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return docs.withColumn(out, measured(text_bytes(text)))


def fit_discriminant(rows: DataFrame) -> Discriminant | None:
    """The model of ``rows`` (x, label), all of them; None without rows of both classes.

    Each partition sums up its vectors and outer products; Spark adds those entry by entry.
    """
    k = len(FEATURES)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + k + k * k))
        for pdf in batches:
            for c in (0, 1):
                x = pdf["x"][pdf["label"] == c]
                if len(x):
                    x = np.stack(x.to_numpy())
                    total[c] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"label": [0, 1], "sums": list(total)})

    known = rows.where(F.col("label").isin(0, 1)).select("x", F.col("label").cast("int").alias("label"))
    parts = known.mapInPandas(partial, "label int, sums array<double>").select("label", F.posexplode("sums").alias("pos", "v"))
    got = parts.groupBy("label", "pos").agg(F.sum("v").alias("v")).collect()  # 2 classes times 1 + k + k * k numbers
    total = np.zeros((2, 1 + k + k * k))
    for r in got:
        total[r["label"], r["pos"]] = r["v"]
    if not total[:, 0].all():
        return None
    return Discriminant.fit(total[:, 0], total[:, 1 : k + 1], total[:, k + 1 :].reshape(2, k, k))


def training_rows(stats: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """(x, label) of the labelled rows of ``stats`` outside fold 0, whose remainder of crc32 is 0."""
    told = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("label"))
    return stats.select(F.col(id_col).alias("_id"), "x").where(crc_mod("_id", folds) != 0).join(told, "_id").select("x", "label")


def score_column(model: Discriminant | None, x: str = "x"):
    """The score of a column of statistics."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(vectors: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(vectors.to_numpy()))) if len(vectors) else pd.Series([], dtype=float)

    return scored(F.col(x))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """Per row of ``docs``: its id, held_out, score and predicted."""
    stats = cut(with_statistics(docs.select(id_col, F.col(text).alias("_text")), "_text").select(id_col, "x"))
    model = fit_discriminant(training_rows(stats, labels, label, id_col, folds))
    scored = stats.withColumn("score", score_column(model))
    return scored.select(id_col, (crc_mod(id_col, folds) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of class 1; columns may have any names, texts are not moved.

    To fit, only texts are measured that may have a label.
    """
    told = labels.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    wanted = HashFilter.of(told, labels.count())

    @F.pandas_udf("array<double>")
    def measured(h: pd.Series, texts: pd.Series) -> pd.Series:  # one function filters and measures, so that no second worker is chained
        maybe = wanted.maybe(h.to_numpy(dtype=np.int64).view(np.uint64))
        return pd.Series([statistics(t) if m else None for t, m in zip(texts, maybe, strict=True)], dtype=object)

    some = docs.select(F.col(id_col).alias("_id"), measured.asNondeterministic()(F.xxhash64(F.col(id_col).cast("string")), text_bytes(text)).alias("x")).where("x is not null")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    model = fit_discriminant(training_rows(some, known, "_label", "_id"))
    scored = with_statistics(docs.select(whole_rows(docs), F.col(text).alias("_text")), "_text", "_x").withColumn("_score", score_column(model, "_x"))
    return scored.where(F.col("_score") >= THRESHOLD).select("_row.*")
