"""Quality by Bradley-Terry pairwise ranking.

Every document has a strength s = w . f over surface features f of its text. In a pair of a labelled good and a labelled bad
document the good one is preferred with probability 1 / (1 + exp(s_bad - s_good)); w maximises the likelihood of the pairs, a
logistic loss on feature differences, by Newton's method. The strengths are then cut at a quantile: that share of the labelled
rows which is bad lies below it, and the score is the logistic curve of the distance to the cut.

The fit sees about `SAMPLE` labelled rows at most, picked by a hash of their id (all, if there are fewer), and `PAIRS` partners for
each row of the rarer class; scoring reads whole texts and needs no shuffle.

Defined cases: a null text is empty, whose features are all zero; without labelled rows of both classes every score is 0.5; null
labels and ids don't count; repeated rows are scored alike; other columns pass through, one named like the output is replaced.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 12_000  # labelled rows
PAIRS = 12
RIDGE = 1e-2
GROUPS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9), "line": (10, 13), "stop": (46, 44, 59, 58),
    "shout": (33, 63), "pipe": (124,), "symbol": tuple(map(ord, "#$%&*@~^=+<>\\/_`")), "bracket": tuple(map(ord, "()[]{}")), "quote": (34, 39, 45),
    "control": [*range(9), 11, 12, *range(14, 32)], "high": range(128, 256),
}
KIND = np.full(256, len(GROUPS), np.uint8)
for _i, _g in enumerate(GROUPS.values()):
    KIND[list(_g)] = _i
WIDTH = len(GROUPS) + 12
BLOCK = 1 << 20  # bytes of a text that are compressed at once


def features(text: str | None) -> list[float]:
    """Shares of kinds of characters, and how long, varied and repetitive words, lines and bytes are."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * WIDTH
    share = np.bincount(KIND[np.frombuffer(raw, np.uint8)], minlength=len(GROUPS) + 1) / len(raw)
    words, lines = text.split(), text.split("\n")
    n, kinds = max(1, len(words)), len(set(words))
    packed = sum(len(zlib.compress(raw[i : i + BLOCK], 1)) for i in range(0, len(raw), BLOCK))
    letters = share[0] + share[1] + share[12]
    own = [
        *np.sqrt(share),
        np.log1p(n), np.log1p(len(raw) / n), kinds / n, np.log(kinds + 1.0) / np.log(n + 1.0), len(set(lines)) / len(lines),
        np.log1p(len(raw) / len(lines)), packed / (len(raw) + 20), share[1] / (letters + 0.01), sum(w[-1] in ".!?" for w in words) / n,
        sum(map(str.istitle, words)) / n, sum(map(str.isalpha, words)) / n,
    ]
    return [float(x) for x in own]


def expanded(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, held within 5 deviations."""
    z = np.clip((x - middle) / spread, -5, 5)
    return np.hstack([z, z * z])


def fit_pairs(good: np.ndarray, bad: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Weights from preference pairs; every row of the rarer class meets `PAIRS` rows of the other."""
    n = PAIRS * min(len(good), len(bad))
    d = good[_dealt(len(good), n, rng)] - bad[_dealt(len(bad), n, rng)]
    w = np.zeros(d.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the other outcome
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w)), d.T @ p / n - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dealt(rows: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """`n` places among `rows`, each nearly as often as any other."""
    return np.concatenate([rng.permutation(rows) for _ in range(-(-n // rows))])[:n]


def featured(docs: DataFrame, text: str, out: str = "_features") -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(text)]
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {out: pa.array(found, pa.list_(pa.float64()))})

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple | None:
    """(middle, spread, weights, cut), fitted on the rows of `labels`; None without both classes. Held-out rows have to be left out."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    share = min(1.0, SAMPLE / max(1, own.count()))
    picked = own.where(F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The sample is bounded, so it may be broadcast to the scan of the documents.
    rows = featured(docs.select(key, text).join(F.broadcast(picked), F.col(key) == F.col("_key")).select("_key", "_label", text), text)
    got = rows.toArrow()
    order = np.argsort(got.column("_key").to_numpy(), kind="stable")
    x = np.array(got.column("_features").to_pylist(), float).reshape(-1, WIDTH)[order]
    y = got.column("_label").to_numpy()[order]
    if not 0 < y.sum() < len(y):
        return None
    middle, spread = x.mean(0), x.std(0) + 1e-6
    z = expanded(x, middle, spread)
    w = fit_pairs(z[y == 1], z[y == 0], np.random.default_rng(6))
    strength = z @ w
    return middle, spread, w, float(np.quantile(strength, (y == 0).mean()))


def score(docs: DataFrame, model: tuple | None, text: str = "text", out: str = "score", drop_text: bool = False) -> DataFrame:
    """Add the quality score, 0 to 1, to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != out and not (drop_text and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(text)], float).reshape(-1, WIDTH)
            if shared.value is None:
                found = np.full(len(x), 0.5)
            else:
                middle, spread, w, cut = shared.value
                found = 1 / (1 + np.exp(-np.clip(expanded(x, middle, spread) @ w - cut, -40, 40)))
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {out: pa.array(found, pa.float64())})

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
