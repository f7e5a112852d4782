"""Toxicity by class-conditional Kneser-Ney models.

A model of each class, toxic and ordinary, spells words character by character: the context h of a character x is what precedes
it in its word, up to `ORDER` - 1 characters with the word's begin. With n_c(h, x) documents of class c whose words hold x after
h, N_c(h) their sum over x, and T_c(h) the number of different x,

    P_c(x | h) = (max(n_c(h, x) - D, 0) + D T_c(h) P(x | h)) / N_c(h)

backs off to counts that both classes share: P(x | h) is the same estimate of the classes' summed counts, which in turn backs
off to the share of contexts that x has been seen in (its continuation count). A rare expression is so estimated alike in both
classes and says nothing; a context that no toxic document has is left to the shared estimate in both.

A word's log-likelihood ratio is the sum over its characters. A text is described by length-normalised comparisons of the two
likelihoods (see `described`), and a logistic curve, fitted on labelled rows scored without their own counts, makes the score.

Counts are gathered from every labelled training row, in two passes: contexts of toxic documents first, then everything seen in
those contexts. The curve is fitted on about `SAMPLE` labelled rows, picked by a hash of their id.

No context is left out. Tasks hold the `CAPACITY` contexts of the most toxic documents, at most. With more, the others stay in tables:
every different word is scored once, by what tasks hold and by a join with the others for what they don't; a document's frequent
words are then looked up in its task (`FREQUENT` of them), and its other words are joined.

Defined cases: a null text is empty; a text without words, or a corpus without labelled rows of both classes, scores `EMPTY` or
the curve's value for no evidence; labels that are null don't count; an id that is labelled twice counts for each of its labels;
repeated rows are scored alike; other columns pass through, and one named like an output is replaced.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwarrant.llm.shared import stored

ORDER = 8  # characters of a context and the one it predicts
DISCOUNT = 0.9  # of a class's counts
SHARED_DISCOUNT = 0.75
CLEAR = 1.5  # a word's ratio counts as evidence above this
CAPACITY = 1_000_000  # contexts that a task holds
FREQUENT = 500_000  # words that a task looks up
SAMPLE = 8_000  # labelled rows
BROADCAST_ROWS = 1_000_000  # labels, 16 bytes each
MEMO = 200_000  # words a task remembers
EMPTY = 0.0
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def spelled(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the characters of all words, ends included: digest of the context, digest of context and character; and the places
    where the words begin."""
    text = np.frombuffer("".join([f"\x02{w}\x03" for w in found]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = text == 2
    since = np.arange(len(text)) - np.maximum.accumulate(np.where(begin, np.arange(len(text)), 0))
    context = np.zeros(len(text), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(1, ORDER):
            shifted = np.zeros_like(text)
            shifted[back:] = text[:-back]
            context = np.where(since >= back, context * _MIX + shifted + np.uint64(back), context)
        context ^= context >> np.uint64(29)
        pair = (context + text * np.uint64(0xD6E8FEB86659FD93)) * _MIX
        pair ^= pair >> np.uint64(32)
    inside = ~begin
    starts = np.cumsum(inside)[np.flatnonzero(begin)]
    return context[inside].view(np.int64), pair[inside].view(np.int64), starts


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    """Sorted digests of contexts and of context with character, with their counts of ordinary (0) and toxic (1) documents."""

    contexts: np.ndarray
    totals: np.ndarray  # [context, class]
    types: np.ndarray  # [context, class]
    kinds: np.ndarray  # different characters after the context, both classes
    pairs: np.ndarray
    counts: np.ndarray  # [pair, class]
    seen_after: np.ndarray  # per pair: share of contexts its character is seen in
    parents: np.ndarray  # per pair: place of its context
    weights: np.ndarray | None = None
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None
    rest: tuple[DataFrame, DataFrame] | None = None  # (context, other) and (pair, ratio) of the contexts that aren't held

    def plain(self) -> dict:
        """What tasks get: arrays only, so that they can be read where this package isn't installed."""
        return {name: own for name, own in vars(self).items() if name != "rest"}

    def ratios(self, context: np.ndarray, pair: np.ndarray, own: int | None = None) -> np.ndarray:
        """Log of P_1 / P_0 for every character; `own`: as if one document of that class had not been counted."""
        at, known = _find(self.contexts, context)
        to, met = _find(self.pairs, pair)
        n = np.where(met[:, None], self.counts[to] if len(self.pairs) else 0, 0).astype(float)
        total, kinds = self.totals[at].astype(float), self.types[at].astype(float)
        if own is not None:
            kinds[:, own] -= n[:, own] == 1
            n[:, own] = np.maximum(0, n[:, own] - 1)
            total[:, own] -= 1
        base = np.where(met, self.seen_after[to] if len(self.pairs) else 0, 1e-6)
        both = np.maximum(1, total.sum(1))
        shared = (np.maximum(n.sum(1) - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * self.kinds[at] * base) / both
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * shared[:, None]) / total, shared[:, None])
        return np.where(known & (total[:, 1] > 0), np.log(np.maximum(p[:, 1], 1e-12) / np.maximum(p[:, 0], 1e-12)), 0.0)

    def of_words(self, found: list[str], own: int | None = None) -> np.ndarray:
        if not found or not len(self.contexts):
            return np.zeros(len(found))
        context, pair, starts = spelled(found)
        return summed(self.ratios(context, pair, own), starts)

    def scorer(self) -> Scorer:
        """The log ratios worked out: of every pair, and of any other character after a context."""
        else_ = self.ratios(self.contexts, np.zeros(len(self.contexts), np.int64) - 1)
        of = self.ratios(self.contexts[self.parents], self.pairs) if len(self.pairs) else np.zeros(0)
        return Scorer(self.contexts, else_.astype(np.float32), self.pairs, of.astype(np.float32), self.weights, self.middle, self.spread)


@dataclass
class Scorer:
    """What scoring needs of a model."""

    contexts: np.ndarray
    otherwise: np.ndarray
    pairs: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray | None
    middle: np.ndarray | None
    spread: np.ndarray | None

    def of_words(self, found: list[str]) -> np.ndarray:
        if not found or not len(self.contexts):
            return np.zeros(len(found))
        context, pair, starts = spelled(found)
        at, known = _find(self.contexts, context)
        out = np.where(known, self.otherwise[at], 0).astype(float)
        if len(self.pairs):
            to, met = _find(self.pairs, pair)
            out = np.where(met, self.ratios[to], out)
        return summed(out, starts)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), EMPTY)
        z = (features - self.middle) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def described(ratios: np.ndarray) -> list[float]:
    """Length-normalised evidence of a text from its words' ratios: clear evidence per word and its root, the whole comparison
    per word with each word's part held within 3, and how much clear evidence there is."""
    if not len(ratios):
        return [0.0, 0.0, 0.0, 0.0]
    clear = np.maximum(ratios - CLEAR, 0)
    mean = float(clear.mean())
    return [mean, mean**0.5, float(np.clip(ratios, -3, 3).mean()), float(np.log1p(clear.sum()))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last one is constant), middle and spread of a logistic fit by Newton's method."""
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), ridge * np.append(np.ones(x.shape[1]), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w, middle, spread


def _counted(docs: DataFrame, text: str, shared: Broadcast | None) -> DataFrame:
    """context, pair, letter, n0, n1: documents whose words hold the pair; with `shared`, of those contexts only. Every task sums
    up before anything is shuffled."""

    def flush(seen: dict[str, list[int]]) -> pa.RecordBatch:
        found = list(seen)
        context, pair, starts = spelled(found)
        sizes = np.diff(np.append(starts, len(pair)))
        n = np.repeat(np.array(list(seen.values()), np.int64).reshape(-1, 2), sizes, axis=0)
        letters = np.frombuffer("".join([f"{w}\x03" for w in found]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        if shared is not None:
            keep = _find(shared.value, context)[1]
            context, pair, letters, n = context[keep], pair[keep], letters[keep], n[keep]
        _, first, group = np.unique(pair, return_index=True, return_inverse=True)
        sums = [np.bincount(group, n[:, k], len(first)).astype(np.int64) for k in (0, 1)]
        names = ("context", "pair", "letter", "n0", "n1")
        return pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, (context[first], pair[first], letters[first], *sums)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for value, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for w in set(words(value.as_py())):
                    seen.setdefault(w, [0, 0])[y] += 1
                if len(seen) > MEMO:
                    yield flush(seen)
                    seen = {}
        if seen:
            yield flush(seen)

    rows = docs.select(text, "_label").mapInArrow(run, "context long, pair long, letter int, n0 long, n1 long")
    return rows.groupBy("context", "pair", "letter").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """`key`, `text` and `_label` of the documents that `labels` covers."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return docs.select(key, text).join(own, F.col(key) == F.col("_key")).drop("_key")


def _model(contexts: np.ndarray, pairs: pa.Table, letters: pa.Table | None = None) -> Model:
    """Of sorted contexts, everything that was counted in them, and how many pairs each letter has in all (without it: in `pairs`)."""
    context, pair, letter = (pairs.column(i).to_numpy() for i in range(3))
    counts = np.stack([pairs.column(i).to_numpy() for i in (3, 4)], 1).reshape(-1, 2)
    order = np.argsort(pair)
    pair, context, letter, counts = pair[order], context[order], letter[order], counts[order]
    at = np.searchsorted(contexts, context)
    totals, types = (np.stack([np.bincount(at, v[:, k], len(contexts)) for k in (0, 1)], 1) for v in (counts, counts > 0))
    if letters is None:
        _, group, seen = np.unique(letter, return_inverse=True, return_counts=True)
        after = (seen / max(1, len(letter)))[group] if len(letter) else np.zeros(0)
    else:
        kind, seen = (c.to_numpy() for c in letters.sort_by("letter").columns)
        after = (seen / max(1, seen.sum()))[np.searchsorted(kind, letter)]
    small = (x.astype(np.int32) for x in (totals, types, np.bincount(at, minlength=len(contexts)), counts, at))
    totals, types, kinds, counts, parents = small
    return Model(contexts, totals, types, kinds, pair, counts, after.astype(np.float32), parents)


def _rest_ratios(every: DataFrame, letters: pa.Table) -> tuple[DataFrame, DataFrame]:
    """`Scorer`'s ratios of the contexts that aren't held: (context, other) and (pair, ratio)."""
    pairs = every.where("not held")
    each = [F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count_if(F.col("n0") > 0).alias("k0"), F.count_if(F.col("n1") > 0).alias("k1")]
    sums = stored(pairs.groupBy("context").agg(*each, F.count("*").alias("kinds")))

    def ratio(n0: Column, n1: Column, base: Column) -> Column:
        shared = (F.greatest(n0 + n1 - SHARED_DISCOUNT, F.lit(0.0)) + SHARED_DISCOUNT * F.col("kinds") * base) / F.greatest(F.lit(1), F.col("t0") + F.col("t1"))
        p = lambda n, t, k: F.greatest(F.when(F.col(t) > 0, (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(k) * shared) / F.col(t)).otherwise(shared), F.lit(1e-12))
        return F.when(F.col("t1") > 0, F.log(p(n1, "t1", "k1") / p(n0, "t0", "k0"))).otherwise(0.0).cast("float")

    other = sums.select("context", ratio(F.lit(0.0), F.lit(0.0), F.lit(1e-6)).alias("other"))
    all_pairs = max(1, sum(letters.column("seen").to_pylist()))
    share = every.sparkSession.createDataFrame(letters.to_pandas(), "letter int, seen long").select("letter", (F.col("seen") / all_pairs).cast("float").cast("double").alias("base"))
    of = pairs.join(F.broadcast(share), "letter").join(sums, "context").select("pair", ratio(F.col("n0"), F.col("n1"), F.col("base")).alias("ratio"))
    return stored(other), stored(of)


def _contexts_of(docs: DataFrame, text: str) -> DataFrame:
    """The different contexts in the words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(set().union(*[words(value.as_py()) for value in batch.column(0)]))
            yield pa.RecordBatch.from_pydict({"context": np.unique(spelled(found)[0]) if found else pa.array([], pa.int64())})

    return docs.select(text).mapInArrow(run, "context long").distinct()


def _digests(word: Column) -> list[Column]:
    return [F.xxhash64(word).alias("w1"), F.xxhash64(F.lit(1), word).alias("w2")]


def _word_ratios(docs: DataFrame, model: Model, scorer: Broadcast, text: str) -> DataFrame:
    """word, w1 and w2 (its digests), n (its occurrences) and ratio, of all different words of `docs`."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        flush = lambda: pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
        for batch in batches:
            for value in batch.column(0):
                for w in words(value.as_py()):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) > MEMO:
                    yield flush()
                    seen = {}
        yield flush()

    every = docs.select(text).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    every = stored(every.select("word", "n", *_digests(F.col("word"))))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each word what the held contexts give, without a context; and the places in other contexts."""
        held = Scorer(**scorer.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = part.column(0).to_pylist()
                context, pair, starts = spelled(found)
                of = np.repeat(np.arange(len(found)), np.diff(np.append(starts, len(pair))))
                at = np.flatnonzero(~_find(held.contexts, context)[1])
                w1, w2 = (part.column(i).to_numpy() for i in (1, 2))
                sums = held.of_words(found)
                arrays = [np.append(w1, w1[of[at]]), np.append(w2, w2[of[at]])]
                blank = pa.nulls(len(found), pa.int64())
                keys = [pa.concat_arrays([blank, pa.array(v[at], pa.int64())]) for v in (context, pair)]
                held_part = pa.concat_arrays([pa.array(sums, pa.float64()), pa.nulls(len(at), pa.float64())])
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0]), pa.array(arrays[1]), *keys, held_part], ["w1", "w2", "context", "pair", "held"])

    other, of = model.rest
    split = stored(every.select("word", "w1", "w2").mapInArrow(parts, "w1 long, w2 long, context long, pair long, held double"))
    joined = split.where("context is not null").drop("held").join(other, "context").join(of, "pair", "left")
    added = joined.select("w1", "w2", F.coalesce("ratio", "other").cast("double").alias("part"))
    sums = split.where("context is null").select("w1", "w2", F.col("held").alias("part")).unionByName(added).groupBy("w1", "w2").agg(F.sum("part").alias("ratio"))
    return stored(every.join(sums, ["w1", "w2"]))


def _score_by_words(docs: DataFrame, model: Model, text: str, out: str, drop_text: bool) -> DataFrame:
    """`score` by a table of word ratios. Documents of the same text (by two digests) are one."""
    spark_ = docs.sparkSession.sparkContext
    scorer = model.scorer()
    ratios = _word_ratios(docs, model, spark_.broadcast(dict(vars(scorer))), text)
    frequent = ratios.orderBy(F.desc("n"), "w1", "w2").limit(FREQUENT).select("word", "ratio").toArrow()
    shared = spark_.broadcast(frequent)
    own = [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), F.col(text)).alias("_k2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text what its frequent words give, without a word; and its other words with their numbers."""
        known = dict(zip(*(c.to_pylist() for c in shared.value.columns)))
        for batch in batches:
            for k1, k2, value in zip(*(c.to_pylist() for c in batch.columns)):
                found = words(value)
                here = np.array([known[w] for w in found if w in known])
                rest: dict[str, int] = {}
                for w in found:
                    if w not in known:
                        rest[w] = rest.get(w, 0) + 1
                n = 1 + len(rest)
                names = {"_k1": pa.array([k1] * n, pa.int64()), "_k2": pa.array([k2] * n, pa.int64()), "word": pa.array([None, *rest], pa.string()), "n": pa.array([len(here), *rest.values()], pa.int64())}
                sums = [[float(v.sum()), *[None] * len(rest)] for v in (np.maximum(here - CLEAR, 0), np.clip(here, -3, 3))]
                yield pa.RecordBatch.from_pydict(names | {"clear": pa.array(sums[0], pa.float64()), "held": pa.array(sums[1], pa.float64())})

    split = stored(docs.select(*own, text).mapInArrow(run, "_k1 long, _k2 long, word string, n long, clear double, held double"))
    rest = split.where("word is not null").select("_k1", "_k2", "n", *_digests(F.col("word"))).join(ratios.select("w1", "w2", "ratio"), ["w1", "w2"])
    rest = rest.select("_k1", "_k2", "n", (F.col("n") * F.greatest(F.col("ratio") - CLEAR, F.lit(0.0))).alias("clear"), (F.col("n") * F.greatest(F.least("ratio", F.lit(3.0)), F.lit(-3.0))).alias("held"))
    every = split.where("word is null").select("*", F.lit(1).alias("texts")).drop("word").unionByName(rest.withColumn("texts", F.lit(0)))
    # A text that stands in several rows has been summed as often.
    sums = every.groupBy("_k1", "_k2").agg(*[(F.sum(c) / F.sum("texts")).alias(c) for c in ("n", "clear", "held")])
    # As `described` and `Scorer.score` have it.
    mean = F.coalesce(F.try_divide("clear", "n"), F.lit(0.0))
    features = [mean, F.sqrt(mean), F.coalesce(F.try_divide("held", "n"), F.lit(0.0)), F.log1p("clear")]
    z = F.lit(float(scorer.weights[-1]))
    for f, middle, spread, w in zip(features, scorer.middle, scorer.spread, scorer.weights):
        z = z + (f - float(middle)) / float(spread) * float(w)
    scored = sums.select("_k1", "_k2", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))).alias("_score"))
    kept = [f.name for f in docs.schema.fields if f.name != out and not (drop_text and f.name == text)]
    keyed = docs.select(*own, *[F.col(f"`{n}`") for n in kept])
    return keyed.join(scored, ["_k1", "_k2"]).select(*[F.col(f"`{n}`") for n in kept], F.col("_score").alias(out))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the rows of `labels`; rows to be held out have to be left out of it."""
    own = labelled(docs, labels, key, text, label)
    toxic = _counted(own.where("_label = 1"), text, None)
    sizes = stored(toxic.groupBy("context").agg(F.sum("n1").alias("n")))
    by_size = sizes.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("contexts")).orderBy(F.desc("n")).collect()  # 10,000 rows at most
    least, room = 1, CAPACITY
    for row in by_size:
        room -= row.contexts
        if room < 0:
            least = row.n + 1
            break
    kept = sizes.where(F.col("n") >= least).select("context").toArrow()
    contexts = np.sort(kept.column(0).to_numpy())
    spark_ = docs.sparkSession.sparkContext
    every = None
    if room >= 0:
        shared = spark_.broadcast(contexts)
        model = _model(contexts, _counted(own, text, shared).toArrow())
        shared.destroy()
    else:
        every = stored(_counted(own, text, None).join(sizes, "context").select("context", "pair", "letter", "n0", "n1", (F.col("n") >= least).alias("held")))
        letters = every.groupBy("letter").agg(F.count("*").alias("seen")).toArrow()  # a row for each character
        model = _model(contexts, every.where("held").drop("held").toArrow(), letters)
        model.rest = _rest_ratios(every, letters)
    total = own.groupBy("_label").count().collect()
    if len(total) < 2:
        return model
    share = min(1.0, SAMPLE / sum(r["count"] for r in total))
    picked = own.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = model
    if every is not None:  # all that was counted in the contexts of the picked rows
        wanted = stored(_contexts_of(picked, text))
        fitted = _model(np.sort(every.join(wanted, "context", "left_semi").select("context").distinct().toArrow().column(0).to_numpy()), every.join(wanted, "context", "left_semi").drop("held").toArrow(), letters)
    shared = spark_.broadcast(fitted.plain())
    rows = described_rows(picked, shared, text).toArrow()
    shared.destroy()
    x, y = np.array(rows.column("_features").to_pylist(), float).reshape(-1, 4), np.array(rows.column("_label").to_pylist(), float)
    if 0 < y.sum() < len(y):
        model.weights, model.middle, model.spread = logistic(x, y)
    return model


def described_rows(docs: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """`_label` and `_features`, each row scored as if it had not been counted itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            ys, out = batch.column(1).to_pylist(), []
            for value, y in zip(batch.column(0), ys):
                found = words(value.as_py())
                kinds = list(set(found))
                ratio = dict(zip(kinds, model.of_words(kinds, y)))
                out.append(described(np.array([ratio[w] for w in found])))
            yield pa.RecordBatch.from_pydict({"_label": pa.array(ys, pa.int32()), "_features": pa.array(out, pa.list_(pa.float64()))})

    return docs.select(text, "_label").mapInArrow(run, "_label int, _features array<double>")


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", drop_text: bool = False) -> DataFrame:
    """Add the toxicity score, 0 to 1, to every row."""
    if model.rest is not None and model.weights is not None:
        return _score_by_words(docs, model, text, out, drop_text)
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model.scorer())))
    kept = [f for f in docs.schema.fields if f.name != out and not (drop_text and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = Scorer(**shared.value), {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [words(x.as_py()) for x in part.column(text)]
                if len(memo) > MEMO:
                    memo = {}
                new = [w for w in set().union(*texts) if w not in memo]
                memo.update(zip(new, model.of_words(new).tolist()))
                ratio = memo.__getitem__
                features = np.array([described(np.array(list(map(ratio, found)))) for found in texts])
                columns = {f.name: part.column(f.name) for f in kept}
                yield pa.RecordBatch.from_pydict(columns | {out: pa.array(model.score(features), pa.float64())})

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in `fold`."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def remove(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score stays below `threshold`, scored by a model of the labelled ones."""
    model = train(docs, labels, key, text)
    return score(docs, model, text, "_toxicity").where(F.col("_toxicity") < threshold).drop("_toxicity")
