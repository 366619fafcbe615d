"""Mixing to target weights: a classifier gives each document soft membership of domains, and projected gradient descent
fits nonnegative document rates whose expected domain token totals match the targets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import bound_batches, discard, materialise, word_hashes

#: Word features are hashed into so many buckets; shape features come after them.
BUCKETS, SHAPES = 1 << 20, 64
#: A feature may speak only if its share in some domain lies so many standard errors off its share in all; the most telling
#: ones do, at most so many.
Z, MOST_FEATURES = 4.0, 4096
#: Labelled rows that train the classifier, at most: those whose ids have the least hashes.
TRAIN_ROWS = 8000
#: Steps of the classifier's training and its penalty on squared weights.
STEPS, PENALTY = 200, 1e-4
#: Gradient steps at most, and the share of the budget by which a domain may miss its target and still count as met.
ITERATIONS, TOLERANCE = 80, 0.002
#: Documents whose posteriors round to the same multiples of 1 / GRAIN share a rate; all totals are of their exact posteriors.
GRAIN = 256
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!")] = True


def features(text: str | None) -> tuple[int, np.ndarray]:
    """Words of the text, and its distinct features: hashed lower-cased words and binned shares of the text's shape."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts, _, words = word_hashes(data.translate(_LOWER))
    n = len(starts)
    if not n:
        return 0, np.array([BUCKETS], np.int64)
    b = np.frombuffer(data, np.uint8)
    distinct = np.unique(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = (
        int(_SYMBOL[b].sum()) / n,
        1 - len(distinct) / n,
        int(((b >= 65) & (b <= 90)).sum()) / len(b),
        1 - len(set(lines)) / len(lines),
    )
    bins = [min(9, int(10 * s)) for s in shares]
    shape = [BUCKETS + 1 + 10 * i + x for i, x in enumerate(bins)] + [BUCKETS + 42 + min(20, int(math.log2(n)))]
    return n, np.concatenate((np.unique(distinct % np.uint64(BUCKETS)).astype(np.int64), shape))


@dataclass(frozen=True)
class Classifier:
    """Multinomial logistic regression: weights (features, domains) of the ``features`` that speak, sorted, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return self.bias
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return self.weights[at[self.features[at] == found]].sum(0) + self.bias


def fit_classifier(labelled: DataFrame, domains: list[str], text: str = "text", label: str = "domain") -> Classifier:
    """Train on all rows given, of which there must be few enough (see labelled_texts) for the driver to hold MOST_FEATURES a row.

    Spark counts features by domain and picks those that tell domains apart; the driver gets the rows' picked features
    only and descends by gradient. Rows whose label isn't in ``domains`` are left out. With no rows all domains are alike.
    """
    place = F.array_position(F.array(*map(F.lit, domains)), F.col(label)).cast("int") - 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [features(x)[1].tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["k", "f"])

    rows = labelled.filter(F.col(label).isin(domains)).select(place.alias("k"), text).mapInArrow(batches, "k int, f array<long>")
    rows = materialise(rows, "labelled-features")
    sizes = dict(rows.groupBy("k").count().collect())
    size = np.array([sizes.get(k, 0) for k in range(len(domains))], float)
    none = Classifier(np.zeros(0, np.int64), np.zeros((0, len(domains))), np.zeros(len(domains)))
    if not size.sum():
        return none
    each = rows.select("k", F.explode("f").alias("f")).groupBy("f", "k").agg(F.count(F.lit(1)).alias("n"))
    sums = each.groupBy("f").agg(F.sum("n").alias("all"), *[F.coalesce(F.max(F.when(F.col("k") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(len(domains))])
    share_all = (F.col("all") + 0.5) / (float(size.sum()) + 1)
    off = [F.abs((F.col(f"n{i}") + 2 * share_all) / (float(n) + 2) - share_all) / F.sqrt(F.greatest(share_all * (1 - share_all), F.lit(1e-12)) / max(float(n), 1.0)) for i, n in enumerate(size)]
    telling = sums.filter("all >= 5").select("f", F.greatest(*off).alias("z")).filter(F.col("z") > Z).orderBy(F.col("z").desc(), "f").limit(MOST_FEATURES)
    chosen = np.sort(np.array([r[0] for r in telling.collect()], np.int64))
    if not len(chosen):
        return Classifier(none.features, none.weights, np.log((size + 1) / (size.sum() + len(domains))))

    def picked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [np.flatnonzero(np.isin(chosen, x)).tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["k", "f"])

    few = rows.mapInArrow(picked, "k int, f array<int>").collect()
    discard(rows)
    return Classifier(chosen, *_descend(np.array([r.k for r in few]), [r.f for r in few], len(chosen), len(domains)))


def _descend(labels: np.ndarray, found: list[list[int]], n_features: int, n_domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by full-batch gradient steps, each coordinate's step shrinking with the gradients it has seen."""
    row, at = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([x for f in found for x in f], np.int64)
    truth = np.eye(n_domains)[labels]
    weights, bias = np.zeros((n_features, n_domains)), np.log((truth.sum(0) + 1) / (len(found) + n_domains))
    seen_w, seen_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(STEPS):
        s = np.stack([np.bincount(row, weights[at, k], len(found)) for k in range(n_domains)], 1) + bias
        p = np.exp(s - s.max(1, keepdims=True))
        error = p / p.sum(1, keepdims=True) - truth
        g = np.stack([np.bincount(at, error[row, k], n_features) for k in range(n_domains)], 1) / len(found) + PENALTY * weights
        h = error.mean(0)
        seen_w += g * g
        seen_b += h * h
        weights -= 0.3 * g / np.sqrt(seen_w)
        bias -= 0.1 * h / np.sqrt(seen_b)
    return weights, bias


def posteriors(docs: DataFrame, model: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``n_tokens`` (words) and ``p``, the posterior of each domain."""
    names = [*keep, "n_tokens", "p"]
    sent = keep if text in keep else [*keep, text]
    at = sent.index(text)

    def one(body: str | None) -> tuple[int, list[float]]:
        n, found = features(body)
        s = model.scores(found)
        p = np.exp(s - s.max())
        return n, (p / p.sum()).tolist()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [one(x) for x in b.column(at).to_pylist()]
            n, p = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names)

    schema = StructType([docs.schema[c] for c in keep] + [StructField("n_tokens", LongType()), StructField("p", ArrayType(DoubleType()))])
    return bound_batches(docs).select(sent).mapInArrow(batches, schema)


def _grain() -> Column:
    return F.transform("p", lambda x: F.floor(x * GRAIN + 0.5) / GRAIN)


def _floor(whole: int | None) -> Column:
    """The least rate of a document: 1 where its likeliest domain is ``whole``, else 0."""
    return F.lit(0.0) if whole is None else F.when(F.element_at("p", whole + 1) >= F.array_max("p"), 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Rates:
    """Rates of rounded posteriors after gradient steps from rate one, each projected onto a row's floor and ``most``.

    A step is a gap for each domain and its momentum: the point moves against the gaps of its posteriors to the new rate,
    and the next point lies ahead of that by the momentum times the last move.
    """

    steps: list[list[float]]
    most: float

    def of(self, grain: np.ndarray, floor: np.ndarray, ahead: bool = False) -> np.ndarray:
        """The rates, or, if ``ahead``, the points that the next gradient is taken at."""
        x = y = np.ones(len(grain))
        for *gaps, momentum in self.steps:
            new = np.minimum(self.most, np.maximum(floor, y - grain @ np.array(gaps)))
            x, y = new, new + momentum * (new - x)
        return y if ahead else x

    def add(self, rows: DataFrame, whole: int | None) -> DataFrame:
        """``rows`` (with p) and their ``rate``."""
        names = [*rows.columns, "rate"]

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                rate = self.of(_matrix(b.column(b.num_columns - 2)), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(rate)], names)

        schema = StructType([*rows.schema.fields, StructField("rate", DoubleType())])
        return rows.select("*", _grain().alias("_grain"), _floor(whole).alias("_floor")).mapInArrow(batches, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_rates(rows: DataFrame, targets: list[float], most: float, whole: int | None = None, iterations: int = ITERATIONS, close: float = 1e-5) -> tuple[Rates, list[float]]:
    """Rates of ``rows`` (n_tokens, p) whose expected tokens in each domain match ``targets``, in tokens.

    Rows whose posteriors round alike share their rate throughout, so they are met as one with their exact tokens of each domain.
    Minimises the squared gaps, each relative to its domain's supply, over rates within their bounds by projected gradient
    descent with momentum from rate one. A document's gradient is its posteriors times the domain gaps, so an iteration is one
    aggregation to as many sums as there are domains; the driver keeps the steps and each task replays them for its rows.
    Momentum starts anew whenever the gaps grow. It stops when no gap moves by more than ``close`` of its supply, or after
    ``iterations``. Returns the rates and the totals reached, which the caller holds against the targets.
    """
    k = len(targets)
    mass = [F.sum(F.col("n_tokens") * F.element_at("p", i + 1)).alias(f"m{i}") for i in range(k)]
    by_grain = rows.groupBy(_grain().alias("grain"), _floor(whole).alias("floor")).agg(*mass)
    alike = materialise(by_grain.select("grain", "floor", F.array(*[f"m{i}" for i in range(k)]).alias("m")), "posterior-groups")

    def totals(rates: Rates, ahead: bool) -> list[float]:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    sums = rates.of(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), ahead) @ _matrix(b.column(2))
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], [f"t{i}" for i in range(k)])

        got = alike.mapInArrow(batches, ", ".join(f"t{i} double" for i in range(k)))
        return [float(x or 0.0) for x in got.agg(*[F.sum(f"t{i}") for i in range(k)]).first()]

    supply = totals(Rates([], most), False)
    steps: list[list[float]] = []
    now, loss, pace = supply, math.inf, 1.0
    for _ in range(iterations):
        gaps = [(a - b) / s if s else 0.0 for a, b, s in zip(now, targets, supply, strict=True)]
        last, loss = loss, sum(g * g * s for g, s in zip(gaps, supply, strict=True))
        if loss > last:
            pace = 1.0
        ahead = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        steps.append([*gaps, (pace - 1) / ahead])
        pace = ahead
        before, now = now, totals(Rates(steps, most), True)
        if all(abs(a - b) <= close * s for a, b, s in zip(now, before, supply, strict=True)):
            break
    rates = Rates(steps, most)
    reached = totals(rates, False)
    discard(alike)
    return rates, reached


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], keep: list[str],
    most: float, whole: str | None = None, text: str = "text", label: str = "domain",
) -> DataFrame:
    """``keep``, n_tokens, p, rate, copies, gaps and on_target for every row of ``docs``.

    ``weights`` are the domains' target shares of tokens. The budget is the corpus's tokens, or, if ``whole`` names a
    domain, as much as uses that domain's whole supply, and documents likeliest of that domain get a rate of one at least. ``copies``
    rounds the rate down or up by a hash of the first key, so its expectation is the rate. ``gaps`` are the expected tokens
    reached less the target of each domain, as shares of the budget: bounds on rates can keep a target out of reach, and then
    ``on_target`` is false.

    Null and empty texts have no tokens, so their rate moves with their posteriors alone; a very long text is hashed a block at a
    time; with no labelled rows every posterior is the same and the rates stay near one; repeated rows each get a row; an empty
    table gives an empty result. Names in ``keep`` may not be those of the columns added; other columns are ignored.
    """
    if clash := set(keep) & {"n_tokens", "p", "rate", "copies", "gaps", "on_target"}:
        raise ValueError(f"{sorted(clash)} would be overwritten")
    domains = list(weights)
    rows = materialise(posteriors(docs, fit_classifier(labelled, domains, text, label), keep, text), "posteriors")
    supply = rows.agg(*[F.sum(F.col("n_tokens") * F.element_at("p", i + 1)) for i in range(len(domains))]).first()
    supply = [float(x or 0) for x in supply]
    share = [weights[d] / sum(weights.values()) for d in domains]
    budget = supply[domains.index(whole)] / share[domains.index(whole)] if whole else sum(supply)
    targets = [s * budget for s in share]
    place = domains.index(whole) if whole else None
    rates, reached = fit_rates(rows, targets, most, place)
    gaps = [(a - b) / budget if budget else 0.0 for a, b in zip(reached, targets, strict=True)]
    draw = F.pmod(F.xxhash64(F.lit("copies"), keep[0]), F.lit(1 << 30)) / float(1 << 30)
    out = rates.add(rows, place).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))
    return out.withColumns({"gaps": F.array(*map(F.lit, gaps)), "on_target": F.lit(max(map(abs, gaps)) <= TOLERANCE)})


#: Domains of the label table: toxic, else by quality; and the shares that a training mix should have.
WEIGHTS = {"good": 0.95, "low": 0.03, "toxic": 0.02}


def label_domain(labels: DataFrame) -> DataFrame:
    """doc_id and domain, one row a document (the worst label of repeated rows); rows with a null label are left out."""
    worst = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
    rows = worst.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("low")
    return rows.select("doc_id", domain.alias("domain"))


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> DataFrame:
    """Texts and domains of at most ``most`` labelled documents, one text for each id: that of least hash where rows repeat it.

    The labels are few by that bound, so they are broadcast; repeated ids are combined before they are shuffled.
    """
    some = label_domain(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")).join(F.broadcast(some), "doc_id")
    one = rows.groupBy("doc_id", "domain").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m"))
    return one.select(F.col("m.t").alias(text), "domain")


def op2_soft_mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, words, posteriors, fitted rate and copies of all ``documents``, and how far each domain's total misses its target;
    rates may reach 4."""
    rows = mix(docs, labelled_texts(docs, labels), WEIGHTS, ["doc_id"], most=4.0)
    p = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(WEIGHTS)]
    gaps = [F.element_at("gaps", i + 1).alias(f"gap_{d}") for i, d in enumerate(WEIGHTS)]
    return rows.select("doc_id", "n_tokens", *p, "rate", "copies", *gaps, "on_target")
