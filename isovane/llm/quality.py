"""Quality scores: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Statistics of a whole text are standardised and sent through cos(W x + b), whose inner products approximate a
Gaussian kernel (Rahimi and Recht). Tasks add up Z'Z and Z'y of their labelled rows; the sums give the
ridge weights. A second fold of labelled rows calibrates the raw scores: pooled-adjacent-violators over a
fixed number of score bins, with linear interpolation between the pooled blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isovane.llm.arrowtext import flat_bytes, pieces, row_sums
from isovane.plans.lineage import cut

FEATURES = 192
SEED = 7_919
RIDGE = 1e-3
BINS = 400
THRESHOLD = 0.7
#: Bandwidth of the kernel in units of sqrt(number of statistics).
WIDTH = 1.0

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "symbol", "sentence_marks",
    "symbol_ends", "bang", "white", "log_lines", "line_length", "non_ascii", "capital_words", "all_caps_words",
    "repeat_letters", "short_words", "long_words", "distinct_words",
]


@cache
def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    of = lambda s: np.isin(code, np.frombuffer(s, np.uint8))
    white = of(b" \t\n\v\f\r")
    upper = (code >= 65) & (code <= 90)
    lower = (code >= 97) & (code <= 122)
    digit = (code >= 48) & (code <= 57)
    return {"white": white, "upper": upper, "lower": lower, "digit": digit, "high": code >= 128, "marks": of(b".,;:?'\"-()"), "bang": of(b"!"), "line": of(b"\n"), "symbol": (code > 32) & (code < 127) & ~(upper | lower | digit) & ~of(b".,;:?'\"-()")}


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; all are finite, an empty text gives zeros."""
    rows = len(at) - 1
    if not len(raw):
        return np.zeros((rows, len(STATISTICS)))
    c = {k: v[raw] for k, v in _classes().items()}
    row = np.repeat(np.arange(rows), np.diff(at))
    sums = {k: row_sums(v, at).astype(float) for k, v in c.items()}
    size = np.diff(at).astype(float)
    edge = np.zeros(len(raw), bool)
    edge[at[:-1][size > 0]] = True
    before = np.concatenate([[True], c["white"][:-1]]) | edge
    starts = np.flatnonzero(before & ~c["white"])
    after = np.concatenate([c["white"][1:] | edge[1:], [True]])
    ends = np.flatnonzero(after & ~c["white"])
    of = row[starts]
    length = (ends - starts + 1).astype(float)
    count = lambda x: np.bincount(of, weights=x, minlength=rows)
    words = np.bincount(of, minlength=rows).astype(float)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    mean = count(length) / w
    spread = np.sqrt(np.maximum(count(length**2) / w - mean**2, 0))
    uppers = np.concatenate([[0], np.cumsum(c["upper"])])
    caps = (uppers[ends + 1] - uppers[starts]).astype(float)
    same = np.concatenate([[False], raw[1:] == raw[:-1]]) & ~c["white"] & ~edge
    key = _word_keys(raw, starts, ends)
    # distinct words of each text: sort by the upper half of text and word together
    key = (of.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20))
    key.sort()
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key >> np.uint64(44)).astype(np.int64), weights=new, minlength=rows)
    lines = sums["line"] + 1
    table = np.stack([
        np.log1p(size), np.log1p(words), mean, spread, sums["upper"] / b, sums["digit"] / b, sums["symbol"] / b, sums["marks"] / w,
        count(c["symbol"][ends] | c["bang"][ends]) / w, sums["bang"] / w, sums["white"] / b, np.log(lines), np.log1p(size / lines), sums["high"] / b,
        count(c["upper"][starts]) / w, count((caps >= 2) & (caps * 2 > length)) / w, row_sums(same, at) / b,
        count(length <= 2) / w, count(length >= 14) / w, distinct / w,
    ], axis=1)
    table[size == 0] = 0
    return table


def _word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word: a weighted sum of its bytes by place, mod 2^64 (differences of one running sum)."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(raw), 0x5851F42D4C957F2D | 1, np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power)])
        inverse = np.uint64(pow(int(0x5851F42D4C957F2D | 1), -1, 1 << 64))
        shift = np.cumprod(np.full(len(raw), inverse, np.uint64))
        return (total[ends + 1] - total[starts]) * shift[starts]


def _frequencies(features: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    d = len(STATISTICS)
    return rng.standard_normal((d, features)) / (WIDTH * np.sqrt(d)), rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    w, b = _frequencies(features)
    return np.concatenate([np.sqrt(2 / features) * np.cos(np.clip(x, -8, 8) @ w + b), np.ones((len(x), 1))], axis=1)


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``stats`` (array of STATISTICS) of every whole text; null counts as empty."""
    schema = docs.select(*keep).schema.add("stats", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            found = [statistics(*flat_bytes(column.slice(a, b - a))) for a, b in pieces(column)]
            table = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            flat = pa.array(table.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, len(STATISTICS)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], [*keep, "stats"])

    return docs.select(*keep, F.col(text).alias("_body")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """Everything a score needs; of fixed size."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    knots: list[float]
    levels: list[float]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        x = (stats - np.array(self.mean)) / np.array(self.scale)
        return fourier(x, len(self.weights) - 1) @ np.array(self.weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[list[float], list[float]]:
    """Pooled adjacent violators over ordered bins: centres and rates of the pooled blocks, rates not falling."""
    blocks: list[list[float]] = []
    for centre, n, k in zip(x.tolist(), total.tolist(), positive.tolist(), strict=True):
        blocks.append([centre * n, n, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[1] for b in blocks], [b[2] / b[1] for b in blocks]


def _summed(rows: DataFrame, run, width: int) -> np.ndarray:
    """The sum over all rows of the ``width`` numbers that ``run`` gives for each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += run(np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = rows.mapInArrow(each, "v array<double>").select(F.posexplode("v").alias("i", "x"))
    out = np.zeros(width)
    for i, x in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # width numbers
        out[i] = x
    return out


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS) -> Model:
    """Learn from rows (stats, label 0/1, fold 0/1): fold 0 fits the ridge weights, fold 1 calibrates them.

    Rows with a null label are left out. Only sums of fixed size reach the driver. Without rows of both
    labels the score is the share of label 1 (0.5 without any row).
    """
    rows = labelled.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("double").alias("y"), "fold")
    fitting, calibrating = rows.where("fold = 0").select("stats", "y"), rows.where("fold = 1").select("stats", "y")
    d = len(STATISTICS)
    sums = _summed(fitting, lambda x, y: np.concatenate([x.sum(0), (x**2).sum(0), [len(y), y.sum()]]), 2 * d + 2)
    n, positive = sums[-2], sums[-1]
    if n == 0 or positive in (0, n):
        share = float(positive / n) if n else 0.5
        return Model([0.0] * d, [1.0] * d, [0.0] * (features + 1), [0.0], [share])
    mean = sums[:d] / n
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    k = features + 1
    upper = np.triu_indices(k)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier((x - mean) / scale, features)
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    sums = _summed(fitting, normal, len(upper[0]) + k)
    gram = np.zeros((k, k))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    weights = np.linalg.solve(gram / n + ridge * np.diag([1.0] * features + [1e-9]), sums[len(upper[0]) :] / n)
    plain = Model(mean.tolist(), scale.tolist(), weights.tolist(), [0.0], [0.0])
    edges = np.linspace(-0.5, 1.5, bins - 1)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = plain.raw(x)
        b = np.searchsorted(edges, raw)
        return np.concatenate([np.bincount(b, minlength=bins), np.bincount(b, y, bins), np.bincount(b, raw, bins)])

    total, hits, place = _summed(calibrating, binned, 3 * bins).reshape(3, bins)
    some = total > 0
    if not some.any():
        return Model(plain.mean, plain.scale, plain.weights, [0.0, 1.0], [0.0, 1.0])
    knots, levels = isotonic(place[some] / total[some], total[some], hits[some])
    return Model(plain.mean, plain.scale, plain.weights, knots, levels)


def score(stats: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` for rows of text_statistics()."""
    schema = stats.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            s = model.score(flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return stats.select(*keep, "stats").mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from its whole text alone.

    Learned from labelled rows whose crc32(doc_id) mod 4 is not 2: remainders 0 and 1 fit, 3 calibrates.
    A doc_id with several labels counts once with each. Null and empty texts are scored as empty.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    stats = cut(text_statistics(docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))).select("doc_id", "held_out", "text"), keep=("doc_id", "held_out")))
    marks = labels.where((rest != 2) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    known = stats.where(~F.col("held_out")).join(marks, "doc_id")
    model = fit(cut(known.select("stats", "label", F.when(rest == 3, 1).otherwise(0).alias("fold"))))
    return score(stats, model, keep=("doc_id", "held_out"))


__all__ = ["Model", "fit", "isotonic", "rate", "score", "statistics", "text_statistics"]
