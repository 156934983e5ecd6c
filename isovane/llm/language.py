"""Language identification with hyperdimensional profiles.

Every letter (and the word boundary) has a random vector of -1 and 1. An n-gram's vector binds its
letters: the product of their vectors, each permuted (rotated) by its place. A document is the bundle (sum)
of its n-gram vectors, a language the bundle of its documents'. A document gets the language whose
prototype has the largest cosine with it.

Since bundling is linear, n-grams are counted first and each distinct n-gram of a piece of text is
bound once; documents are then one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovane.llm.arrowtext import flat_codes, pieces

DIM = 1024
ORDER = 3
SEED = 20_011
UNDETERMINED = "und"
#: A text longer than this many symbols is counted in slices that overlap by ORDER - 1.
SLICE = 1 << 19
#: Bytes of text that a task works on at a time, vectors of n-grams, and counts that are made at once: no array
#: is larger than some 8 MB, since a worker keeps about as much as its largest ones after they are freed.
PIECE = 1 << 19
BLOCK = 1 << 10
COUNTS = 1 << 20


@cache
def _lower_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_vectors: dict[tuple[int, int], np.ndarray] = {}


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """The random vector of a letter (0: word boundary), the same on every executor."""
    if (found := _vectors.get((code, dim))) is None:
        if len(_vectors) >= 20_000:
            _vectors.clear()
        found = _vectors[code, dim] = np.random.default_rng([SEED, code]).integers(0, 2, dim, np.int8) * 2 - 1
    return found


def _symbols(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, row of each, letters in each row): lower-case letters, runs of anything else as one boundary 0.

    Every row that has a letter starts and ends with a boundary, so that words at its ends count too.
    """
    rows = len(offsets) - 1
    low = _lower_table()[codes]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    letters = np.bincount(row[low > 0], minlength=rows)
    keep = low > 0
    keep[1:] |= (low[:-1] > 0) & (row[1:] == row[:-1])  # the first non-letter after a letter
    low, row = low[keep], row[keep]
    if not len(low):
        return low, row, letters
    opens = np.flatnonzero(np.diff(row, prepend=-1))
    low, row = np.insert(low, opens, 0), np.insert(row, opens, row[opens])
    ends = np.flatnonzero(np.diff(row, append=row[-1] + 1)) + 1
    ends = ends[low[ends - 1] > 0]
    return np.insert(low, ends, 0), np.insert(row, ends, row[ends - 1]), letters


def _compact(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct symbols in order, index of each place's symbol)."""
    seen = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, bool)
    seen[symbols] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - np.int32(1))[symbols]


def _grams(codes: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, distinct n-grams as numbers in its base, n-gram index of each place, row of each place, letters in each row)."""
    symbols, row, letters = _symbols(codes, offsets)
    alphabet, index = _compact(symbols)
    base = max(1, len(alphabet))
    n = len(index) - order + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return alphabet, empty, empty, empty, letters
    number = np.zeros(n, np.int64)
    for j in range(order):
        number = number * base + index[j : j + n]
    whole = row[:n] == row[order - 1 :]
    number, at = number[whole], row[:n][whole]
    if base**order <= 1 << 22:
        seen = np.zeros(base**order, bool)
        seen[number] = True
        distinct = np.flatnonzero(seen)
        place = np.cumsum(seen, dtype=np.int32) - np.int32(1)
        return alphabet, distinct, place[number], at, letters
    distinct, inverse = np.unique(number, return_inverse=True)
    return alphabet, distinct, inverse, at, letters


def _bind(alphabet: np.ndarray, grams: np.ndarray, order: int, dim: int) -> np.ndarray:
    """The vectors of n-grams (rows): products of letter vectors, each rotated by its distance from the end."""
    base, bound = len(alphabet), None
    letters = np.stack([letter_vector(int(c), dim) for c in alphabet])
    for j in range(order):
        digit = grams // base ** (order - 1 - j) % base
        part = np.roll(letters, order - 1 - j, axis=1)[digit]
        bound = part if bound is None else bound * part
    return bound.astype(np.float32)


def _counted(at: np.ndarray, index: np.ndarray, rows: int, n_grams: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first n-gram, how often each row has it and the next ones) for ``BLOCK`` n-grams at a time."""
    together = rows * n_grams <= COUNTS
    if together:
        table = np.bincount(at * n_grams + index, minlength=rows * n_grams).reshape(rows, n_grams)
    for lo in range(0, n_grams, BLOCK):
        hi = min(n_grams, lo + BLOCK)
        if together:
            yield lo, table[:, lo:hi]
            continue
        mine = (index >= lo) & (index < hi)
        yield lo, np.bincount(at[mine].astype(np.int64) * (hi - lo) + index[mine] - lo, minlength=rows * (hi - lo)).reshape(rows, hi - lo)


def _bundles(column: pa.Array, order: int, dim: int, group: np.ndarray | None = None, groups: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, document vectors, letters) for pieces of a text column; with ``group``, a number below
    ``groups`` for each row, one vector for each group instead."""
    for start, stop in pieces(column, PIECE):
        codes, offsets = flat_codes(column.slice(start, stop - start))
        if stop - start == 1 and len(codes) > SLICE:
            vector, letters = _long(codes, order, dim)
            if group is not None:
                vector = np.eye(groups, dtype=np.float32)[:, group[start : start + 1]] * vector
            yield start, stop, vector, letters
            continue
        alphabet, grams, index, at, letters = _grams(codes, offsets, order)
        rows = stop - start
        if group is not None:
            at, rows = group[start:stop][at], groups
        vectors = np.zeros((rows, dim), np.float32)
        for lo, counts in _counted(at, index, rows, len(grams)):
            vectors += counts.astype(np.float32) @ _bind(alphabet, grams[lo : lo + BLOCK], order, dim)
        yield start, stop, vectors, letters


def _long(codes: np.ndarray, order: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """One very long text: its symbols are counted slice by slice.

    A slice carries on where the last one ended: the boundary before the first letter and after the last one are
    added once, and the last ``order`` - 1 symbols open the next slice, so that each n-gram counts once.
    """
    total, letters, tail, after_letter = np.zeros((1, dim)), 0, np.zeros(1, np.uint32), False
    for lo in range(0, len(codes), SLICE):
        low = _lower_table()[codes[lo : lo + SLICE]]
        letter = low > 0
        keep = letter.copy()
        keep[0] |= after_letter
        keep[1:] |= letter[:-1]
        after_letter = bool(letter[-1])
        letters += int(letter.sum())
        last = [np.zeros(1, np.uint32)] if after_letter and lo + SLICE >= len(codes) else []
        symbols = np.concatenate([tail, low[keep], *last])
        tail = symbols[1 - order :] if order > 1 else symbols[:0]
        alphabet, index = _compact(symbols)
        n_grams = max(0, len(index) - order + 1)
        number = np.zeros(n_grams, np.int64)
        for j in range(order):
            number = number * len(alphabet) + index[j : j + n_grams]
        grams, counts = np.unique(number, return_counts=True)
        for k in range(0, len(grams), BLOCK):
            total += counts[k : k + BLOCK] @ _bind(alphabet, grams[k : k + BLOCK], order, dim).astype(np.float64)
    return total.astype(np.float32), np.array([letters])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, dim: int = DIM) -> dict[str, list[float]]:
    """Language prototypes: the bundle of all n-grams of every row with non-null ``lang``, scaled to length 1.

    Each task adds up one vector per language; only those sums (languages x dim numbers) are shuffled and
    reach the driver. Rows without letters add nothing; no usable row gives no prototype.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(1))
            names, group = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for _, _, vectors, _ in _bundles(batch.column(0), order, dim, group, len(names)):
                for name, vector in zip(names, vectors, strict=True):
                    sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = rows.mapInArrow(run, "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for name, i, x in summed.collect():  # languages x dim numbers
        found.setdefault(name, np.zeros(dim))[i] = x
    return {k: (v / np.linalg.norm(v)).tolist() for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, dim: int = DIM) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``letters`` for every row, from the whole text alone.

    ``score`` is the cosine with the best prototype, clipped to 0..1. A text that is null or has no
    letter, or an empty set of prototypes, gives ``und`` and 0. Equal cosines go to the smaller name.
    ``letters`` is the number of letters. Repeated rows are predicted one by one. Rows leave a task piece by piece, so that
    neither side holds a second copy of a batch of texts.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), dim)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("letters", "long")
    body = keep.index(text) if text in keep else len(keep)  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, vectors, letters in _bundles(batch.column(body), order, dim):
                n = stop - start
                langs, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
                if names:
                    norms = np.linalg.norm(vectors, axis=1)
                    cosines = (vectors @ matrix.T) / np.maximum(norms, 1e-9)[:, None]
                    best = cosines.argmax(axis=1)
                    known = letters > 0
                    langs[known] = np.array(names, object)[best[known]]
                    scores[known] = np.clip(cosines[np.arange(n), best][known], 0, 1)
                kept = batch.slice(start, n).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores), pa.array(letters, pa.int64())], [*keep, "lang_pred", "score", "letters"])

    sent = [*keep] if text in keep else [*keep, F.col(text).alias("_body")]
    return docs.select(*sent).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that aren't held out."""
    prototypes = learn(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()).select("doc_id", "held_out", "text"), prototypes, keep=("doc_id", "held_out"))


#: No document is kept whose best cosine is below this, which is what chance gives in DIM dimensions.
LEAST_COSINE = 0.05
#: Length classes with a floor of their own have at least so many labelled rows.
CLASS_ROWS = 50


def length_class(letters: Column) -> Column:
    """Binary digits of the number of letters: texts of one class differ in length by less than a factor of 2."""
    return F.when(letters > 0, F.length(F.bin(letters))).otherwise(0)


def floors(docs: DataFrame, prototypes: dict[str, list[float]], least: float = LEAST_COSINE) -> list[float]:
    """By length class, half the 1 % quantile of the cosines of all rightly recognised labelled rows; ``least`` at least.

    Longer texts come nearer to their prototype, so a text far below what is usual at its length is in another language or no
    prose. A class with fewer than ``CLASS_ROWS`` rows has the floor of the class below it. Held-out rows and rows without a
    ``lang`` take no part, all others do. Of n rows of a class the quantile's rank is right to n / 10,000.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    right = predict(known, prototypes, keep=("lang",)).where(F.col("lang") == F.col("lang_pred"))
    by_class = right.groupBy(length_class(F.col("letters")).alias("class")).agg(F.count("*").alias("n"), F.percentile_approx("score", 0.01, 10_000).alias("low"))
    low = {r["class"]: r.low for r in by_class.collect() if r.n >= CLASS_ROWS}  # 64 rows at most
    found = [least]
    for c in range(1, 65):
        found.append(max(least, low[c] / 2) if c in low else found[-1])
    return found


def keep_identified(docs: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of the learned languages.

    Texts that are null or without letters go, and those whose cosine is below the floor of their length (``floors``).
    """
    prototypes = learn(docs.where(~held_out()))
    floor = F.element_at(F.array(*[F.lit(x) for x in floors(docs, prototypes, least)]), length_class(F.col("letters")) + 1)
    plain = [f"_{i}" for i in range(len(docs.columns))]  # no name that a prediction has
    judged = predict(docs.toDF(*plain), prototypes, text=plain[docs.columns.index("text")], keep=tuple(plain))
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= floor)).select(*plain).toDF(*docs.columns)


__all__ = ["floors", "identify", "keep_identified", "learn", "predict"]
