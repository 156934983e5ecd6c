"""Operators against plain versions of themselves: whole dialogues, long texts, repeated rows, curve places, direct solutions."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isovane.llm import bottomk, chat, language, maxscore, mixing, packing, quality, queries, sharding
from tests.compare import duck

SF = "/root/testdata/sf0.001"
BLANKS = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, " \n" * 1_000_000 + "end", "x" + " " * 1_500_000 + "y<|endoftext|>"]


def ids_of(texts: list[str]) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_long_runs_have_the_ids_of_the_tokenizer(spark):
    path = public_tokenizers.path(packing.VOCABULARY)
    for text, want in zip(BLANKS, ids_of(BLANKS), strict=True):
        assert packing.token_ids(text, path).tolist() == want
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(BLANKS[:2])), "doc_id long, text string")).collect()
    for i, want in enumerate(ids_of(BLANKS[:2])):
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in mine) == len(want)
        assert all(c == zlib.crc32(np.array(want[at : at + n], "<u4").tobytes()) for at, n, c in mine)


def test_packing_in_many_groups(spark):
    rng = random.Random(2)
    parts = spark.createDataFrame([(i, 0, rng.randrange(1, 1025)) for i in range(2_000)], "doc_id long, piece int, length long")
    rows = packing.pack(parts, group=100).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for found in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [o for o, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(rows) == 2_000 and len(by_sequence) <= 1.1 * sum(r.length for r in rows) / 1024


def plain_vector(text: str, dim: int) -> np.ndarray:
    """The bundle of a text, one trigram after another."""
    total, before = np.zeros(dim), ""
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    symbols = [0 if c == " " else ord(c) for c in f" {' '.join(low.split())} "] if low.split() else []
    for i in range(len(symbols) - 2):
        bound = np.ones(dim)
        for j in range(3):
            bound = bound * np.roll(language.letter_vector(symbols[i + j], dim), 2 - j)
        total += bound
    return total


def test_language_against_one_gram_at_a_time(spark):
    rows = duck(SF).execute("SELECT doc_id, text, lang FROM documents WHERE n_chars < 3000 AND lang IS NOT NULL ORDER BY doc_id LIMIT 60").fetchall()
    vectors = {i: plain_vector(t, language.DIM) for i, t, _ in rows}
    sums: dict[str, np.ndarray] = {}
    for i, _, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vectors[i]
    names = sorted(sums)
    matrix = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, v in vectors.items():
        cosines = matrix @ v / max(np.linalg.norm(v), 1e-9)
        assert got[i].lang_pred == (names[cosines.argmax()] if v.any() else "und")
        assert abs(got[i].score - max(0, cosines.max())) < 1e-4


@pytest.mark.parametrize("size", [2, 3, 50, 101, 1_001])
def test_slices_of_a_long_text_change_nothing(monkeypatch, size):
    texts = ["The quick brown fox, 12 jumps -- over the Ärger", "  x", "ab", "...", "it's a's", " ".join(f"word{i % 97}x" for i in range(900)), "word" * 700]
    for text in texts:
        column = pa.array([text])
        monkeypatch.setattr(language, "SLICE", 1 << 21)
        (_, _, whole, letters), = language._bundles(column, 3, 256)
        monkeypatch.setattr(language, "SLICE", size)
        (_, _, sliced, counted), = language._bundles(column, 3, 256)
        assert np.array_equal(whole, sliced) and letters.tolist() == counted.tolist()


def test_language_stage_drops_what_is_in_no_learned_language(spark):
    rng = random.Random(4)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(200)) for _ in range(10)]
    foreign = ["Wszystkie prawa zastrzeżone przez autora książki, która została wydana w roku dwutysięcznym i sprzedana w wielu egzemplarzach na całym świecie. " * 3] * 3
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(10_000_000 + i, t, None, "x", len(t)) for i, t in enumerate([*junk, *foreign])], docs.schema)
    kept = {r.doc_id for r in language.keep_identified(docs.unionByName(more)).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10_000_000}
    clean = {r.doc_id for r in docs.where("n_chars > 200").select("doc_id").collect()}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_floors_are_fitted_on_every_labelled_row(spark):
    """70,000 short texts and 100 longer ones, which are too few for a floor of their own if some of them are left out."""
    rng = random.Random(6)
    words = {"a": ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)], "b": ["".join(rng.choice("nopqrstu") for _ in range(5)) for _ in range(40)]}
    rows = [(i, " ".join(rng.choices(words[k], k=60 if i < 100 else 4)), k) for i in range(70_100) for k in ["ab"[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    prototypes = language.learn(docs.where("doc_id < 1000"))
    learned = docs.where(~language.held_out())
    scores = [(r.letters.bit_length(), r.score) for r in language.predict(learned, prototypes, keep=("lang",)).where("lang = lang_pred").collect()]
    found = language.floors(docs, prototypes)
    short, long = (sorted(x for c, x in scores if c == n) for n in ((20).bit_length(), (300).bit_length()))
    assert len(short) > 50_000 and language.CLASS_ROWS <= len(long) < 100
    assert found[(300).bit_length()] == long[0] / 2  # the 1 % quantile of so few
    assert short[len(short) // 100 - 10] / 2 <= found[(20).bit_length()] <= short[len(short) // 100 + 10] / 2
    docs.unpersist()


def test_quality_against_a_direct_solution(spark):
    rng = np.random.default_rng(5)
    n, d = 400, len(quality.STATISTICS)
    stats = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d) + rng.uniform(-2, 2, d)
    label, fold = (stats[:, 0] + rng.normal(size=n) > 0).astype(int), rng.integers(0, 2, n)
    model = quality.fit(spark.createDataFrame([(s.tolist(), int(y), int(f)) for s, y, f in zip(stats, label, fold, strict=True)], "stats array<double>, label int, fold int"))
    x, y = stats[fold == 0], label[fold == 0]
    z = quality.fourier((stats - x.mean(0)) / x.std(0))
    a = z[fold == 0]
    penalty = quality.RIDGE * np.diag([*[1.0] * quality.FEATURES, 1e-9])
    weights = np.linalg.lstsq(np.vstack([a / np.sqrt(len(a)), np.sqrt(penalty)]), np.concatenate([y / np.sqrt(len(a)), np.zeros(len(penalty))]), rcond=None)[0]
    assert np.abs(z @ weights - model.raw(stats)).max() < 1e-6
    levels = np.array(model.levels)
    assert (np.diff(levels) >= 0).all() and (np.diff(model.knots) > 0).all()
    raw, marks = model.raw(stats[fold == 1]), label[fold == 1]
    best = min((np.mean((np.interp(raw, model.knots, levels) - marks) ** 2), "model"), (np.mean((marks.mean() - marks) ** 2), "constant"))
    assert best[1] == "model"


def test_quality_of_empty_and_long_texts(spark):
    rows = [(1, ""), (2, None), (3, " \n "), (4, "word " * 600_000), (5, "x" * 3_000_000)]
    found = quality.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(np.isfinite(r.stats).all() for r in found) and len(found) == 5
    assert {tuple(r.stats) for r in found if r.doc_id in (1, 2)} == {tuple([0.0] * len(quality.STATISTICS))}


def as_sql(rows: list[tuple]) -> list[str]:
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(map(repr, con.execute(chat.ORACLE).fetchall()))


@pytest.mark.parametrize(
    "rows",
    [
        [(5, i, ["ann", "bob"][i % 2], f"turn {i} é𝒳") for i in range(1_000)],
        [(None, None, ["ann", "bob", None, "system"][i % 4], f"text {i}") for i in range(1_500)],
        [(None if i % 7 == 0 else 5, None if i % 11 == 0 else i % 40, ["ann", "bob", "eve"][i % 3], f"text {i // 2}") for i in range(2_500)],
        [(i % 9, i // 9, ["ann", "bob"][i % 2], "hi") for i in range(300)],
    ],
)
def test_dialogues_are_rendered_whole(spark, rows):
    rendered = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(repr(tuple(r)) for r in chat.digest(rendered).collect()) == as_sql(rows)
    found = defaultdict(list)
    for r in rendered.collect():
        found[r.conv_id, r.speaker].append(r)
    for parts in found.values():
        parts.sort(key=lambda r: r.part)
        whole = "".join(r.chat for r in parts)
        spans = [s for r in parts for s in r.spans]
        assert all(whole[s.start : s.end].endswith(chat.CLOSE) for s in spans) and len(spans) == sum(r.n_own for r in parts)
        assert max(r.n_turns for r in parts) <= chat.PART_TURNS
        assert [r.start for r in parts] == np.cumsum([0, *[len(r.chat) for r in parts]])[:-1].tolist()


@pytest.mark.parametrize("doc_id", [7, None])
def test_repeated_rows_meet_the_target(spark, doc_id):
    """Sources of one row many times over: each is within one document of its target."""
    one = F.lit(doc_id).cast("long").alias("doc_id")
    docs = spark.range(0, 10_000, 1, 5).select(one, F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("t").alias("source")))
    rows = mixing.mix(docs).groupBy(F.col("row.source")).agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(rows) == 2
    for r in rows:
        assert abs(r.taken - r.target) < 4 and r.most <= 2
    assert sorted(r.n for r in mixing.repeated(docs).groupBy("source").agg(F.count("*").alias("n")).collect()) == sorted(r.taken // {"s": 4, "t": 3}[r.source] for r in rows)


def test_water_fill_with_many_sources(spark):
    sizes = [(f"s{i:04d}" if i else None, (i * 7919) % 1_000) for i in range(3_000)]
    rows = mixing.water_fill(spark.createDataFrame(sizes, "source string, source_size long")).collect()
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = dict(sizes)
    low, high = 0.0, 1e9
    for _ in range(200):  # bisection of the level
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2.0 * size[s], weight[s] * level) for s in order) < 1.5 * sum(size.values()) else (low, level)
    assert all(r.weight == weight[r.source] and abs(r.target - min(2.0 * size[r.source], weight[r.source] * low)) < 1e-6 for r in rows)


def plain_place(cell: list[int], bits: int) -> int:
    """Place on the Hilbert curve, level by level, with the state as an entry corner and an axis."""
    n, place, entry, along = len(cell), 0, 0, 0
    full = (1 << n) - 1
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & full
    for b in range(bits - 1, -1, -1):
        corner = turn(sum((c >> b & 1) << j for j, c in enumerate(cell)) ^ entry, 2 * n - along - 1)
        digit = 0
        while corner:
            digit, corner = digit ^ corner, corner >> 1
        first = 0 if digit == 0 else (digit - 1) // 2 * 2 ^ (digit - 1) // 2
        entry ^= turn(first, along + 1)
        ones = digit - 1 if digit % 2 == 0 and digit else digit
        trailing = 0 if digit == 0 else ((~ones & (ones + 1)).bit_length() - 1) % n
        place, along = place << n | digit, (along + trailing + 1) % n
    return place


def test_shards_against_a_plain_order(spark):
    docs = duck(SF).execute("SELECT doc_id, text, source, lang FROM documents").fetchall()
    cell = {}
    for j in (2, 3):
        values = sorted({r[j] for r in docs}, key=lambda v: (v is None, v))
        cell[j] = {v: i * 256 // len(values) for i, v in enumerate(values)}
    size = {r[0]: len((r[1] or "").encode()) + 8 for r in docs}
    by_size = lambda x: min(255, 4 * x.bit_length() + int(f"{x:b}00"[1:3], 2))
    order = sorted((plain_place([cell[2][r[2]], cell[3][r[3]], by_size(size[r[0]])], 8), r[0]) for r in docs)
    base, more = divmod(len(docs), 24)
    want = {}
    for shard in range(24):
        first = shard * base + min(shard, more)
        for slot in range(base + (shard < more)):
            place, doc_id = order[first + slot]
            want[doc_id] = (place, shard, slot)
    assert {r.doc_id: (r.curve, r.shard, r.slot) for r in queries.op9_sharding(spark, SF).collect()} == want


def test_ranks_of_one_value(spark):
    """A dimension that holds one value, nulls alone or many values."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("source"), F.col("id").cast("string").alias("lang"), (F.col("id") % 7).alias("size"))
    rows = sharding.shard(docs, ["doc_id"], shards=7).collect()
    assert Counter(r.shard for r in rows) == Counter([i for i in range(7) for _ in range(71 + (i < 3))])


def test_search_with_many_shards_and_blocks(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.integers(-9, 10, 8).astype(float).tolist()) for i in range(900)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = maxscore.embedding_rows(df)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in maxscore.search(rows, rows.where("vec_id % 20 = 0"), 10, shard_rows=70, block_queries=16).collect()}
    matrix = np.array([v for _, v in vectors]) * 1024
    for q in range(0, 900, 20):
        scores = matrix @ matrix[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in want]


def test_edit_pairs_follow_descending_ids(spark):
    docs = spark.range(3_000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    want = {r.doc_id: r.edited for r in bottomk.edit_pairs(docs).collect()}
    assert want[0] == "text of 0"[:6] + "text of 2999"[:3] and want[3] == "text of 1"[:6] + "text of 0"[:3]
