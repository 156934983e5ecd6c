"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from isovane.llm import bottomk, chat, language, linedup, maxscore, mixing, packing, quality, sharding, simhash
from tests.compare import rows_of

LONG = " ".join(f"word{i % 977} and\nline {i % 31}" for i in range(40_000))
ROWS = [
    (1, "the quick brown fox\njumps over\nthe lazy dog", "en", "a", 41),
    (1, "the quick brown fox\njumps over\nthe lazy dog", "en", "a", 41),
    (2, "", None, "a", 0),
    (3, None, "en", None, None),
    (None, "le chat est sur la table\net le chien\ndort", "fr", "b", 40),
    (4, " \n\t ", "fr", "b", 4),
    (5, "le chat est sur la table\net le chien\ndort", "fr", None, 40),
    (6, "1234 5678 !!", None, "c", 12),
    (7, LONG, "en", "a", len(LONG)),
    (8, "日本語の文章です é 𝒳", "ja", "c", 14),
    (8, "another text under the same id", "en", "c", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["fp", "key", "bucket", "_w", "_row", "_body", "row", "size", "copies", "shard", "u", "v", "component", "_lines", "at", "h1", "stats", "place", "score", "tie"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(9) for c in CLASHING})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id > 100")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")


def test_language(docs, none):
    rows = language.identify(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 6)} == {"und"}
    assert language.identify(none).count() == 0
    assert language.keep_identified(docs).columns == docs.columns
    assert language.keep_identified(none).count() == 0


def test_quality(docs, none, labels):
    rows = quality.rate(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.rate(none, labels).count() == 0
    assert {r.score for r in quality.rate(docs, labels.where("false")).collect()} == {0.5}


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, "who"), (None, 0, "bob", "x"), (None, 1, "bob", "<|im_end|>"), (2, 0, "system", "alone"), (1, 300, "user", "late")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "speaker", "said", "c", "turns")})
    rows = chat.rotate(df).collect()
    assert {(r.conv_id, r.part, r.start, r.speaker) for r in rows} == {(1, 0, 0, s) for s in ("user", "assistant", "unknown")} | {(None, 0, 0, "bob")}
    for r in rows:
        own = "".join(r.chat[s.start : s.end] for s in r.spans)
        assert own.count(chat.CLOSE) == r.n_own
        assert r.chat.count(chat.CLOSE) == r.n_turns
    assert chat.rotate(df.where("false")).count() == 0


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id in (5, None)} == {5}
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprints(docs, none):
    rows = bottomk.fingerprint_pairs(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
    assert bottomk.fingerprint_pairs(none).count() == 0
    assert bottomk.fingerprint_pairs(docs.where("doc_id = 7")).first().near_next == 1


def test_line_dedup(docs, none):
    cleaned = linedup.dedup_lines(docs)
    assert cleaned.columns[:-3] == [c for c in docs.columns if c != "text"]
    rows = {(r.doc_id, r.source): r for r in cleaned.collect()}
    assert rows[5, None].n_removed == 0 and rows[None, "b"].n_removed == 3  # ids come before no id
    assert rows[3, None].text is None and rows[2, "a"].text == "" and rows[2, "a"].n_lines == 1
    assert rows[7, "a"].n_removed > 0
    assert linedup.dedup_lines(none).count() == 0
    assert linedup.keep_cleaned(docs).columns == docs.columns


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.copies <= 2 for r in rows)
    assert {r["size"] for r in rows if r.row.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(docs).columns == docs.columns
    again = mixing.mix(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixing_beyond_all_caps(docs):
    assert {r.copies for r in mixing.mix(docs, share=50.0).where("size > 0").collect()} == {2}


def test_sharding(docs, none, tmp_path):
    rows = sharding.digest(docs).collect()
    assert len(rows) == len(ROWS) and sorted((r.shard, r.slot) for r in rows) == [(i, 0) for i in range(len(ROWS))]
    assert sharding.digest(none).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 4, "part_of_corpus")
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and set(back.columns) == {*docs.columns, "part_of_corpus"}
    with pytest.raises(ValueError):
        sharding.write_shards(docs, str(tmp_path / "other"), 4, "shard")


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert {r.length for r in rows if r.doc_id in (2, 3)} == {1}
    assert max(r.offset + r.length for r in rows) <= 1024
    assert packing.pack_documents(none).count() == 0


def test_search(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, []), (6, [-1.0, 0.5, 9.0]), (7, [inf]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, [3e38, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("terms", F.lit(1)).withColumn("shard", F.lit(1))
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in maxscore.digest(df).collect()}
    assert rows[0, 1] == (200, maxscore.LONGEST) and rows[0, 2] == (1, 5 * 1024**2) == rows[0, 3]
    assert [rows[100, i][0] for i in range(1, 7)] == [0, 1, 1, 5, 6, 200]
    assert {q for q, _ in rows} == {0, 100, 200} and not {v for v, _ in rows.values()} & {2, 3, 4, 7, None}
    assert maxscore.digest(df.where("vec_id > 900")).count() == 0


def test_rows_of_one_id_all_ask_and_are_all_found(spark):
    """By row numbers in SQL: equal and different vectors under one id, on one shard and on many."""
    rows = [(100, [1.0, 2.0]), (100, [3.0, 1.0]), (100, [3.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [2.0, -1.0]), (200, [1.0, 1.0])] + [(i % 40 + 3, [i % 7 / 4, i % 5 / 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = rows_of(["query_id", "rank", "vec_id", "score"], con.execute(maxscore.ORACLE).fetchall())
    assert len(want) == 40
    assert rows_of(["query_id", "rank", "vec_id", "score"], maxscore.digest(df).collect()) == want
    found = maxscore.embedding_rows(df)
    many = maxscore.search(found, found.where("vec_id % 100 = 0"), shard_rows=20, block_queries=2)
    assert rows_of(["query_id", "rank", "vec_id", "score"], many.collect()) == want
