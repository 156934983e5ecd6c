"""The filter audit against orders applied one document at a time, on texts that sit at each filter's edge."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import pytest

from isovane.llm import filteraudit, queries
from tests.compare import differing, duck, rows_of

SF = "/root/testdata/sf0.001"
WORDS = " ".join(f"w{i}" for i in range(100))
ROWS = [
    (1, "en", WORDS), (2, "en", WORDS), (2, "en", WORDS), (None, "en", WORDS), (None, "de", "x"), (3, "de", None), (4, "de", ""), (None, None, ""),
    (5, "", " ".join("ab" for _ in range(300))), (6, "en", " ".join(["a b c d"] * 40)), (7, "en", "ABCDEFGHIJ" * 200), (8, "fr", WORDS + " #"),
    (9, "fr", "A" + "x" * 9), (9, "fr", "AA" + "x" * 9), (10, "en", " ".join(f"w{i % 80}" for i in range(100))), (11, "en", " ".join(f"w{i % 79}" for i in range(100))),
    (12, "de", "long " * 400_000), (13, "en", WORDS), (14, "tab", "a\tb\x0bc\x0cd\re\x1fe\x85f"),
]
LABELS = [(1, 1, 0), (1, 0, None), (2, None, 1), (None, 1, 1), (6, 1, 1), (99, 1, 1), (12, 1, 0), (13, 1, 1)]


def plain(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """Every order applied to every document, one after another."""
    last = 1 << 62
    first: dict[str, int] = {}
    for i, _, t in docs:
        first[t or ""] = min(first.get(t or "", last), last if i is None else i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {p or "" for _, p, _ in docs}:
        mine = [(i, [*filteraudit.text_failures(t or ""), first[t or ""] < (last if i is None else i)]) for i, p, t in docs if (p or "") == part]
        rows, shapley = [], Counter()
        for order in permutations(range(5)):
            gone = [next((k for k in range(5) if f[order[k]]), 5) for _, f in mine]
            for k, f in enumerate(order):
                here = [i for (i, _), g in zip(mine, gone, strict=True) if g == k]
                shapley[f] += len(here)
                late = sum(x[f] and g < k for (_, x), g in zip(mine, gone, strict=True))
                only = sum(x[f] and sum(x) == 1 for _, x in mine)
                rows.append((f, "".join("ABCDE"[j] for j in order), k + 1, sum(g > k for g in gone), len(here), late, only, sum(i in good for i in here), sum(i in toxic for i in here)))
        out += [(part, *r[1:], shapley[r[0]]) for r in rows]
    return out


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_all_orders_one_document_at_a_time(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, lang string, text string").selectExpr("doc_id", "lang", "text", "1 AS part", "'z' AS key", "7 AS good", "8 AS n")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'en' AS lang", "0 AS A")
    got = filteraudit.digest(docs, labels)
    assert got.columns == NAMES and dict(got.dtypes)["step"] == "int" and all(dict(got.dtypes)[c] == "bigint" for c in NAMES[3:])
    assert rows_of(NAMES, got.collect()) == rows_of(NAMES, plain(ROWS, LABELS))


def test_flags_of_each_document(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, lang string, text string")
    got = {(r.doc_id, r.part): "".join(f for f in "ABCDE" if r[f]) for r in filteraudit.failures(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() if r.doc_id}
    assert got[1, "en"] == "" and got[2, "en"] == "E" and got[4, "de"] == "AE" and got[5, ""] == "A" and got[6, "en"] == "B" and got[7, "en"] == "AC"
    assert got[8, "fr"] == "D" and got[10, "en"] == "" and got[11, "en"] == "B" and got[12, "de"] == "B" and got[13, "en"] == "E"


@pytest.mark.parametrize("text,want", [("", "A"), ("A" + "x" * 9, "A"), ("AA" + "x" * 18, "A"), ("AA" + "x" * 17, "AC"), ("É" * 50, "A"), (WORDS.replace(" ", " "), "A"), (WORDS + "|", "D")])
def test_edges(text, want):
    assert "".join(f for f, v in zip("ABCD", filteraudit.text_failures(text), strict=True) if v) == want


def test_a_part_that_nothing_survives_has_all_steps(spark):
    docs = spark.createDataFrame([(1, "xx", "#")], "doc_id long, lang string, text string")
    rows = filteraudit.digest(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {"xx"} and sum(r.removed for r in rows) == 120
    assert {(r.filter_order[r.step - 1], r.shapley) for r in rows} == {("A", 60), ("D", 60), ("B", 0), ("C", 0), ("E", 0)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert filteraudit.digest(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_a_hot_text_and_ids_that_are_missing(spark):
    """A third of all rows is one text, a third has no id: no row of either is lost."""
    docs = spark.range(3_000).selectExpr("IF(id % 3 = 1, NULL, id) AS doc_id", "CAST(id % 2 AS STRING) AS lang", "IF(id % 3 = 0, 'same', CONCAT('t', id)) AS text")
    rows = filteraudit.digest(docs, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int"))
    first = rows.where("filter_order = 'EABCD' AND step = 1").orderBy("part").collect()
    assert [(r.kept, r.removed) for r in first] == [(1001, 499), (1000, 500)]
    assert rows.where("filter_order = 'ABCDE' AND step = 1").selectExpr("sum(removed)", "sum(good_lost)", "sum(toxic_lost)").first() == (3000, 1, 1)


def test_other_filters(spark):
    """The audit takes flags of any name and number."""
    failed = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, True), ("p", False, False, False, False)], "part string, short boolean, odd boolean, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit(failed, ("short", "odd")).collect()}
    assert got == {("shortodd", 1): (1, 2, 0, 1, 1, 1, 3), ("shortodd", 2): (1, 0, 1, 0, 0, 0, 1), ("oddshort", 1): (2, 1, 0, 0, 0, 1, 1), ("oddshort", 2): (1, 1, 1, 1, 1, 0, 3)}


def test_query_and_sql(spark):
    assert differing(spark, SF, queries.op11_filter_audit, filteraudit.ORACLE) == ""
    docs, labels = duck(SF).execute("SELECT doc_id, lang, text FROM documents").fetchall(), duck(SF).execute("SELECT doc_id, quality, toxic FROM labels").fetchall()
    assert rows_of(NAMES, queries.op11_filter_audit(spark, SF).collect()) == rows_of(NAMES, plain(docs, labels))
