"""Personal data: base spans against plain regular expressions, what the trees add, and texts that wear matchers out."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from isovane.llm import pii, queries
from tests.compare import duck

#: The base patterns as they are dealt.
DEALT = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
COUNTS = ["n_email", "n_ip", "n_card", "n_phone"]


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern, part in zip(pii.KINDS, DEALT, [r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "", ""], strict=True):
        if not re.search(part, text or ""):  # spares the plain patterns, whose time grows with the square of a run
            continue
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]
            out += [(kind, m.start(), m.end())] * bool(good)
    return out


def same_base(rows, texts: list[str | None]) -> None:
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r[c] for c in COUNTS] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        joined = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest(), texts[r.doc_id][:200]
        spans = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(spans) and len(spans) == len(joined) + r.n_added
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert order == sorted(order)


def table(spark, texts: list[str | None]):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS kind", "3 AS start", "4 AS f")


def card(rng: random.Random) -> str:
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + d for d in "0123456789" if luhn(head + d))


def phone(rng: random.Random) -> str:
    return f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"


def address(rng: random.Random) -> str:
    return ".".join(str(rng.randrange(1, 255)) for _ in range(4))


def test_base_spans_of_scrambled_texts(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "@", ".", "..", "a.b@c-d.e.f", "1", "12", "256", "255", "0000", "1.2.3.4", "999.1.1.1", " ", "  ", "-", "+", "+1 ", "(5)", "é", "ü@x.de", "x_y%z@q.r", "4111 1111 1111 1111", "4111-1111-1111-1111", "😀", "\n", "+49 30 1234567", "7" * 17, "0" * 16, "0" * 19]
    texts: list[str | None] = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(600)] + ["", None, "no data at all", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x" + "+" * 50 + "1 2"]
    same_base(pii.report(table(spark, texts)).collect(), texts)


def test_texts_that_wear_a_matcher_out(spark):
    n = 20_000
    texts = ["a" * n, "1" * n, "1 " * n, "1-2 " * n, "+1" * n, "+1" + " " * n, "a." * n + "@", "@" * n, "1." * n, "(" * n, "a@b." * n, "0" * n + ".1.1.1", "x@y.z " * 20_000, "1.2.3.4 " * 5_000]
    same_base(pii.report(table(spark, texts)).collect(), texts)


def test_data_side_by_side_is_added_and_clean_texts_stay(spark):
    rng = random.Random(9)
    texts = [f"Write to {rng.choice('abcdef')}{i}@mail{i % 9}.example.com or {phone(rng)}, card {card(rng)}, from {address(rng)} now." for i in range(400)]
    texts += [f"Order {rng.randrange(10**15, 10**16)} of version {rng.randrange(300, 999)}.{rng.randrange(9)}.{i}.1 costs 12,000.50 (in 1999-2004)." for i in range(200)]
    first = len(texts)
    beside = [(phone(rng), card(rng)) for _ in range(20)]
    texts += [f"and {p} {c} there" for p, c in beside]
    clean = len(texts)
    texts += ["no numbers", "In 2004, 1,200 people paid 3.50 each (see pages 12-19).", "call me at noon", "version 10.4", "a b @ c"]
    rows = sorted(pii.report(table(spark, texts)).collect(), key=lambda r: r.doc_id)
    same_base(rows, texts)
    for r, (p, c) in zip(rows[first:clean], beside, strict=True):
        want = {f"phone:4:{4 + len(p)}", f"card:{5 + len(p)}:{5 + len(p) + len(c)}"}
        assert want == {s for s in r.spans.split(",")} or plain(texts[r.doc_id])
    assert sum(r.n_added for r in rows[first:clean]) >= 36 and all(r.spans == "" for r in rows[clean:])
    assert sum(r.n_added for r in rows[400:first]) == 0


def test_written_out_marks_of_an_address(spark):
    rng = random.Random(2)
    texts = [f"mail user{i}@host{i % 7}.example.com now" for i in range(300)] + ["mail jane.doe (at) host3.example.com now", "mail jane.doe[at]host3[dot]example[dot]com now", f"{rng.random()}"]
    rows = sorted(pii.report(table(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert rows[300].spans == "email:5:36" and rows[301].spans == "email:5:42" and rows[302].n_added == 0


def test_proposals_overlap_and_the_best_stays(spark):
    """Two-level trees by hand: of proposals that overlap, the higher score stays, then those that are free."""
    spans = spark.createDataFrame([(1, 7, 2, 0, 10, False, False, [9]), (1, 8, 2, 5, 20, False, False, [1]), (1, 9, 3, 15, 30, False, False, [9]), (1, 9, 3, 40, 50, False, True, [9]), (2, 7, 2, 0, 10, False, False, [1])],
                                  "row long, source int, kind int, start long, end long, sure boolean, covered boolean, f array<int>")
    model = pii.Model(0.0, (pii.Tree((0, 5), ((0, 0), (0, 9)), (0.0, 1.0, 3.0, 0.0)),), (2.0, 2.0, 0.5, 0.5))
    assert sorted((r.row, r.kind, r.start, r.end) for r in pii.added(spans, model).collect()) == [(1, 2, 0, 10), (1, 3, 15, 30), (2, 2, 0, 10)]


def test_thresholds():
    assert pii._threshold([]) == 2.0 and pii._threshold([(100, 5, 0)]) == 2.0
    assert pii._threshold([(199, 100, 100), (20, 50, 0)]) == (199 + 20) / 2 / pii.STEPS
    assert pii._threshold([(199, 100, 100), (150, 1, 1), (100, 300, 0)]) == 125 / pii.STEPS


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c"), (1, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_email, r.spans) for r in pii.report(docs).collect())
    assert got == [(False, 0, ""), (False, 1, "email:0:5"), (False, 1, "email:0:5"), (True, 1, "email:0:5")]
    empty = pii.report(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", *COUNTS, "base_sha256", "spans", "n_added"] and empty.collect() == []


def test_the_query_has_every_document_and_its_base_spans(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(duck(sf).execute("SELECT doc_id, text FROM documents").fetchall())
    rows = queries.op13_pii(spark, sf)
    assert [t for _, t in rows.dtypes] == ["bigint"] * 5 + ["string", "string", "bigint"]
    same_base(rows.collect(), texts)


@pytest.mark.parametrize("digits,good", [("4111111111111111", True), ("4111111111111112", False), ("123", False), ("0" * 19, True), ("0" * 20, False)])
def test_check_sum(spark, digits, good):
    assert spark.range(1).select(pii._luhn(F.lit(digits))).first()[0] == good
