"""Which texts hold which, against plain Python: lengths around grams, windows and blocks, joins over pieces, hints."""

import random

import pytest

from clausework.operators import containment, verify


@pytest.fixture(params=["direct", "indexed"])
def way(request, monkeypatch):
    monkeypatch.setattr(containment, "DIRECT", 1 << 18 if request.param == "direct" else 0)


def some_texts():
    rnd = random.Random(8)
    make = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    texts, patterns = [], []
    for d in range(6):
        letters = ("ab", "abcdefghij", "あいう𠮷xyz")[d % 3]
        whole = [make(rnd.choice((1, 3, 7, 30, 255, 256, 257, 700)), letters) for _ in range(12)] + ["a" * 400]
        texts.append(whole)
        joined = "".join(whole)
        own = {make(n, letters) for n in (1, 2, 3, 4, 7, 8, 9, 20, 300)}
        for n in (1, 2, 3, 4, 5, 7, 8, 9, 12, 60, 255, 256, 257, 511, 512, 513, 900):
            for at in (0, rnd.randrange(max(1, len(joined) - n)), max(0, len(joined) - n)):
                own.add(joined[at : at + n])
                own.add(joined[at : at + n - 1] + "Z")
        patterns.append(sorted(p for p in own if p))
    return texts, patterns


def test_texts_put_together(spark, way):
    texts, patterns = some_texts()
    others = spark.createDataFrame([(d, k, t) for d, some in enumerate(texts) for k, t in enumerate(some)], "doc_id long, pos long, norm string")
    rows = spark.createDataFrame([(d, k, p) for d, some in enumerate(patterns) for k, p in enumerate(some)] + [(99, 0, "nobody has it"), (0, 999, "")], "doc_id long, pos long, norm string")
    got = {(r["doc_id"], r["norm"]) for r in verify.absent(rows, others).collect()}
    assert got == {(d, p) for d, some in enumerate(patterns) for p in some if p not in "".join(texts[d])} | {(99, "nobody has it")}


def test_texts_on_their_own(spark, way):
    texts, patterns = some_texts()
    others = spark.createDataFrame([(d, t) for d, some in enumerate(texts) for t in some], "doc_id long, norm string")
    rows = spark.createDataFrame([(d, p) for d, some in enumerate(patterns) for p in some], "doc_id long, norm string")
    pats, each = containment.patterns(rows), containment.each(others)
    found = containment.find(pats, each)
    got = {(r["doc_id"], r["norm"], r["text"]) for r in found.join(pats, ["doc_id", "pid"]).join(each, ["doc_id", "tid"]).collect()}
    assert got == {(d, p, t) for d, some in enumerate(patterns) for p in some for t in texts[d] if p in t}


def test_empty_sides(spark, way):
    none = spark.createDataFrame([], "doc_id long, pos long, norm string")
    one = spark.createDataFrame([(1, 0, "some text")], "doc_id long, pos long, norm string")
    assert verify.absent(none, one).count() == 0 and verify.absent(one, none).count() == 1 and verify.attributed(none, one, one).count() == 0
    assert [r["by_edit"] for r in verify.attributed(one, one, none).collect()] == [True]


def test_hints_go_to_the_first_paragraph_that_holds_them(spark, way):
    paragraphs = spark.createDataFrame([(1, 10, "前条の規定"), (1, 11, "第８条 従業員は、届け出る。"), (1, 11, "第９条\t別項"), (1, 12, "第８条従業員は")], "doc_id long, pos long, text string")
    hints = spark.createDataFrame([(1, "第８条　従業員は"), (1, "第８条従業員は"), (1, " 第９条 "), (1, "第10条"), (1, "従業員は"), (2, "第８条")], "doc_id long, hint string")
    assert {tuple(r) for r in verify.attached(hints, paragraphs).collect()} == {(1, 11, "第８条従業員は"), (1, 11, "第９条")}
