from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm import lines
from test_duplicates import templates_of


def kept(spark, rows, **options):
    return {r["doc_id"]: r["text"] for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}


def test_lines_of_exactly_the_share_join(spark):
    # of five tokens after the leading three, one may vary
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "a b c d e f g y"), (4, "p q r s t"), (5, "p q r s u"), (6, "p q r s v")]
    assert kept(spark, rows) == {1: rows[0][1], 2: "", 3: "", 4: rows[3][1], 5: rows[4][1], 6: rows[5][1]}


def test_two_words_vary_in_a_template_of_eleven(spark):
    base = "the old sign says that {} and {} may come in here to stay"
    variants = [("red", "cat"), ("red", "dog"), ("tan", "dog")]
    # the first variant leads, as it is held most often; the last differs from it in two tokens, from the second in one
    rows = [(i + 1, base.format(*variants[v])) for i, v in enumerate((0, 0, 1, 2))]
    assert kept(spark, rows) == {i: rows[0][1] if i == 1 else "" for i in range(1, 5)}


def test_fields_never_outgrow_what_may_vary(spark):
    # each line differs from the first in two of eleven tokens at most, but not in the same ones: after two fields a template takes no more
    words = "the old sign says one two three four five six seven eight nine ten".split()
    change = lambda *at: " ".join("x" * (i + 1) if i in at else w for i, w in enumerate(words))
    rows = [(1, change()), (2, change()), (3, change(4, 5)), (4, change(6, 7)), (5, change(8, 9)), (6, change(4))]
    assert kept(spark, rows) == {1: rows[0][1], 2: "", 3: "", 4: rows[3][1], 5: rows[4][1], 6: ""} == dict(templates_of(rows))


def test_a_leaf_of_unlike_lines_loses_nothing(spark):
    draw = random.Random(9)
    words = [a + b + c for a in "bdfglm" for b in "aeiou" for c in "nrstxyz"] * 3
    rows = [(i, f"click here to {draw.choice(words)} {draw.choice(words)}{draw.choice('kpq')}") for i in range(3000)]
    want = dict(templates_of(rows))
    assert kept(spark, rows) == want
    # what goes are lines that three documents hold as they are
    same = Counter(x for _, x in rows)
    assert all(x or same[rows[i][1]] >= 3 for i, x in want.items()) and sum(not x for x in want.values()) < 100


@pytest.mark.parametrize("together", [lines.TOGETHER, 3])
def test_every_template_of_a_large_leaf_is_found(spark, together):
    # 60 templates in one leaf, each of four documents with another word; single lines in documents of their own besides
    shape = "page of the " + " ".join("{0}" + c for c in "abcdefg") + " {1} {0}h"
    rows = [(4 * t + i, shape.format(f"{'klmnop'[t % 6]}{'qrstuvwxyz'[t // 6]}", "vwxy"[i])) for t in range(60) for i in range(4)]
    rows += [(1000 + i, shape.format("z" * (i + 2), "v")) for i in range(90)]
    want = {i: x if i >= 1000 or i % 4 == 0 else "" for i, x in rows}
    assert kept(spark, rows, together=together) == want == dict(templates_of(rows, together=together))


def test_leaf_of_many_random_variants_matches_brute_force(spark):
    # what varies is partly the same all over, partly anything; groups are dealt out several times over
    draw = random.Random(8)
    rows = [(i, "in the end " + " ".join((draw.choice("ab") if p % 5 == 0 else draw.choice("a" * 30 + "bc")) * 2 for p in range(17)) + " word word word word") for i in range(220)]
    want = dict(templates_of(rows))
    assert kept(spark, rows) == want
    for together in (30, 4):  # larger groups' rests are held against all; templates grow from so many lines at a time
        assert kept(spark, rows, together=together) == dict(templates_of(rows, together=together))
    assert 2 < sum(not x for x in want.values()) < 218


def test_long_lines_recur_from_two_documents_on(spark):
    long, short = " ".join(["word"] * 30 + ["other"] * 20), " ".join(["word"] * 30 + ["other"] * 19)
    rows = [(1, f"{long}\n{short}"), (2, f"{short}\n{long}")]
    assert kept(spark, rows) == {1: rows[0][1], 2: short}
    # rows of one doc_id are one document, in which nothing recurs
    same = spark.createDataFrame([(2, long), (2, f"x\n{long}")], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in lines.drop_recurring(same).collect()) == [0, 0]


def test_lines_are_parsed_as_bytes_as_by_split(monkeypatch):
    """Tokens, lines and fields are those of ``str.split`` and ``split("\\n")``; equal tokens, and only they, have equal hashes."""
    draw = random.Random(3)
    pieces = [*"ab1é€​⁠—\U0001f600\x00", "<*>", "x" * 64, "x" * 65, *filter(str.isspace, map(chr, range(0x3001))), *["\n"] * 6]
    mark = lambda t: "<*>" if re.search("[0-9]", t) else t
    for step in (lines.STEP, 1, 50):
        monkeypatch.setattr(lines, "STEP", step)
        for _ in range(60):
            texts = [None if draw.random() < 0.1 else "".join(draw.choices(pieces, k=draw.randrange(50))) for _ in range(draw.randrange(9))]
            row, nth, first, hashes = lines.parsed(pa.array([None, *texts], pa.string())[1:])
            want = [(i, n, list(map(mark, line.split()))) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if line.split()]
            assert [(i, n, e - b) for i, n, b, e in zip(row, nth, first, first[1:])] == [(i, n, len(t)) for i, n, t in want]
            pairs = set(zip([t for _, _, found in want for t in found], hashes.tolist()))
            assert len(pairs) == len({t for t, _ in pairs}) == len({h for _, h in pairs})
