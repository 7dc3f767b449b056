import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernweave.llm import line_dedup as L

from .brute import WHITE, line_bounds, longest_increasing

SCHEMA = "doc_id long, text string, found string, n_lines string"


def left_over(text):
    return [x.strip(WHITE) for x in (text or "").split("\n") if x.strip(WHITE)]


def check(spark, rows, exact=True):
    """The result lies between what must and what may go; exact: these are the same."""
    df = spark.createDataFrame([(*r, "mine", "theirs") for r in rows], SCHEMA)
    got = {r.doc_id: r for r in L.dedup_lines(df).collect()}
    for i, (lines, must, may) in line_bounds(rows).items():
        row = got[i]
        assert row.found == "mine" and row.n_lines == (len(dict(rows)[i].split("\n")) if dict(rows)[i] else 0)
        at, kept = 0, []
        for line in left_over(row.text):  # what is left is a subsequence
            while lines[at] != line:
                at += 1
            kept.append(at)
            at += 1
        assert row.removed_lines == len(lines) - len(kept)
        assert [lines[p] for p in range(len(lines)) if p not in must and p not in may] == [lines[p] for p in kept if p not in may] or not exact
        if exact:
            assert must == may and left_over(row.text) == [x for p, x in enumerate(lines) if p not in must], i
        else:
            assert len(lines) - len(may) <= len(kept) <= len(lines) - len(must)
            for x in {lines[p] for p in may}:
                n = left_over(row.text).count(x)
                assert sum(lines[p] == x and p not in may for p in range(len(lines))) <= n <= sum(lines[p] == x and p not in must for p in range(len(lines))), (i, x)
    return got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), unique=True, max_size=40))
def test_patience(values):
    run = L.longest_increasing(values)
    assert [values[i] for i in run] == sorted(values[i] for i in run) and run == sorted(run)
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert len(run) == max(best, default=0)
    assert run == longest_increasing(values)


def test_against_plain_version(spark):
    random.seed(7)
    pool = [" ".join(random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(1, 8))) for _ in range(60)]
    rows = []
    for i in range(300):
        lines = [random.choice(pool) if random.random() < 0.6 else f"own line of {i} {j}" for j in range(random.randint(0, 14))]
        rows.append((i, "\n".join(x if random.random() < 0.9 else random.choice(["", "  ", f" {x}\r"]) for x in lines)))
    check(spark, rows, exact=False)


def test_passage_in_very_many_documents(spark):
    passage = "\n".join(f"line {j} of a passage that many documents share with each other" for j in range(8))
    rows = [(i, f"head of {i} stays\n{passage}\ntail of {i} stays") for i in range(2000)]
    got = check(spark, rows)
    assert got[0].removed_lines == 0 and all(got[i].removed_lines == 8 for i in range(1, 2000))


def test_short_lines_stay_moved_lines_stay(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    got = check(spark, [(1, f"{a}\n{b}\nok"), (2, f"{b}\nmiddle\n{a}"), (3, "ok\nother"), (4, f"ok\n{a}")], exact=False)
    assert got[3].removed_lines == 0
    assert got[2].removed_lines == 1 and got[2].removed_words in (5, 6)


def test_later_copies_of_a_document_with_moved_lines_go(spark):
    p, q, r = "p is a line of seven words here", "q has as many words in it too", "r is new in the second document"
    got = check(spark, [(1, f"{p}\n{q}"), (2, f"{q}\n{p}\n{r}"), (3, f"{q}\n{p}\n{r}")], exact=False)
    assert got[3].text == "" and got[3].removed_lines == 3
    # thousands of documents hold the two lines the other way round
    rows = [(0, f"{p}\n{q}")] + [(i, f"head of {i} stays\n{q}\nand {i} between them\n{p}") for i in range(1, 1500)]
    got = check(spark, rows, exact=False)
    assert got[1].removed_lines == 1 and all(got[i].removed_lines == 2 for i in range(2, 1500))


def test_lines_in_many_orders(spark):
    random.seed(11)
    pool = [f"line {j} of a pool that is put in many orders" for j in range(12)]
    check(spark, [(i, "\n".join(random.sample(pool, 8))) for i in range(60)], exact=False)


def test_blocks_of_short_lines_go_whoever_has_parts_of_them(spark):
    rows = [(1, "red\nand some more"), (2, "blue\nother text"), (3, "new one\nred one\nblue two\nlast"), (4, "head\nred one\nblue two\nlast\nend")]
    got = check(spark, rows)
    assert got[4].text == "head\nend" and got[3].removed_lines == 0


def test_different_lines_with_equal_polynomial_hashes_stay(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"head one two three {word} end"), (2, f"head one two three {other} end")]
    got = check(spark, rows)
    assert got[2].text == rows[1][1]


def test_repeated_rows_count_once_and_columns_survive(spark):
    rows = [(1, "a b c d e f", 0)] + [(2, "a b c d e f", 7)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int").withColumns({"_own": F.lit("o"), "doc": F.lit("d"), "gone": F.lit("g"), "key": F.lit("k")})
    got = L.dedup_lines(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "_id", "_own", "doc", "gone", "key", *L.ADDED}
    assert sorted((r.doc_id, r.removed_lines, r.removed_words, r._id, r.gone) for r in got) == [(1, 0, 0, 0, "g")] + [(2, 1, 6, 7, "g")] * 3


def test_nulls_empty_repeats_long(spark):
    long = "\n".join(f"word {i} of a long text here" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, long + "\nits own end of the text")]
    got = check(spark, rows)
    assert got[1].text is None and got[5].text == "its own end of the text"
    twice = spark.createDataFrame([(1, "a b c d e f", "x", "y")] * 2 + [(None, "a b c d e f", "x", "y")], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in L.dedup_lines(twice).collect()) == [(0, "a b c d e f"), (1, ""), (1, "")]
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r for r in L.op5_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for i, (lines, must, may) in line_bounds(rows).items():
        assert len(must) <= got[i].removed_lines <= len(may)
        assert len(left_over(got[i].text)) == len(lines) - got[i].removed_lines
