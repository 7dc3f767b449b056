import hashlib
import re

from fernweave.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, sha string, keep_id string"


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for r in members]
    return sorted(out, key=str)


def check(spark, rows):
    got = exact_dedup(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    assert sum(r.kept for r in got) == len({r[3] for r in brute(rows)})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_groups_ties_nulls_repeats(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a\x0b b "), (9, "a b  "), (7, None), (8, ""), (6, " \n\t"), (1, "é"), (2, "é "), (None, "zz"), (11, "zz"), (12, "q"), (12, "q"), (None, "n"), (None, "n")]
    check(spark, rows)


def test_one_group_holds_most_rows(spark):
    check(spark, [(i, "copy " * 50 if i % 3 else f"own {i}") for i in range(3000)])


def test_common_opening_and_long_texts(spark):
    check(spark, [(i, "same opening " * 20_000 + str(i % 3)) for i in range(9)])


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
