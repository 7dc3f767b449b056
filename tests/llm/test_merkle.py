import hashlib

import pytest
from pyspark.sql import functions as F

from fernweave.llm.merkle import folded, leaf_hash, merkle_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fanout):
    """The root, and each node's siblings level by level."""
    level, at, proofs = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, p in enumerate(at):
            start = p // fanout * fanout
            proofs[i] += [h for j, h in enumerate(level[start : start + fanout], start) if j != p]
        at = [p // fanout for p in at]
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], proofs


def plain_manifest(rows, fanout):
    """{(leaf, subroot, root, proof)} as a sorted list."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        own = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        leaves = [plain_leaf(r) for r in own]
        trees[k] = leaves, *plain_tree(leaves, fanout)
    root, upper = plain_tree([trees[k][1] for k in keys], fanout) if keys else (None, [])
    return sorted((leaf, trees[k][1], root, tuple(p + u)) for k, u in zip(keys, upper) for leaf, p in zip(trees[k][0], trees[k][2]))


def manifest(spark, rows, fanout, levels):
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = df.select("doc_id", "source", leaf_hash([df[c] for c in FIELDS]).alias("leaf"), F.lit("kept").alias("ROOT"), F.lit(1).alias("idx"), F.lit(2).alias("g"))
    return merkle_manifest(leaves, fanout=fanout, levels=levels).withColumn("again", folded("leaf"))


def check(spark, rows, fanout=3, levels=2):
    got = manifest(spark, rows, fanout, levels).collect()
    seen = []
    for r in got:
        h = r["siblings"].hex()
        seen.append((r["leaf"], r["subroot"], r["root"], tuple(h[i : i + 64] for i in range(0, len(h), 64))))
        assert r["again"] == r["root"] and (r["idx"], r["g"]) == (1, 2)
    assert sorted(seen) == plain_manifest(rows, fanout)


@pytest.mark.parametrize("fanout, levels", [(3, 2), (2, 3), (3, 7)])
def test_equals_plain_tree(spark, fanout, levels):
    rows = [(i, "hot", "en", i, f"text {i}\nnext") for i in range(100)]
    rows += [(i, f"s{i % 13}", None, None, "é" * (i % 5)) for i in range(200, 240)]
    rows += [(i, None, "en", 1, None) for i in range(300, 304)] + [(400, "", "en", 0, ""), (401, "lone", None, None, None)]
    check(spark, rows, fanout, levels)


def test_ties_repeats_null_ids_long_texts(spark):
    rows = [(7, "a", "en", 3, "abc")] * 40 + [(7, "a", "en", 3, "abd"), (None, "a", "en", 3, "abc"), (None, None, None, None, None)]
    rows += [(8, "a", "en", 2_000_000, "x" * 2_000_000), (9, "ä", "en", 1, "\n"), (10, "z", "en", 1, "a\r\nb")]
    check(spark, rows)


def test_one_row_and_empty(spark):
    check(spark, [(1, "a", "en", 1, "x")])
    empty = manifest(spark, [], 3, 7)
    assert empty.collect() == [] and {"path", "siblings", "subroot", "root"} <= set(empty.columns)


def test_changed_leaves_and_missing_proofs_fail(spark):
    rows = [(i, "ab"[i % 2], "en", 1, f"a\nb{i}") for i in range(30)]
    out = manifest(spark, rows, 3, 1)
    changed = out.withColumn("leaf", F.sha2("leaf", 256)).withColumn("again", folded("leaf"))
    assert changed.filter("again = root").count() == 0 and changed.count() == 30
    assert out.withColumn("path", F.lit(None).cast("binary")).withColumn("again", folded("leaf")).filter("again is null").count() == 30


def test_fanout_is_bounded(spark):
    with pytest.raises(ValueError):
        manifest(spark, [], 16, 1)
