import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fernweave.llm import near_dedup as N
from fernweave.llm.components import connected_components
from fernweave.llm.wordhash import chunks

from .brute import near_classes, shingle_counts

SCHEMA = "doc_id long, text string, own string, v string"


def varied(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=5):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        words = [f"g{rng.randrange(400)}" for _ in range(rng.randrange(40, 300))]
        rows += [varied(words, rng.randrange(0, 6), rng) for _ in range(rng.randrange(1, 8))]
    base = [f"h{rng.randrange(5000)}" for _ in range(300)]
    rows += [varied(base, rng.randrange(0, 3), rng) for _ in range(150)]
    rows += ["", None, " \n", "one two", "one  two", "two one", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows):
    return N.near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()


def test_classes_against_all_pairs(spark):
    rows = corpus()
    got = run(spark, rows)
    assert {r.doc_id: r.class_id for r in got} == near_classes(rows, N.Settings())
    kept = [r for r in got if r.kept]
    assert sorted(r.doc_id for r in kept) == sorted({r.class_id for r in got})


def test_copies_repeats_null_ids(spark):
    text = "the same text in many rows of one table"
    rows = [(i, text + " " * (i % 3)) for i in range(3000)] + [(5, text)] * 3 + [(None, "alone here with five words")] * 2
    got = run(spark, rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == 2
    assert {r.class_id for r in got} == {0, None}
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = N.drop_near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.own) for r in kept) == [(False, "x"), (True, "x")]


def test_sets_and_similarity():
    texts = ["a b c d e f a b c d e", "x", "", "p q r s t u", "z " * 40]
    (c,) = chunks(pa.array(texts))
    owner, hashes, _, _ = N.elements(c, 5)
    for i, t in enumerate(texts):
        assert len(set(hashes[owner == i].tolist())) == shingle_counts(t).total()
        assert (np.diff(hashes[owner == i].astype(object)) > 0).all()
    a, b = np.array([1, 4, 7], np.uint64), np.array([4, 7, 9, 11], np.uint64)
    assert N.similarities(a, b, lambda s: np.where(s == 7, 3.0, 1.0)) == (4 / 7, 2 / 5)
    none = np.zeros(0, np.uint64)
    assert N.similarities(none, none, len) == (1, 1) and N.similarities(a, none, len) == (0, 0)


def test_words_that_differ_never_collide_by_structure():
    # Thue-Morse words collide under any polynomial hash modulo a power of two
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, " ".join(word[i : i + 60] for i in range(0, 4000, 60)), " ".join(other[i : i + 60] for i in range(0, 4000, 60))]
    (c,) = chunks(pa.array(texts))
    _, _, k1, k2 = N.elements(c, 5)
    assert len(set(k1.tolist())) == len(set(k2.tolist())) == 4
    starts, ends = c.bounds()
    spelled = {c.data[a:b].tobytes(): h for a, b, h in zip(starts, ends, c.spans(starts, ends).tolist())}
    assert len(set(spelled.values())) == len(spelled)


def test_idf_has_many_levels_and_bounds():
    settings = N.Settings()
    cells = np.full(2 * N.CELLS, 1, np.float32)
    made = []
    for n in (1, 200, 500, 3000, 10_000):
        cells[:] = n
        made.append(float(N.idf(np.array([5], np.uint64), cells, 10_000, settings)[0]))
    assert made == sorted(made, reverse=True) and len(set(made)) == 5
    assert abs(made[0] - 1 - settings.idf_gain) < 1e-6 and abs(made[-1] - 1) < 1e-6


def test_samples_agree_as_often_as_weights_overlap():
    settings = N.Settings(bands=300, rows=1)
    rng = np.random.default_rng(2)
    ids = np.sort(rng.choice(1 << 44, 600, replace=False).astype(np.uint64))
    owner = np.repeat([0, 1], 400)
    hashes = np.concatenate([ids[:400], ids[200:]])
    weights = np.where(np.arange(800) % 400 < 100, 3.0, 1.0)
    _, keys = N.band_keys(owner, hashes, weights, settings)
    w = [dict(zip(hashes[owner == i].tolist(), weights[owner == i])) for i in (0, 1)]
    low = sum(min(w[0].get(k, 0), w[1].get(k, 0)) for k in ids.tolist())
    high = sum(max(w[0].get(k, 0), w[1].get(k, 0)) for k in ids.tolist())
    assert abs((keys[0] == keys[1]).mean() - low / high) < 0.08


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = {r.v: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_pairs_among_documents_that_share_a_passage(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(344)]
    rows = []
    for g in range(1000):
        own = [f"o{g}-{i}" for i in range(60)]
        rows.append(" ".join(passage + own))
        if g % 2:
            rows.append(" ".join(passage + own[: 60 - rng.randrange(5, 20)] + [f"q{g}-{i}" for i in range(25)]))
        else:
            rows.append(" ".join(passage + [f"r{g}-{i}" for i in range(60)]))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in run(spark, list(enumerate(rows)))}
    # all pairs, by the shingles that two or more documents hold
    sets = [set(shingle_counts(t)) for t in rows]
    held = {}
    for s in sets:
        for g in s:
            held[g] = held.get(g, 0) + 1
    column = {g: i for i, g in enumerate(g for g, n in held.items() if n > 1)}
    holds = np.zeros((len(rows), len(column)), np.float32)
    for i, s in enumerate(sets):
        holds[i, [column[g] for g in s if g in column]] = 1
    common = holds @ holds.T
    size = np.array([len(s) for s in sets])
    jaccard = common / (size[:, None] + size[None, :] - common)
    alike = {(a, b) for a, b in np.argwhere(np.triu(jaccard >= 0.8, 1)).tolist()}
    assert len(alike) > 300
    assert [p for p in alike if got[p[0]] != got[p[1]]] == []
    classes = {}
    for i, c in got.items():
        classes.setdefault(c, []).append(i)
    assert all(len(m) <= 2 and (len(m) == 1 or tuple(sorted(m)) in alike) for m in classes.values())


def test_pairs_inside_a_group_that_shares_most_words(spark):
    # documents that share 800 words of 914, pairwise below the threshold, in planted pairs above it
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(800)]
    rows = []
    for g in range(60):
        own = [f"o{g}-{i}" for i in range(114)]
        twin = [w if rng.random() > 0.2 else f"t{g}-{i}" for i, w in enumerate(own)]
        for words in (own, twin):
            # own words lie apart, so that each breaks five shingles of what is shared
            rows.append(" ".join(x for i in range(800) for x in ([shared[i], words[i // 7]] if i % 7 == 0 and i // 7 < 114 else [shared[i]])))
    rows.append(" ".join(shared))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = near_classes(rows, N.Settings())
    assert 20 < len(set(want.values())) < 121
    assert {r.doc_id: r.class_id for r in run(spark, rows)} == want


def test_texts_that_repeat_a_passage_very_often(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [" ".join([passage] * 1000 + [f"w{g}-{i}" for i in range(2000)]) for g in range(3)] + [" ".join(f"v{g}-{i}" for i in range(100)) for g in range(40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = near_classes(rows, N.Settings())
    assert len(set(want.values())) == 41
    assert {r.doc_id: r.class_id for r in run(spark, rows)} == want


def test_query_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = N.op10_near_dedup(spark, "/root/testdata/sf0.001")
    assert {r.doc_id: r.class_id for r in got.collect()} == near_classes(rows, N.Settings())
    assert got.filter("kept").select(F.count_distinct("class_id"), F.count("*")).first()[0] == got.filter("kept").count()


def test_prefix_rows_grow_with_the_sets(spark):
    """Five times the sets, five times the rows, although the sketch of so many elements is full. Only elements of several labels get rows by size."""
    def made(n):
        rng = np.random.default_rng(1)
        common = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
        sets = [(i, i % 7, bytearray(np.sort(np.append(rng.integers(0, 1 << 64, 360, dtype=np.uint64), common[i % 20 :: 20])).tobytes())) for i in range(n)]
        df = spark.createDataFrame(sets, "k1 long, label long, elements binary").repartition(4)
        counts = spark.sparkContext.broadcast(N._share_counts(df))
        rows = N._prefixes(df, counts, 0.8).persist()
        shared = rows.join(N._of_several_labels(rows, ["element"]), "element", "left_semi")
        return rows.count(), N._sized(shared).select("element").distinct().count(), df, rows

    few, _, _, _ = made(300)
    many, elements, df, rows = made(1500)
    assert 4.9 * few <= many <= 5.1 * few
    assert elements <= 40
    # the sizes of a set's rows: the longer's own, and up to 1 / 0.8 of its own for the shorter's
    own = int(np.floor(np.log(362) / N.GRAIN))
    sizes = N._sized(rows).groupBy("longer").agg(F.min("size").alias("low"), F.max("size").alias("high")).orderBy("longer").collect()
    assert [(r.longer, r.low, r.high) for r in sizes] == [(False, own, int(np.floor(np.log(362 / 0.8) / N.GRAIN))), (True, own, own)]
