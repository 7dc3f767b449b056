"""Line dedup with passages of one word, against the plain version."""

from fernweave.llm.line_dedup import dedup_lines

from .brute import WHITE, line_bounds


def test_passages_of_one_word(spark):
    texts = ["ok\nalpha beta\nend", "ok\ngamma\nend", "x\nok", "", None, "end\nok", "alpha beta", " ok \n\nnew"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()}
    for i, (lines, must, may) in line_bounds(rows, 1).items():
        left = [x.strip(WHITE) for x in (got[i] or "").split("\n") if x.strip(WHITE)]
        assert len(lines) - len(may) <= len(left) <= len(lines) - len(must)
        if must == may:
            assert left == [x for p, x in enumerate(lines) if p not in must]
    assert got[1] == "gamma" and got[2] == "x" and got[6] == ""
