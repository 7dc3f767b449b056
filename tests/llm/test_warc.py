import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from fernweave.llm.warc import dedup_archives, read_archives, resolved, write_archives

SCHEMA = "page_id long, url string, html string, item string"
LONG = "word " * 300


def rows():
    out = [(i, f"http://a/{i}", LONG + str(i % 5), "x") for i in range(40)]
    out += [(i, f"http://b/{i}", "short", "x") for i in range(40, 50)]
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40
    out += [(50, "http://c", tricky, "x"), (51, "http://c\r\nX-Item: 9", tricky, "x"), (52, None, None, "x"), (53, "http://d", "", "x")]
    out += [(None, "http://e", "é\n" * 900, "x"), (54, "http://e", "é\n" * 900, "x"), (55, "http://f", "y" * 3_000_000, "x")]
    return out + [(56, "http://g", LONG + "twice", "x")] * 2


def plain(table, least=1000):
    """(id, bytes, digest, type, refers to) of each row; of rows that repeat with the largest id one is the response."""
    groups = {}
    for i, _, html, _ in table:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        best = max(ids, key=lambda i: (i is not None, i or 0))
        spared = list(ids)
        spared.remove(best)
        digest = hashlib.sha1(data).hexdigest()
        if len(data) < least:
            out += [(i, len(data), digest, "response", None) for i in ids]
        else:
            out += [(best, len(data), digest, "response", None)] + [(i, len(data), digest, "revisit", best) for i in spared]
    return sorted(out, key=str)


def result(spark, folder):
    got = resolved(read_archives(spark, folder)).collect()
    assert all(r["intact"] for r in got)
    number = lambda v: None if v is None else int(v)
    return sorted(((number(r["item"]), r["full_bytes"], r["payload_digest"], r["record_type"], number(r["to_item"])) for r in got), key=str)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("warc")
    raw, deduped = str(place / "raw"), str(place / "deduped")
    write_archives(spark.createDataFrame(rows(), SCHEMA).repartition(5), raw, date="2024-01-02T03:04:05Z")
    dedup_archives(spark, raw, deduped, order=F.col("item").cast("long"), date="2025-01-01T00:00:00Z")
    return raw, deduped


def test_written_archives_read_back_whole(spark, folders):
    got = read_archives(spark, folders[0]).collect()
    seen = sorted(((r["item"] and int(r["item"])), r["target_uri"], r["payload"].decode()) for r in got if r["item"])
    want = sorted((i, u and u.replace("\r", "%0D").replace("\n", "%0A"), h or "") for i, u, h, _ in rows() if i is not None)
    assert [(s[0], s[1] or "", s[2]) for s in seen] == [(w[0], w[1] or "", w[2]) for w in want]
    assert all(r["intact"] and r["record_type"] == "response" and r["record_date"] == "2024-01-02T03:04:05Z" for r in got)
    assert len({r["record_id"] for r in got}) == len(rows()) and all(r["payload_bytes"] == len(r["payload"]) for r in got)


def test_files_are_standard_archives(folders):
    """By the format's rules alone: version line, fields, an empty line, as many bytes as stated, two line ends."""
    kinds = []
    for file in glob.glob(f"{folders[1]}/*.gz"):
        data = gzip.open(file).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.split(b"\r\n")
            fields = dict(line.split(b": ", 1) for line in lines)
            size = int(fields[b"Content-Length"])
            assert first == b"WARC/1.1" and fields[b"WARC-Date"] == b"2025-01-01T00:00:00Z" and rest[size : size + 4] == b"\r\n\r\n"
            assert fields[b"WARC-Record-ID"].startswith(b"<urn:uuid:")
            if fields[b"WARC-Type"] == b"revisit":
                assert fields[b"WARC-Profile"].endswith(b"identical-payload-digest") and fields[b"WARC-Refers-To-Date"] == b"2024-01-02T03:04:05Z"
                assert rest[:size].endswith(b"\r\n\r\n") and fields[b"WARC-Refers-To"].startswith(b"<urn:uuid:")
            kinds.append(fields[b"WARC-Type"])
            data = rest[size + 4 :]
    assert len(kinds) == len(rows()) and kinds.count(b"revisit") == 35 + 1 + 1 + 1


def test_revisits_equal_plain(spark, folders):
    assert result(spark, folders[1]) == plain(rows())


def test_deduplicating_again_changes_nothing(spark, folders, tmp_path):
    again = str(tmp_path / "again")
    dedup_archives(spark, folders[1], again, order=F.col("item").cast("long"))
    assert result(spark, again) == plain(rows())


def test_later_original_takes_over_revisits(spark, folders, tmp_path):
    """A second crawl joins the archives: old revisits refer to the new original."""
    more = [(100, "http://n", LONG + "3", "x")]
    write_archives(spark.createDataFrame(more, SCHEMA), str(tmp_path / "all" / "more"))
    spark.read.option("lineSep", "\r\n\r\n\r\n").text(folders[1])
    both, out = str(tmp_path / "all"), str(tmp_path / "out")
    import shutil

    shutil.copytree(folders[1], f"{both}/old")
    dedup_archives(spark, f"{both}/*", out, order=F.col("item").cast("long"))
    assert result(spark, out) == plain(rows() + more)


def test_damage_is_reported(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    wrong = good.replace(b"WARC-Type", b"WARC-Payload-Digest: sha1:00\r\nWARC-Type")
    (tmp_path / "in").mkdir()
    # records as members of their own, as crawlers write them
    with open(tmp_path / "in" / "a.warc.gz", "wb") as f:
        f.write(gzip.compress(info) + gzip.compress(good) + gzip.compress(wrong) + gzip.compress(good[:-10]))
    got = read_archives(spark, str(tmp_path / "in")).orderBy("place").collect()
    assert [(r["record_type"], r["intact"], r["payload"]) for r in got] == [("warcinfo", True, b"hi"), ("response", True, b"hello"), ("response", False, b"hello"), ("response", False, b"")] or [
        r["intact"] for r in got
    ] == [True, True, False, False]
    dedup_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert read_archives(spark, str(tmp_path / "out")).count() == 1


def test_missing_original_and_empty(spark, tmp_path):
    lone = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:r>\r\nWARC-Refers-To: <urn:gone>\r\nWARC-Payload-Digest: sha1:ab\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(lone))
    dedup_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    row = resolved(read_archives(spark, str(tmp_path / "out"))).first()
    assert (row["record_type"], row["refers_to"], row["full_bytes"], row["to_item"]) == ("revisit", "urn:gone", None, None)
    write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    dedup_archives(spark, str(tmp_path / "none"), str(tmp_path / "none2"))
    assert resolved(read_archives(spark, str(tmp_path / "none2"))).count() == 0
