import base64
import gzip
import hashlib
import random

import pytest

from ruleweave.llm.warc import _record, read_archives, salvage, write_archives


def pages(spark):
    big = "x" * 1200
    rows = [(1, "http://a/", big), (2, "http://b/ c\r\n", big), (7, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "u", None), (5, "u", ""), (None, "n", big), (None, "m", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (8, "é", "é" * 600), (9, "é", "é" * 600), (9, "é", "é" * 600)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as payload", "'q' as first"), rows


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    df, rows = pages(spark)
    write_archives(df, str(tmp_path / "w"), compress, records=3)
    got = read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and all(r["gap"] is None for r in got)
    first = {"x" * 1200: 7, "é" * 600: 9}
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        f = first.get(html)
        revisit = f is not None and i != f
        want.append((f"<urn:page:{i}>", "revisit" if revisit else "response", f"<urn:page:{f}>" if revisit else None, len(p), hashlib.sha1(p).hexdigest(), b"" if revisit else p))
    assert sorted(map(str, want)) == sorted(str((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"]))) for r in got)


def test_empty_table_and_missing_payload(spark, tmp_path):
    df, _ = pages(spark)
    write_archives(df.where("false"), str(tmp_path / "e"))
    assert read_archives(spark, str(tmp_path / "e")).count() == 0
    write_archives(df, str(tmp_path / "p"))
    assert all(r["payload"] is None for r in read_archives(spark, str(tmp_path / "p"), payload=False).collect())


def archive(n, member):
    parts = []
    for i in range(n):
        p = f"page {i} ".encode() * 30
        r = _record(i, "http://x", p, hashlib.sha1(p).hexdigest(), None, "2024-01-01T00:00:00Z")
        parts.append(gzip.compress(r, mtime=0) if member else r)
    return parts


@pytest.mark.parametrize("member", [True, False])
def test_salvage_recovers_what_is_whole(member):
    rng = random.Random(8)
    parts = archive(12, member)
    for trial in range(60):
        bad = set(rng.sample(range(12), 3))
        data, hurt = bytearray(), []
        for i, p in enumerate(parts):
            b = bytearray(p)
            if i in bad:
                kind = rng.randrange(3)
                if kind == 0:  # a byte of the payload (or of the compressed data)
                    b[len(b) // 2 if member else len(b) - 40] ^= 0xFF
                elif kind == 1:  # the tail is lost
                    del b[len(b) // 2 :]
                else:  # something stands before
                    b[:0] = b"junk WARC/1.0\r\n \x1f\x8b\x08 junk"
            hurt.append((len(data), len(data) + len(b)))
            data += b
        found = list(salvage(bytes(data)))
        ids = [f.headers["warc-record-id"] for f in found if f.reason is None]
        assert {f"<urn:page:{i}>" for i in range(12) if i not in bad} <= set(ids) and len(ids) == len(set(ids))
        gaps = [f for f in found if f.reason]
        assert gaps and all(any(a < g.end and g.start < b for i, (a, b) in enumerate(hurt) if i in bad) for g in gaps)
        # records and gaps cover the file
        at = 0
        for f in found:
            assert f.start == at
            at = f.end
        assert at == len(data)


def test_wrong_digest_is_quarantined():
    p = b"payload"
    good = _record(1, "u", p, hashlib.sha1(p).hexdigest(), None, "d")
    bad = _record(2, "u", p, hashlib.sha1(b"other").hexdigest(), None, "d")
    found = list(salvage(bad + good))
    assert [f.reason is None for f in found] == [False, True] and "digest" in found[0].reason
    assert list(salvage(b"")) == [] and list(salvage(b"\r\n\r\n"))[0].reason


def test_members_with_several_records():
    parts = archive(3, False)
    assert len(list(salvage(gzip.compress(b"".join(parts))))) == 3


@pytest.mark.parametrize("level", [0, 6])
def test_a_damaged_member_keeps_its_valid_records(level):
    rng = random.Random(6)
    plain = []
    for i in range(8):
        p = rng.randbytes(3000)
        plain.append(_record(i, "http://x", p, hashlib.sha1(p).hexdigest(), None, "2024-01-01T00:00:00Z"))
    after = gzip.compress(_record(9, "http://y", b"z", hashlib.sha1(b"z").hexdigest(), None, "d"))
    ids = lambda found: [int(f.headers["warc-record-id"][10:-1]) for f in found if f.reason is None]
    # one digest is wrong: the member is whole
    wrong = bytearray(b"".join(plain))
    wrong[len(plain[0]) * 3 + 1500] ^= 0xFF
    found = list(salvage(gzip.compress(bytes(wrong), level) + after))
    assert ids(found) == [0, 1, 2, 4, 5, 6, 7, 9] and ["digest" in f.reason for f in found if f.reason] == [True]
    # the tail is lost, at the end of the file and before another member
    member = gzip.compress(b"".join(plain), level)
    cut = member[: len(member) * 6 // 10]
    found = list(salvage(cut))
    assert ids(found) == [0, 1, 2, 3] and [f.start for f in found if f.reason] == [0] and found[0].end == len(cut)
    found = list(salvage(cut + after))
    assert ids(found) == [0, 1, 2, 3, 9]
    # a byte is turned: all other records stay
    turned = bytearray(member)
    turned[len(member) * 6 // 10] ^= 0xFF
    found = list(salvage(bytes(turned) + after))
    assert set(ids(found)) >= {0, 1, 2, 3, 9} and len(ids(found)) == len(set(ids(found))) and any(f.reason for f in found)
    # only the checksum is: the damage may be anywhere
    turned = bytearray(member)
    turned[-6] ^= 0xFF
    assert 9 in ids(salvage(bytes(turned) + after))


def test_digests_in_base_32_and_of_blocks():
    p = b"payload " * 20
    good, other = (base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (p, b"other"))
    hexed = hashlib.sha1(p).hexdigest()
    for stated, valid in ((good, True), (good.lower(), True), (other, False), (hexed.upper(), True), ("not a digest", True)):
        (found,) = salvage(_record(1, "u", p, stated, None, "d"))
        assert (found.reason is None) == valid
        if valid:
            assert found.digest == hexed
    # revisits state the digest of the full payload, in either form
    (found,) = salvage(_record(1, "u", p, good, 2, "d"))
    assert found.digest == hexed and found.payload_bytes == len(p)
    record = _record(1, "u", p, hexed, None, "d")
    block = record.partition(b"\r\n\r\n")[2][:-4]
    for data, valid in ((block, True), (b"x", False)):
        line = b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(data).digest()) + b"\r\nContent-Type: application/http"
        (found,) = salvage(record.replace(b"Content-Type: application/http", line, 1))
        assert (found.reason is None) == valid


def test_members_longer_than_a_slice_and_many_short_ones():
    rng = random.Random(9)
    sizes = [70_000, 1, 16_384, 40_000, *[10] * 500]
    payloads = [rng.randbytes(n) for n in sizes]
    data = b"".join(gzip.compress(_record(i, "u", p, hashlib.sha1(p).hexdigest(), None, "d")) for i, p in enumerate(payloads))
    found = list(salvage(data))
    assert [f.payload for f in found] == payloads and found[-1].end == len(data)
