"""Salvage from the first byte on, other versions and other digests."""

import base64
import gzip
import hashlib

import pytest

from trackloom.llm import warc

BODY = [b"<p>page %d</p>" % i for i in range(5)]
PARTS = [warc.header(i, f"http://x/{i}", "response", b, None) + b + warc.END for i, b in enumerate(BODY)]


def records(data):
    got = list(warc.read_archive(data))
    return [x.payload for x in got if isinstance(x, warc.Record)], [(g.start, g.end) for g in got if isinstance(g, warc.Gap)]


@pytest.mark.parametrize("compressed", [False, True])
def test_damage_at_the_start_loses_one_record_at_most(compressed):
    parts = [gzip.compress(p) for p in PARTS] if compressed else PARTS
    whole, first = b"".join(parts), len(parts[0])
    assert records(bytes([whole[0] ^ 0xFF]) + whole[1:]) == (BODY[1:], [(0, first)])
    assert records(whole[5:]) == (BODY[1:], [(0, first - 5)])
    for junk in (b"junk", b"\x1f\x8b", b"\x1f\x8b\x08 no member", gzip.compress(b"no record")):
        got, gaps = records(junk + whole)
        assert got == BODY and gaps == [(0, len(junk))], junk


@pytest.mark.parametrize("compressed", [False, True])
def test_older_version_and_other_digests(compressed):
    sha1 = b"sha1:" + warc.digest(BODY[1]).encode()
    other = lambda x: PARTS[1].replace(sha1, x)
    good = [PARTS[0].replace(b"WARC/1.1", b"WARC/1.0"), other(b"sha256:" + base64.b32encode(hashlib.sha256(BODY[1]).digest())), other(b"md5:" + hashlib.md5(BODY[1]).hexdigest().encode()), other(b"blake3:abc")]
    bad = other(b"sha256:" + base64.b32encode(hashlib.sha256(b"x").digest()))
    pack = gzip.compress if compressed else bytes
    got, gaps = records(b"".join(map(pack, [*good, bad, PARTS[2]])))
    assert got == [BODY[0], BODY[1], BODY[1], BODY[1], BODY[2]] and len(gaps) == 1


def foreign(block, kind="response", mime="application/http; msgtype=response", **fields):
    head = [b"WARC/1.0", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:uuid:0c5f-9a>", b"Content-Type: " + mime.encode(), *(k.replace("_", "-").encode() + b": " + v for k, v in fields.items()), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + warc.END + block + warc.END


def test_records_of_other_writers(spark, tmp_path):
    body = b"<html>x</html>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html" + warc.END + body
    sha1 = lambda x: b"sha1:" + base64.b32encode(hashlib.sha1(x).digest())
    chunked = block.replace(b"OK", b"OK\r\nTransfer-Encoding: chunked")
    good = [foreign(b"software: x", "warcinfo", "application/warc-fields"), foreign(block, WARC_Payload_Digest=sha1(body), WARC_Block_Digest=sha1(block)), foreign(chunked, WARC_Payload_Digest=sha1(b"decoded"))]
    bad = [foreign(block, WARC_Payload_Digest=sha1(b"other")), foreign(block, WARC_Block_Digest=sha1(body)), foreign(b"x", "resource", "text/plain", WARC_Payload_Length=b"9")]
    got, gaps = records(b"".join(map(gzip.compress, [*good, *bad, PARTS[1]])))
    assert got == [b"software: x", body, body, BODY[1]] and len(gaps) == 3
    (tmp_path / "a.warc").write_bytes(b"".join(good) + PARTS[1])
    found = [(r.record_id, bytes(r.payload), r.payload_bytes) for r in warc.read(spark, str(tmp_path)).orderBy("start").collect()]
    assert found == [("urn:uuid:0c5f-9a", x, len(x)) for x in got[:3]] + [("urn:page:1", BODY[1], len(BODY[1]))]


def test_many_members_take_linear_time():
    import os
    import time

    def spent(n):
        data = b"".join(gzip.compress(warc.header(i, "u", "response", b, None) + b + warc.END, 1) for i in range(n) for b in [os.urandom(30_000)])
        began = time.perf_counter()
        assert len(records(data)[0]) == n
        return time.perf_counter() - began

    assert spent(2000) < max(6.0, 12 * spent(400))
