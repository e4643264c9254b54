import hashlib
import zlib

import pytest

from winnow.llm import media


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def test_checksum_is_the_containers():
    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert media.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4095, 4096, 4097, 65_000, 65_025, 70_000, 300_000])
def test_round_trip(n):
    raw = bytes(i * 7 % 251 for i in range(n))
    payload, length, about = media.decode(media.write(media.pad(raw), n))
    assert payload == raw + bytes(len(payload) - n) and length == n and len(payload) % 64 == 0 and payload
    assert about["streams"] == 2 and about["seconds"] == len(payload) / media.RATE


@pytest.mark.parametrize("n", [255, 254, 255 * 255, 255 * 255 + 1, 255 * 300])
def test_packets_over_page_ends(n):
    packets = [(b"head", 0), (b"a" * n, n), (b"", n), (b"b" * 10, n + 10)]
    s = media.read(b"".join(media.stream(9, packets)))[9]
    assert s.packets == [p for p, _ in packets] and s.granules[-1] == n + 10


def test_damage_is_found():
    data = media.write(b"x" * 6400, 6400)
    for k in (0, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            media.read(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError):
        media.read(data[:-1])
    with pytest.raises(ValueError):  # a page lost in the middle
        pages = media.stream(1, [(b"h", 0), (b"a" * 70_000, 1), (b"b" * 70_000, 2)])
        media.read(b"".join([*pages[:2], *pages[3:]]))


def test_digest(odd, empty):
    rows = media.digest(odd).collect()
    assert len(rows) == odd.count() and media.digest(empty).collect() == []
    want = sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    for r in rows:
        raw = next(t for i, t in want if i == str(r.doc_id) and len(t.encode()) == r.n_bytes).encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.payload_bytes == len(payload)
        ends = [float(t) for t in r.feature.partition("page_ends=")[2].split(",")]
        assert ends == sorted(ends) and abs(ends[-1] - len(payload) / media.RATE) < 1e-3
    same = {(r.media_sha256, r.feature) for r in rows if r.n_bytes == len("one two three")}
    assert len(same) == 1
