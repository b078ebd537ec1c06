import base64
import hashlib
import random

import pytest

from ancestra.llm import warc
from ancestra.llm.common import fresh_path


def records(n=12):
    return [warc.record(f"urn:x-page:{i}", f"http://a/{i} x", b"<p>%d WARC/1.1\r\n</p>\r\n\r\n" % i * i, "urn:x-page:3" if i % 4 == 1 else None) for i in range(n)]


def names(found):
    return [x["head"]["warc-record-id"] for x in found if "head" in x]


def covered(found, size):
    """Gaps lie inside the archive, in order."""
    gaps = [(x["offset"], x["end"]) for x in found if "reason" in x]
    assert all(0 <= a < b <= size for a, b in gaps) and gaps == sorted(gaps)
    return gaps


def test_whole_archives():
    for data in (b"".join(map(warc.member, records())), b"".join(records()), warc.member(b"".join(records())), b"".join(r if i % 2 else warc.member(r) for i, r in enumerate(records()))):
        found = list(warc.salvage(data))
        assert len(names(found)) == 12 and not covered(found, len(data))
    assert list(warc.salvage(b"")) == []


def test_damaged_member_is_one_gap():
    parts = [warc.member(r) for r in records()]
    for k in (0, 5, 11):
        start, end = sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))
        for at in (start, start + 2, start + 30, end - 3):
            data = bytearray(b"".join(parts))
            data[at] ^= 0x5A
            found = list(warc.salvage(bytes(data)))
            assert len(names(found)) == 11 and covered(found, len(data)) == [(start, end)]


def test_damaged_plain_record():
    parts = records()
    for change in (lambda b: b.replace(b"<p>6 ", b"<p>7 ", 1), lambda b: b.replace(b"Content-Length: ", b"Content-Length: 9", 1), lambda b: b[:-20], lambda b: b"junk" + b[7:]):
        data = b"".join(change(p) if i == 6 else p for i, p in enumerate(parts))
        found = list(warc.salvage(data))
        assert names(found) == [f"<urn:x-page:{i}>" for i in range(12) if i != 6] and len(covered(found, len(data))) >= 1


def test_truncated_and_random_damage():
    parts = [warc.member(r) for r in records()]
    data = b"".join(parts)
    found = list(warc.salvage(data[:-5]))
    assert len(names(found)) == 11 and covered(found, len(data)) == [(len(data) - len(parts[-1]), len(data) - 5)]
    rng = random.Random(1)
    bodies = {x["head"]["warc-record-id"]: x["block"] for x in warc.salvage(data)}
    for _ in range(200):
        b = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(b))
            if rng.random() < 0.5:
                b[at : at + rng.randrange(1, 80)] = b""
            else:
                b[at:at] = bytes(rng.choices(b"\x1f\x8b\x08WARC/1.1\r\n", k=rng.randrange(1, 30)))
        found = list(warc.salvage(bytes(b)))
        covered(found, len(b))
        assert len(names(found)) >= 12 - 4
        assert all(bodies[x["head"]["warc-record-id"]] == x["block"] for x in found if "head" in x)


def brute(rows, least=0):
    payloads = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = max(i, first.get(p, i))
    out = []
    for i, p in payloads:
        own = len(p) < least or i == first.get(p)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else first[p]))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, f"http://h/{i}", t, "x", 1) for i, t in rows], "page_id long, url string, html string, record_type string, payload_bytes int")
    return sorted(map(tuple, warc.round_trip(df, fresh_path(spark, "warc"), **options).collect()), key=repr)


def test_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "é<p>"), (4, "é<p>"), (4, "é<p>"), (None, "n"), (None, "é<p>"), (5, "x" * 300_000), (6, "x" * 300_000), (7, "WARC/1.1\r\n\r\n"), (8, "\x00\r\n")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, revisit_from=5) == brute(rows, 5)
    assert run(spark, []) == []


def test_hot_payload(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_read_quarantines_and_returns_payloads(spark, tmp_path):
    parts = [warc.member(r) for r in records()]
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + 30] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    (tmp_path / "b.warc").write_bytes(records()[2])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    gaps = [r for r in rows if r.reason]
    assert len(gaps) == 1 and (gaps[0].offset, gaps[0].gap_end) == (len(parts[0]), len(parts[0]) + len(parts[1]))
    two = [r for r in rows if r.record_id == "urn:x-page:2"]
    assert len(two) == 2 and two[0].payload == b"<p>2 WARC/1.1\r\n</p>\r\n\r\n" * 2 and two[0].payload_digest == warc.digest(two[0].payload)


def test_files_are_gzip_members(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, "http://h", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    made = warc.write_archives(df, str(tmp_path / "w")).collect()
    assert sum(r.records for r in made) == 20
    text = b"".join(gzip.decompress((tmp_path / "w" / r.file).read_bytes()) for r in made)
    assert text.count(b"WARC/1.1\r\n") == 20 and not list((tmp_path / "w").glob("_*"))


def test_windows_give_what_whole_contents_give(tmp_path, monkeypatch):
    """Files longer than a window, with members across its borders and damage everywhere, read as from memory."""
    import random

    import pyarrow as pa

    rng = random.Random(4)
    monkeypatch.setattr(warc, "STEP", 512)
    for round_ in range(20):
        parts = []
        for i in range(40):
            data = warc.record(f"urn:x-page:{i}", "http://a/b", rng.randbytes(rng.randrange(900)))
            parts.append(warc.member(data) if rng.random() < 0.6 else data)
            if rng.random() < 0.2:
                parts.append(rng.randbytes(rng.randrange(1, 1200)) + rng.choice([b"", b"\x1f\x8b", b"WARC/1.", b"WARC/1.1\r\n"]))
        content = bytearray(b"".join(parts))
        for _ in range(round_ % 4):
            content[rng.randrange(len(content))] ^= 0x55
        content = bytes(content)
        path = tmp_path / "x"
        path.write_bytes(content)
        with pa.OSFile(str(path)) as f:
            got = list(warc.salvage(warc.Source(f, len(content))))
        assert got == list(warc.salvage(content))
        assert sum(g["end"] - g["offset"] for g in got if "reason" in g) < len(content)


def test_older_versions_and_bounds(monkeypatch):
    data = warc.record("urn:x-page:1", None, b"abc")
    old = data.replace(b"WARC/1.1", b"WARC/0.18", 1)
    assert [x["head"]["warc-record-id"] for x in warc.salvage(old + data)] == ["<urn:x-page:1>"] * 2
    monkeypatch.setattr(warc, "INLINE", 100)  # sizes have no bound: larger ones pass in parts
    large = warc.record("urn:x-page:2", None, b"a" * 1000)
    got = list(warc.salvage(warc.member(large) + large))
    assert [(x["payload_bytes"], x["payload_digest"]) for x in got] == [(1000, warc.digest(b"a" * 1000))] * 2


def test_own_damaged_archives_raise(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * 100 * i) for i in range(1, 20)], "page_id long, url string, html string")
    real = warc.write_archives

    def damaged(*a, **k):
        out = real(*a, **k)
        first = next((tmp_path / "w").glob("*.warc.gz"))
        content = bytearray(first.read_bytes())
        content[len(content) // 2] ^= 0xFF
        first.write_bytes(bytes(content))
        for crc in (tmp_path / "w").glob(".*.crc"):
            crc.unlink()
        return out

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(Exception, match="came back damaged"):
        warc.round_trip(pages, str(tmp_path / "w")).collect()


def test_records_before_the_damage_of_a_member_are_kept():
    rows = [warc.record(f"urn:x-page:{i}", f"http://h/{i}", random.Random(i).randbytes(3000)) for i in range(20)]
    whole = bytearray(warc.member(b"".join(rows)))
    whole[3 * len(whole) // 4] ^= 255
    after = warc.member(warc.record("urn:x-page:99", None, b"after"))
    got = list(warc.salvage(bytes(whole) + after))
    names = [x["head"]["warc-record-id"] for x in got if "head" in x]
    assert names[:14] == [f"<urn:x-page:{i}>" for i in range(14)] and names[-1] == "<urn:x-page:99>"
    assert {x["payload_digest"] if "payload_digest" in x else warc.digest(warc.payload_of(x)) for x in got if "head" in x} <= {warc.digest(random.Random(i).randbytes(3000)) for i in range(20)} | {warc.digest(b"after")}
    assert [(x["offset"], x["end"]) for x in got if "reason" in x] == [(0, len(whole))]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("fault", [None, "block", "cut", "tail"])
def test_large_records_pass_in_parts(spark, tmp_path, monkeypatch, packed, fault):
    monkeypatch.setattr(warc, "INLINE", 1000)
    monkeypatch.setattr(warc, "STEP", 700)
    payload = random.Random(3).randbytes(20_000)
    rows = [warc.record(f"urn:x-page:{i}", None, p) for i, p in enumerate((b"small", payload, b"also small"))]
    if fault == "block":
        rows[1] = rows[1].replace(payload[5000:5004], b"xxxx")
    elif fault == "cut":
        rows[1] = rows[1][:9000]
    elif fault == "tail":
        rows[1] = rows[1][:-4] + b"oops"
    data = b"".join(map(warc.member, rows)) if packed else b"".join(rows)
    kept = []

    class Sink:
        def __init__(self):
            self.data = b""
            kept.append(self)

        def write(self, x):
            self.data += x

        def close(self):
            return self

        def drop(self):
            kept.remove(self)

    got = [x for x in warc.salvage(data, Sink) if "head" in x]
    names = [x["head"]["warc-record-id"][-2] for x in got]
    if fault is None:
        assert names == ["0", "1", "2"] and got[1]["payload_file"].data == payload and got[1]["payload_bytes"] == len(payload) and got[1]["payload_digest"] == warc.digest(payload)
        assert warc._stated_bytes(got[1]) == len(payload)
    else:
        assert names == ["0", "2"] and kept == []
    assert [x["head"]["warc-record-id"][-2] for x in warc.salvage(data) if "head" in x] == names  # without payloads
    one = warc.member(b"".join(rows))  # all in one member, whose contents are inflated again where a record fails
    assert [x["head"]["warc-record-id"][-2] for x in warc.salvage(one) if "head" in x] == names


def test_payload_files(spark, tmp_path, monkeypatch):
    payload = b"p" * (warc.INLINE + 5)
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record("urn:x-page:1", "http://h/", payload)) + warc.member(warc.record("urn:x-page:2", None, b"q")))
    rows = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    big, small = rows["urn:x-page:1"], rows["urn:x-page:2"]
    assert big.payload is None and big.payload_bytes == len(payload) and big.payload_digest == warc.digest(payload)
    store, inner = warc.filesystem(big.payload_file)
    assert store.open_input_file(inner).read() == payload
    assert bytes(small.payload) == b"q" and small.payload_file is None
