import base64
import gzip
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _records(n, seed=1):
    rng = random.Random(seed)
    payloads = [("WARC/1.1\r\n" if i % 3 == 0 else "") + "é<p>" * rng.randint(0, 200) for i in range(n)]
    return [warc.record(i, f"http://h/{i}", p.encode(), digest(p.encode()), None, "2000-01-01T00:00:00Z")
            for i, p in enumerate(payloads)]


def _ids(data):
    return [f.headers["warc-record-id"] for f in warc.salvage(data) if f.headers]


def test_whole_archives_are_read_whole():
    for pack in (warc.member, bytes):
        records = _records(20)
        data = b"".join(map(pack, records))
        assert _ids(data) == [f"<urn:page:{i}>" for i in range(20)]
        assert not [f for f in warc.salvage(data) if f.reason]
    mixed = warc._EMPTY_MEMBER.join(map(warc.member, records))
    assert _ids(mixed) == [f"<urn:page:{i}>" for i in range(20)] and gzip.decompress(mixed) == b"".join(records)
    assert list(warc.salvage(b"")) == []


@settings(max_examples=80, deadline=None)
@given(st.booleans(), st.integers(0, 7), st.integers(0, 10_000), st.integers(1, 30), st.sampled_from(["flip", "cut", "add"]))
def test_damage_costs_only_what_it_touches(packed, victim, place, size, kind):
    records = [warc.member(r) if packed else r for r in _records(8)]
    hurt = bytearray(records[victim])
    at = place % len(hurt)
    if kind == "flip":
        for i in range(at, min(len(hurt), at + size)):
            hurt[i] ^= 0x5A
    elif kind == "cut":
        del hurt[at:at + size]
    else:
        hurt[at:at] = b"\x00\xff" * size
    data = b"".join([*records[:victim], bytes(hurt), *records[victim + 1:]])
    others = [f"<urn:page:{i}>" for i in range(8) if i != victim]
    # (a header of an uncompressed record has no checksum, so that the damaged record's own id may differ)
    assert [i for i in _ids(data) if i in others] == others
    blocks = [f.block for x in _records(8) for f in warc.salvage(x)]
    digests = [f.headers.get("warc-block-digest") for f in warc.salvage(data) if f.headers]
    assert all(f.block in blocks for f in warc.salvage(data) if f.headers) or not all(digests)
    gaps = [f for f in warc.salvage(data) if f.reason]
    first = sum(map(len, records[:victim]))
    assert all(first <= g.start and g.end <= first + len(hurt) for g in gaps)


def test_gap_reasons_and_bounds():
    records = _records(3)
    data = records[0] + b"garbage\n" + records[1] + records[2][:-20]
    kinds = [(f.start, f.end, f.reason) for f in warc.salvage(data) if f.reason]
    a, b = len(records[0]), len(records[0]) + 8
    assert kinds == [(a, b, "no version line"), (b + len(records[1]), len(data), "record cut off")]


def test_pages_round_trip(spark, tmp_dir):
    html = "<p>" + "long text é " * 20_000
    rows = [(4, "http://a/x y\r\n", "<b>é</b>", 1), (2, "http://b", "<b>é</b>", 1), (3, None, None, 1), (9, "u", "", 1),
            (7, "u", html, 1), (8, "u", html, 1), (None, "n", "<b>é</b>", 1), (None, "n", "alone", 1), (2, "again", "<b>é</b>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    warc.write(warc.planned(pages), f"{tmp_dir}/w")
    found = warc.read_back(spark, f"{tmp_dir}/w").collect()
    assert not [r for r in found if r["reason"]]
    wanted = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        same = [j for j, _, k, _ in rows if (k or "").encode() == p and j is not None]
        first = min(same, default=None)
        wanted.append((str(i), len(p), digest(p), "response" if i == first else "revisit", None if i == first else first))
    got = [(str(r["page"]), r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert all(digest(r["payload"]) == r["digest"] for r in found if r["record_type"] == "response")
    assert {r["url"] for r in found if r["page"] == 4} == {"http://a/x%20y%0D%0A"}


def test_long_payloads_alone_are_revisited(spark, tmp_dir):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                                  "page_id long, url string, html string")
    plan = {r["id"]: r["first"] for r in warc.planned(pages, revisit_from=3).collect()}
    assert plan == {1: None, 2: None, 3: None, 4: 3}
    warc.write(warc.planned(pages.where("false")), f"{tmp_dir}/none")
    assert warc.planned(pages.where("false")).count() == 0


def _wide(ids, digests=True):
    """Records with random payloads, which hardly pack, so that a fault stays where it is."""
    rng = random.Random(3)
    found = []
    for i in ids:
        payload = rng.randbytes(3_000).hex().encode()
        r = warc.record(i, f"http://h/{i}", payload, digest(payload), None, "2000-01-01T00:00:00Z")
        found.append(r if digests else b"\r\n".join(x for x in r.split(b"\r\n") if b"-Digest: " not in x))
    return found


def _kept(data):
    return [int(i.rpartition(":")[2].strip(">")) for i in _ids(data)]


def test_bad_record_inside_a_member():
    records = _wide(range(6))
    records[2] = records[2][:-100] + b"#" + records[2][-99:]
    records[4] = b"garbage\n" + records[4]
    for data in (warc.member(b"".join(records)), warc.member(b"".join(records)) + warc.member(_records(1)[0])):
        assert _kept(data)[:5] == [0, 1, 3, 4, 5] and len(_kept(data)) == (5 if data.count(warc._MEMBER) == 1 else 6)
        gaps = [f.reason for f in warc.salvage(data) if f.reason]
        at = len(records[0]) + len(records[1])
        after = sum(map(len, records[:4]))
        assert gaps == [f"wrong warc-block-digest (unpacked bytes {at} to {at + len(records[2])})",
                        f"no version line (unpacked bytes {after} to {after + 8})"]


def test_cut_or_corrupt_member_keeps_what_unpacks():
    for digests in (True, False):
        records = _wide(range(6), digests)
        whole = b"".join(records)
        packed = warc.member(whole)
        tail = warc.member(_records(1)[0])
        for data in (packed[:len(packed) * 7 // 12], packed[:len(packed) * 7 // 12] + tail):
            assert _kept(data)[:3] == [0, 1, 2] and len(_kept(data)) == 3 + data.endswith(tail)
            gaps = [f for f in warc.salvage(data) if f.reason]
            assert len(gaps) == 1 and gaps[0].reason.startswith(
                f"member cut off (unpacked bytes {len(whole) // 2} to ")
        assert _kept(packed[:-8]) == list(range(6))
    records = _wide(range(6))
    packed = warc.member(b"".join(records))
    middle = len(packed) * 7 // 12
    hurt = packed[:middle] + b"\xff" * 40 + packed[middle + 40:]
    assert _kept(hurt)[:3] == [0, 1, 2] and 3 not in _kept(hurt) and _kept(hurt + tail)[-1] == 0
    wrong_sum = packed[:-8] + b"\0\0\0\0" + packed[-4:]
    assert _kept(wrong_sum) == list(range(6)) and [f.reason for f in warc.salvage(wrong_sum) if f.reason]
    packed = warc.member(b"".join(_wide(range(6), False)))  # without a digest nothing proves them
    assert _kept(packed[:-8] + b"\0\0\0\0" + packed[-4:]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2), st.integers(0, 100_000), st.integers(1, 30), st.sampled_from(["flip", "cut", "add"]))
def test_damage_to_members_of_several_records(victim, place, size, kind):
    packs = [warc.member(b"".join(_wide(range(4 * k, 4 * k + 4)))) for k in range(3)]
    hurt = bytearray(packs[victim])
    at = place % len(hurt)
    if kind == "flip":
        hurt[at:at + size] = bytes(x ^ 0x5A for x in hurt[at:at + size])
    elif kind == "cut":
        del hurt[at:at + size]
    else:
        hurt[at:at] = b"\x00\xff" * size
    data = b"".join([*packs[:victim], bytes(hurt), *packs[victim + 1:]])
    others = [i for i in range(12) if i // 4 != victim]
    assert [i for i in _kept(data) if i in others] == others
    blocks = {f.block for k in range(3) for f in warc.salvage(b"".join(_wide(range(4 * k, 4 * k + 4))))}
    assert all(f.block in blocks for f in warc.salvage(data) if f.headers)
    # (the payloads pack evenly: what ends well before the damage is there)
    ahead = [4 * victim + k for k in range(4) if (k + 1) / 4 < at / len(packs[victim]) - 0.05]
    assert at < 200 or [i for i in _kept(data) if i in ahead] == ahead


NUMBERS = ["9" * 5000, "-5", "", "1e3", "٣", "99999999999999999999", "0x10", " 7 7", "9" * 18]


def test_impossible_numbers_are_gaps(spark, tmp_dir):
    good = _records(4)
    revisit = warc.record(9, "http://h/9", b"x", digest(b"x"), 3, "2000-01-01T00:00:00Z")
    for name in (b"Content-Length: ", b"X-Payload-Length: "):
        for number in NUMBERS:
            line = next(x for x in revisit.split(b"\r\n") if x.startswith(name))
            hurt = revisit.replace(line, name + number.encode())
            for pack in (bytes, warc.member):
                data = b"".join(map(pack, [*good[:2], hurt, *good[2:]]))
                found = list(warc.salvage(data))
                assert [f.headers["warc-record-id"] for f in found if f.headers][:2] == ["<urn:page:0>", "<urn:page:1>"]
                assert {"<urn:page:2>", "<urn:page:3>"} <= {f.headers["warc-record-id"] for f in found if f.headers}
                if not (name == b"X-Payload-Length: " and number == "9" * 18):
                    assert sum(f.reason is not None for f in found) == 1, (name, number)
    # ids beyond 64 bits are no page numbers, and no reason to fail
    far = good[0].replace(b"urn:page:0", b"urn:page:" + b"9" * 30)
    with open(f"{tmp_dir}/far.warc", "wb") as f:
        f.write(far + good[1])
    assert sorted((r["page"], r["reason"]) for r in warc.read_back(spark, tmp_dir).collect() if r["page"] is not None) == [(1, None)]
    assert warc.read_back(spark, tmp_dir).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.booleans(), st.lists(st.tuples(st.integers(0, 260), st.integers(0, 255)), min_size=1, max_size=6))
def test_header_bytes_never_raise(packed, changes):
    records = _records(3)
    hurt = bytearray(records[1])
    for at, value in changes:
        hurt[at % len(hurt)] = value
    data = b"".join((warc.member if packed else bytes)(bytes(x)) for x in (records[0], hurt, records[2]))
    found = list(warc.salvage(data))
    assert found[0].headers["warc-record-id"] == "<urn:page:0>" and found[-1].headers["warc-record-id"] == "<urn:page:2>"


def test_long_headers_without_end_are_bounded():
    data = (b"WARC/1.1\r\nX: " + b"y" * 2000) * 300
    assert [f.reason for f in warc.salvage(data)] == ["header without end"]


def test_files_are_bounded_by_bytes(spark, tmp_dir):
    rng = random.Random(5)
    big = spark.createDataFrame([(i, f"u{i}", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1 << 20))) for i in range(9)],
                                "page_id long, url string, html string").coalesce(1)
    warc.write(warc.planned(big), f"{tmp_dir}/a", file_bytes=2 << 20)
    import os
    sizes = [os.path.getsize(f"{tmp_dir}/a/{f}") for f in os.listdir(f"{tmp_dir}/a") if f.startswith("part-")]
    assert len(sizes) >= 3 and max(sizes) < 2.2 * (1 << 20)
    found = warc.read_back(spark, f"{tmp_dir}/a", with_payload=False).collect()
    assert sorted(r["page"] for r in found) == list(range(9)) and not any(r["reason"] for r in found)
    # copies of one payload, a hot digest
    same = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, null, 'same') AS html")
    plan = {r["id"]: r["first"] for r in warc.planned(same).collect()}
    assert plan == {i: (None if i in (0, 1) else 0 if i % 3 == 0 else 1) for i in range(400)}
