"""Archives: round trips, and what is left after damage."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from groundsieve.llm import warc
from groundsieve.llm.warc import WarcOptions, base32_sha1, salvage, warc_record
from llm_tools import prose

PAGES = "page_id long, url string, html string, sha1 string, bytes string, first string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], PAGES).repartition(3)


ROWS = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (5, "http://a/\r\nX: y", "<p>é</p>"), (3, None, None),
        (4, "u", ""), (None, "n", "<p>é</p>"), (7, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (8, "v", "x" * 200_000),
        (9, "u", "same"), (9, "u", "same"), (None, "u", "alone"), (None, "u", "alone")]


def expected(rows, least=0):
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        shared = sum((g or "") == (h or "") for _, _, g in rows) > 1 and len(payload) >= least and ids
        revisit = bool(shared) and i != max(ids)
        out.append((i, len(payload), base32_sha1(payload), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [WarcOptions(), WarcOptions(file_bytes=500, compressed=False), WarcOptions(min_payload=1)])
def test_round_trip(spark, options):
    got = warc.warc_digests(frame(spark, ROWS), options).collect()
    assert sorted(map(tuple, got), key=repr) == expected(ROWS, options.min_payload)


def test_payloads_and_no_gaps(spark):
    read = warc.read_warc(warc.write_warc(frame(spark, ROWS)), with_payload=True)
    assert warc.gap_log(read).count() == 0
    assert {(r.page_id, bytes(r.payload).decode()) for r in read.where("record_type = 'response'").collect()} == {
        (i, h or "") for i, u, h in ROWS if (i, u, h) not in ROWS[:2] and (i, u, h) != ROWS[5] and i != 3}


def test_nothing(spark):
    assert warc.warc_digests(frame(spark, [])).count() == 0


def records(compressed, n=12):
    rng, out = random.Random(3), []
    for k in range(n):
        text = prose(rng, 3)
        page = {"page_id": k, "url": f"http://x/{k}", "payload": text, "sha1": hashlib.sha1(text.encode()).hexdigest(),
                "bytes": len(text), "record_type": "response", "refers_to": None}
        out.append(warc_record(page, WarcOptions(compressed=compressed)))
    return out


def read(tmp_path, data):
    path = str(tmp_path / "x.warc.gz")
    with open(path, "wb") as f:
        f.write(data)
    rows = list(salvage(path))
    # Records and gaps account for every byte, in order.
    at = 0
    for r in rows:
        assert r["at"] == at
        at += r["size"]
    assert at == len(data)
    return [r.get("page_id") for r in rows if not r["reason"]], [r for r in rows if r["reason"]]


@pytest.mark.parametrize("compressed", [True, False])
def test_damage(tmp_path, compressed):
    parts = records(compressed)
    ids, gaps = read(tmp_path, b"".join(parts))
    assert ids == list(range(12)) and not gaps
    flipped = bytearray(parts[3])
    flipped[-30] ^= 0x55
    cut = parts[6][: len(parts[6]) // 2]
    damaged = [b"junk before \x1f\x8b\x08 all", *parts[:3], bytes(flipped), *parts[4:6], cut, b"\x1f\x8b\x08" * 5, *parts[7:11], parts[11][:-9]]
    ids, gaps = read(tmp_path, b"".join(damaged))
    assert ids == [0, 1, 2, 4, 5, 7, 8, 9, 10]
    assert len(gaps) == 4 and gaps[0]["size"] == len(damaged[0]) and gaps[1]["size"] == len(flipped)
    assert gaps[2]["size"] == len(cut) + 15


def test_mixed_members_and_a_member_without_record(tmp_path):
    plain, packed = records(False), records(True)
    data = packed[0] + plain[1] + gzip.compress(b"no record in here") + plain[2] + b"\r\n" + packed[3]
    ids, gaps = read(tmp_path, data)
    assert ids == [0, 1, 2, 3] and [g["reason"] for g in gaps] == ["version line or header", "no record starts here"]


def test_random_damage_never_breaks_the_reader(tmp_path):
    rng = random.Random(12)
    for compressed in (True, False):
        data = b"".join(records(compressed, 6))
        for _ in range(60):
            hurt = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(hurt))
                if rng.random() < 0.5:
                    hurt[at] = rng.randrange(256)
                else:
                    del hurt[at: at + rng.randint(1, 300)]
            ids, _ = read(tmp_path, bytes(hurt))
            known = [i for i in ids if i is not None]  # a header may be hurt unseen
            assert known == sorted(known)


def test_long_records_become_gaps(tmp_path):
    path = str(tmp_path / "y.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(records(True, 3)))
    assert [r["reason"] for r in salvage(path, WarcOptions(max_record=50))] == ["too long"]
