"""ARC conversion and chat layouts."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest

from tessera.llm import chat as H
from tessera.llm import warc as W

HTTP = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nwith\nlines"


def _v1() -> bytes:
    about = b"1 0 maker\nURL IP-address Archive-date Content-type Archive-length\n"
    return b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(about) + about + b"\nhttp://h/a 1.2.3.4 20010203040507 text/html %d\n" % len(HTTP) + HTTP + b"\ndns:h 1.2.3.4 200102030405 text/dns 3\nabc\n\n"


def test_version_1() -> None:
    rows = [dict(zip([c.split()[0] for c in W.SCHEMA.split(", ")], W.record(*r))) for r in W.read(_v1())]
    assert [r["warc_type"] for r in rows] == ["warcinfo", "response", "response"]
    assert rows[1]["warc_date"] == "2001-02-03T04:05:07Z" and rows[2]["warc_date"] == "2001-02-03T04:05:00Z"
    assert rows[1]["content_length"] == len(HTTP) and rows[1]["warc_payload_digest"] == "sha256:" + hashlib.sha256(b"body\nwith\nlines").hexdigest()
    assert rows[1]["warc_ip_address"] == "1.2.3.4" and rows[2]["content_type"] == "text/dns" and all(r["note"] is None for r in rows)


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(version: int, compressed: bool) -> None:
    records = [(f"http://h/{i}", "1.1.1.1", "20040506070809", "text/html", bytes([10, i % 256]) * i) for i in range(40)]
    heads = list(W.read(W.write_arc("n.arc", version, records, compressed)))
    assert heads[0][0]["url"] == "filedesc://n.arc"
    assert [(h["url"], h["ip"], h["date"], h["mime"], block) for h, block, wrong in heads[1:] if not wrong] == records
    assert [len(h) for h, _, _ in heads[1:]] == [len(W.FIELDS[version])] * 40


def _parsed(raw: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, by their lengths."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        at = end + 4 + int(fields["Content-Length"])
        out.append((fields, raw[end + 4 : at]))
        assert first == "WARC/1.0" and raw[at : at + 4] == b"\r\n\r\n"
        at += 4
    return out


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_written_warc_files(spark, tmp_path, compression: str) -> None:
    """All bytes come back, those that are no text too."""
    records = [(f"http://h/{i}", "1.1.1.1", "20040506070809", "image/x", bytes(range(256)) * (i % 3) + b"\r\n\r\n\xff\n" * (i % 2)) for i in range(30)]
    df = spark.createDataFrame([(W.write_arc("n.arc", 1, records[:20]),), (W.write_arc("m.arc", 2, records[20:], True),), (_v1(),)], "archive binary")
    W.write_warc(W.convert(df), str(tmp_path / "w"), compression)
    files = [p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    got = [r for f in files for r in _parsed(gzip.decompress(f) if compression == "gzip" else f)]
    assert sorted((f["WARC-Target-URI"], b) for f, b in got if f["WARC-Type"] == "resource") == sorted((r[0], r[4]) for r in records)
    assert ("http://h/a", HTTP) in [(f.get("WARC-Target-URI"), b) for f, b in got] and len(got) == 30 + 3 + 2
    assert all(f["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest() for f, b in got)


def _fields(*r) -> dict:
    return dict(zip([c.split()[0] for c in W.SCHEMA.split(", ")], W.record(*r)))


def test_content_forges_no_records() -> None:
    """Neither in the block of a record with an odd date, nor after a line that is no header."""
    body = b"http://evil/ 6.6.6.6 20010203040506 text/html 3\nfoo"
    data = b"http://h/ 1.2.3.4 - text/html %d\n" % len(body) + body + b"\nhttp://h/2 1.2.3.4 20010203040506 text/html 2\nok\n"
    got = [_fields(*r) for r in W.read(data)]
    assert [(r["warc_target_uri"], r["note"], r["content_length"]) for r in got] == [("http://h/", "date", len(body)), ("http://h/2", None, 2)]
    broken = b"http://h/ 1.2.3.4 20010203040506 text/html x\n" + body
    got = [_fields(*r) for r in W.read(broken)]
    assert len(got) == 1 and got[0]["note"] == "header" and got[0]["warc_target_uri"].startswith("urn:arc-unparsed:") and broken in got[0]["record"]


def test_damaged_gzip_members() -> None:
    records = [(f"http://h/{i}", "1.1.1.1", "20040506070809", "t", bytes([65 + i]) * 5000) for i in range(3)]
    parts = [W.write_arc("n", 1, records[:i], True) for i in range(4)]
    cut = parts[3][:-9]  # the last member's end is lost
    got = [_fields(*r) for r in W.read(cut)]
    assert [r["note"] for r in got] == [None, None, None, "truncated"]
    torn = bytearray(parts[3])
    at = len(parts[1]) + 20
    torn[at : at + 8] = b"\xff" * 8  # within the second record's member
    got = [_fields(*r) for r in W.read(bytes(torn))]
    assert got[1]["warc_target_uri"] == "http://h/0" and got[-1]["warc_target_uri"] == "http://h/2" and got[-1]["note"] is None
    assert all(r["note"] in ("truncated", "header") for r in got[2:-1])


def test_damaged_archives(spark) -> None:
    bad = b"http://h/q 1.2.3.4 20011399000000 text/html 4\nabcd\nh/b c 1.2.3.4 20010203040506 text/plain 99\nshort"
    rows = [(bad, 1), (None, 2), (b"", 3), (b"no line end", 4), (_v1(), 5), (_v1(), 5), (W.write_arc("l", 1, [("http://l/", "1.1.1.1", "20010203040506", "t", b"x" * 5_000_000)]), 6), (b"\n\r\n", 7)]
    df = spark.createDataFrame(rows, "archive binary, warc_type int").selectExpr("*", "1 record", "2 note")
    got = W.convert(df).collect()
    by = {r["warc_target_uri"]: r for r in got}
    assert by["http://h/q"]["note"] == "date" and by["http://h/q"]["warc_date"] == "1970-01-01T00:00:00Z"
    assert by["h/b c"]["note"] == "truncated" and by["h/b c"]["content_length"] == 5 and by["h/b c"]["warc_type"] == "resource"
    assert by["http://l/"]["content_length"] == 5_000_000 and len(got) == 2 + 1 + 6 + 2
    assert W.convert(df.limit(0)).count() == 0


def test_odd_pages(spark) -> None:
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "http://a/b c\r\nd", None), (None, "http://n", "y"), (4, "http://n", ""), (4, "http://n", ""), (5, "example.com/a", "z")], "page_id long, url string, html string").selectExpr("*", "1 archive", "2 host")
    got = [r["warc_target_uri"] for r in W.convert(W.archives(df)).where("warc_type <> 'warcinfo' and warc_target_uri not like 'dns:%'").collect()]
    assert sorted(got) == ["example.com/a", "http://a/b%20c%0D%0Ad", "http://n", "http://n", "http://n"]
    assert W.archives(df.limit(0)).count() == 0


LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "hi"}, {"role": "Assistant", "content": "yo"}]},
    "from_value": {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
    "speaker": {"dialog": {"lang": "xx", "turns": [{"speaker": "User", "utterance": "hi"}, {"speaker": "Bot", "utterance": "yo"}]}},
    "instruction": {"output": "yo", "instruction": "hi"},
    "prompt_completion": {"prompt": "hi", "completion": "yo"},
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(spark, layout: str) -> None:
    df = spark.createDataFrame([(1, json.dumps(LAYOUTS[layout]))], "conv_id long, record string")
    assert [tuple(r)[1:] for r in H.turns(df).orderBy("turn").collect()] == [(layout, 0, "user", "hi"), (layout, 1, "assistant", "yo")]


def test_layouts_with_further_fields(spark) -> None:
    """Common layouts as they come: with ids, names, metadata of any depth, an input beside the instruction."""
    two = [(0, "user", "hi"), (1, "assistant", "yo")]
    rows = {
        "messages": ({"id": 3, "messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": "yo"}], "metadata": {"a": {"b": [{"c": 1}]}}, "source": "s"}, two),
        "from_value": ({"id": "x1", "conversations": [{"from": "human", "value": "hi", "weight": 1}, {"from": "gpt", "value": "yo"}]}, two),
        "system_from_value": ({"id": "x1", "system": "be", "conversations": [{"from": "human", "value": "hi"}]}, [(0, "system", "be"), (1, "user", "hi")]),
        "instruction_input": ({"instruction": "hi", "input": "there", "output": "yo", "category": "q"}, [(0, "user", "hi\n\nthere"), (1, "assistant", "yo")]),
        "prompt_response": ({"prompt": "hi", "response": "yo", "tags": ["a", "b"]}, two),
        "speaker": ({"dialog": {"turns": [{"speaker": "User", "utterance": "hi"}, {"speaker": "bot", "utterance": "yo"}]}}, two),
        "prompt": ({"prompt": "hi", "url": None, "meta": {}}, two[:1]),
        "unknown": ({"prompt": "hi", "surprise": 1}, [(None, None, json.dumps({"prompt": "hi", "surprise": 1}))]),
    }
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(rows.values())], "conv_id long, record string")
    got: dict = {}
    for r in H.turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r["layout"], []).append((r["turn"], r["role"], r["text"]))
    assert got == {k: want for k, (_, want) in rows.items()}


def test_odd_records(spark) -> None:
    rows = [(1, None), (2, ""), (3, "{no json"), (4, '{"other": 1}'), (5, '{"messages": []}'), (6, '{"messages": [{"role": "user", "content": null}]}'), (7, '{"prompt": "p", "completion": null}'), (8, '{"messages": [{"role": null, "content": "c"}]}'), (9, json.dumps({"prompt": "x" * 2_000_000})), (None, '{"prompt": "q"}'), (10, '{"messages": [{"role": "Robot", "content": "r"}]}')]
    df = spark.createDataFrame([*rows, rows[-1]], "conv_id long, record string").selectExpr("*", "1 v", "2 list", "3 layout", "4 print")
    got: dict = {}
    for r in H.turns(df).collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["turn"], r["role"], r["text"]))
    assert [got[i] for i in (1, 2, 3)] == [[("invalid", None, None, x)] for x in (None, "", "{no json")]
    assert [got[i] for i in (4, 5)] == [[("unknown", None, None, x)] for x in ('{"other": 1}', '{"messages": []}')]
    assert got[6] == [("messages", 0, "user", None)] and got[7] == [("prompt_completion", 0, "user", "p")] and got[8] == [("messages", 0, None, "c")]
    assert len(got[9][0][3]) == 2_000_000 and got[None] == [("prompt", 0, "user", "q")] and got[10] == [("messages", 0, "robot", "r")] * 2
    assert H.turns(df.limit(0)).count() == 0


def test_records_round_trip_with_nulls(spark) -> None:
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "b"), (3, 0, "user", ""), (None, 0, "user", "c"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "t"), (4, 2, "assistant", "t"), (None, 0, "user", "c"), (5, 0, "user", "early"), (5, 600, "assistant", "late"), (17, 0, "user", "q"), (17, 1, "assistant", "a"), (15, 0, "user", "q"), (15, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 t", "2 record")
    got = {(r["conv_id"], r["turn"], r["role"], r["text"]) for r in H.turns(H.records(df)).collect()}
    assert got == {(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "b"), (3, 0, "user", ""), (None, 0, "user", "c"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "t"), (4, 3, "assistant", "t"), (5, 0, "user", "early"), (5, 0, "assistant", "late"), (17, 0, "user", "q"), (17, 1, "assistant", "a"), (15, 0, "user", "q"), (15, 1, "assistant", "a")}
