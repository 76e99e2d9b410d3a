"""MPEG audio: marks of tags and headers anywhere in the data lose nothing."""

import hashlib
import random
import struct

import pytest

from tidecast.llm import mpeg_audio


def restored(payload):
    stream = mpeg_audio.write_mpeg(payload, len(payload))
    parsed = mpeg_audio.parse_mpeg(stream)
    assert parsed["lost_bytes"] == 0 and parsed["bad_crc"] == 0 and parsed["table_frames"] == len(parsed["offsets"])
    return mpeg_audio.stored_payload(parsed)[0]


@pytest.mark.parametrize("mark", [b"TAG", b"ID3", b"Xing", b"\xff\xfb\x90\x00", b"\xff\xfa"])
def test_marks_at_every_place(mark):
    for size in (64, 128, 192, 320, 640, 1408, 1472, 1536):
        for at in range(size - len(mark) + 1):
            payload = b"x" * at + mark + b"y" * (size - len(mark) - at)
            assert restored(payload) == payload, (size, at)


def test_trailing_tag_is_read():
    stream = mpeg_audio.write_mpeg(b"z" * 640, 640)
    tag = b"TAG" + b"a title".ljust(30, b"\0") + bytes(95)
    parsed = mpeg_audio.parse_mpeg(stream + tag)
    assert parsed["tags"]["TIT2"] == "a title" and parsed["lost_bytes"] == 0 and mpeg_audio.stored_payload(parsed)[0] == b"z" * 640


def test_whole_table_equals_the_padded_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    rows = mpeg_audio.media_columns(mpeg_audio.store_media(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
    assert mpeg_audio.media_columns(mpeg_audio.store_media(docs.limit(0))).count() == 0


def silent(version, layer, index, rate_at, pad=0, mono=True, protected=False, fill=b""):
    """A frame of these header bits with ``fill`` behind its header, and its length and samples as the format has them."""
    bits = {"1": 3, "2": 2, "2.5": 0}[version]
    word = bytes([0xFF, 0xE0 | bits << 3 | (4 - layer) << 1 | (not protected), index << 4 | rate_at << 2 | pad << 1, 0xC0 if mono else 0])
    head = mpeg_audio.header(word)
    return word + fill.ljust(head.length - 4, b"\0"), head


@pytest.mark.parametrize(
    "version,layer,index,rate_at,length,samples,rate",
    [("1", 3, 9, 0, 417, 1152, 44100), ("1", 3, 14, 1, 960, 1152, 48000), ("2", 3, 8, 0, 208, 576, 22050), ("2.5", 3, 8, 2, 576, 576, 8000), ("1", 2, 8, 1, 384, 1152, 48000), ("2", 2, 8, 2, 576, 1152, 16000), ("1", 1, 8, 2, 384, 384, 32000), ("2", 1, 8, 1, 256, 384, 24000)],
)
def test_every_kind_of_frame(version, layer, index, rate_at, length, samples, rate):
    frame, head = silent(version, layer, index, rate_at)
    assert (head.length, head.samples, head.rate) == (length, samples, rate)
    parsed = mpeg_audio.parse_mpeg(b"junk" + frame * 7)
    assert parsed["lost_bytes"] == 4 and parsed["offsets"] == [4 + length * i for i in range(7)] and parsed["duration_s"] == pytest.approx(7 * samples / rate, abs=1e-15)


def test_mixed_rates_count_at_their_own():
    parts = [silent("1", 3, 9, 0)[0]] * 3 + [silent("2", 3, 8, 0)[0]] * 5 + [silent("1", 3, 9, 2)[0]] * 2
    parsed = mpeg_audio.parse_mpeg(b"".join(parts))
    assert parsed["duration_s"] == pytest.approx(3 * 1152 / 44100 + 5 * 576 / 22050 + 2 * 1152 / 32000) and parsed["samples"] == 5 * 1152 + 5 * 576


def tag(major, frames, flags=0):
    body = b"".join(frames)
    return b"ID3" + bytes([major, 0, flags]) + mpeg_audio.syncsafe(len(body)) + body


def test_tags_of_all_versions():
    audio = silent("1", 3, 9, 0)[0] * 3
    long = "t" * 300
    three = tag(3, [b"TIT2" + (301).to_bytes(4, "big") + b"\0\0\0" + long.encode(), b"TPE1" + (13).to_bytes(4, "big") + b"\0\0\1" + "größe".encode("utf-16")])
    four = tag(4, [b"TIT2" + mpeg_audio.syncsafe(301) + b"\0\0\3" + long.encode(), b"TPE1" + mpeg_audio.syncsafe(11) + b"\0\0\2" + "größe".encode("utf-16-be")])
    two = tag(2, [b"TT2" + (301).to_bytes(3, "big") + b"\0" + long.encode(), b"TP1" + (6).to_bytes(3, "big") + b"\0" + "größe".encode("latin-1")])
    loose = tag(3, [b"TIT2" + (301).to_bytes(4, "big") + b"\0\0\0" + long.encode(), b"TPE1" + (13).to_bytes(4, "big") + b"\0\0\1" + "größe".encode("utf-16").replace(b"\xff", b"\xff\0")], 0x80)
    extended = tag(3, [(6).to_bytes(4, "big") + bytes(6), b"TIT2" + (301).to_bytes(4, "big") + b"\0\0\0" + long.encode(), b"TPE1" + (6).to_bytes(4, "big") + b"\0\0\0" + "größe".encode("latin-1")], 0x40)
    for head in (two, three, four, loose, extended):
        parsed = mpeg_audio.parse_mpeg(head + audio)
        assert parsed["tags"] == {"TIT2": long, "TPE1": "größe"} and len(parsed["offsets"]) == 3 and parsed["lost_bytes"] == 0


def test_tables_are_held_against_the_frames():
    frame, head = silent("1", 3, 9, 0)
    vbri = bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 6 * head.length, 6, 2, 1, 2, 3) + struct.pack(">HH", 3 * head.length, 3 * head.length)
    xing = bytes(17) + b"Info" + struct.pack(">III", 3, 6, 7 * head.length)
    for fill in (vbri, xing):
        table = silent("1", 3, 9, 0, fill=fill)[0]
        whole = mpeg_audio.parse_mpeg(table + frame * 6)
        assert whole["table_frames"] == 6 and whole["table_holds"] and len(whole["offsets"]) == 6
        assert not mpeg_audio.parse_mpeg(table + frame * 5)["table_holds"]
    assert mpeg_audio.parse_mpeg(silent("1", 3, 9, 0, fill=vbri)[0] + frame * 6)["steps"] == [3 * head.length] * 2


def test_foreign_payload_tags_and_any_bytes(spark):
    audio = silent("1", 3, 9, 0)[0] * 3
    for value in (b"hello", b"1/x", b"9" * 30 + b"/1", b"", b"\xff\xfe"):
        text = b"\3payload\0" + value
        stream = tag(4, [b"TXXX" + mpeg_audio.syncsafe(len(text)) + b"\0\0" + text]) + audio
        assert mpeg_audio.stored_payload(mpeg_audio.parse_mpeg(stream)) is None
    rows = spark.createDataFrame([(1, bytearray(stream)), (2, None), (3, bytearray(b"ID3"))], "doc_id long, media binary")
    assert {(r.doc_id, r.payload_bytes, r.frames) for r in mpeg_audio.media_columns(rows).collect()} == {(1, None, 3), (2, None, 0), (3, None, 0)}
    rng = random.Random(1)
    pieces = [b"ID3", b"TAG", b"Xing", b"VBRI", b"TXXX", b"\xff\xfb\x90\x00", b"\xff\xf3\x80\xc0", b"\x04\0\0", b"\2\0\0", b"\0\0\0\x20", audio[:417]]
    for _ in range(3000):
        data = b"".join(rng.choice([rng.randbytes(rng.randint(0, 40)), rng.choice(pieces)]) for _ in range(rng.randint(0, 9)))
        parsed = mpeg_audio.parse_mpeg(data)
        assert 0 <= parsed["lost_bytes"] <= len(data)
