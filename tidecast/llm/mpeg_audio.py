"""Media columns of MPEG audio: write, resynchronise, parse, verify.

The writer stores bytes as ancillary data of silent frames (version 1, layer III) behind an ID3v2 tag and a
variable-bitrate table. The parser reads streams of versions 1, 2 and 2.5 and layers I to III: it reads tags (ID3v2.2 to
2.4, ID3v1) and tables (Xing, Info, VBRI), finds frame headers again after damage, checks the CRCs of layer III and gives
exact durations and the byte offset of each frame. Any bytes are accepted.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: bit rates (kbit/s) by (version 1, layer) and sample rates by version bits.
BITRATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
BITRATES_OF = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): BITRATES,
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES_OF = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
#: Fixed values of the format: names of version 2.2 tags in later versions, and text encodings of tags.
OLD_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TXX": "TXXX"}
ENCODINGS = ["latin-1", "utf-16", "utf-16-be", "utf-8"]
SIDE_BYTES = {True: 17, False: 32}  # one channel, two channels; version 1
HEAD = 4 + 2 + 17  # header, CRC, side information of one channel
UNIT = 64


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 and all ones at the start, as frames carry it."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def frame_bytes(bitrate: int, rate: int, padding: int) -> int:
    return 144_000 * bitrate // rate + padding


class Header(NamedTuple):
    length: int
    bitrate: int
    rate: int
    samples: int
    layer: int
    protected: bool
    #: bytes of side information (layer III)
    side: int


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """What these four bytes say of the frame they begin, or None if they begin none (or one of free bit rate)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate_at, pad = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 2 & 3, word[2] >> 1 & 1
    if version == 1 or layer == 4 or word[2] >> 4 in (0, 15) or rate_at == 3:
        return None
    one, mono = version == 3, word[3] >> 6 == 3
    bitrate, rate = BITRATES_OF[one, layer][word[2] >> 4], SAMPLE_RATES_OF[version][rate_at]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    length = (12_000 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // rate + pad
    side = 0 if layer < 3 else SIDE_BYTES[mono] if one else 9 if mono else 17
    return Header(length, bitrate, rate, samples, layer, not word[1] & 1, side)


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def unsyncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def frame(index: int, data: bytes) -> bytes:
    """A silent protected frame at 32 kHz, one channel, with ``data`` as ancillary bytes."""
    head = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0xC0])
    side = bytes(SIDE_BYTES[True])
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + data.ljust(frame_bytes(BITRATES[index], 32000, 0) - HEAD, b"\0")


ROOM = [frame_bytes(b, 32000, 0) - HEAD for b in BITRATES[1:]]
FULL = ROOM[-1] // UNIT * UNIT


def write_mpeg(payload: bytes, n_bytes: int) -> bytes:
    """Payload (a multiple of 64 bytes) as a stream; ``n_bytes`` of it are data, the rest filling."""
    text = b"\x03payload\0%d/%d" % (n_bytes, len(payload))
    body = b"TXXX" + syncsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + syncsafe(len(body)) + body
    frames = []
    for at in range(0, len(payload), FULL):
        part = payload[at : at + FULL]
        frames.append(frame(next(i for i, room in enumerate(ROOM, 1) if room >= len(part)), part))
    lengths = [len(f) for f in frames]
    table_frame = frame_bytes(BITRATES[5], 32000, 0)
    total = table_frame + sum(lengths)
    # byte place of each hundredth of the duration, in 256ths of the stream
    ends, at = [table_frame], table_frame
    for n in lengths:
        at += n
        ends.append(at)
    toc = bytes(min(255, 256 * ends[p * len(frames) // 100] // total) for p in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return tag + frame(5, table) + b"".join(frames)


def reaches_end(stream: bytes, pos: int) -> bool:
    """Whether whole frames, one right behind the other, go from ``pos`` to the end."""
    while pos < len(stream) and (head := header(stream[pos : pos + 4])):
        pos += head.length
    return pos == len(stream)


def id3_tags(stream: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag at the beginning, and where the audio begins."""
    if stream[:3] != b"ID3" or len(stream) < 10:
        return {}, 0
    major, flags, size = stream[3], stream[5], unsyncsafe(stream[6:10])
    body, tags = stream[10 : 10 + size], {}
    end = 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    if major < 4 and flags & 0x80:
        body = body.replace(b"\xff\0", b"\xff")
    at, name_bytes = 0, 3 if major == 2 else 4
    if major > 2 and flags & 0x40 and len(body) >= 4:  # an extended header
        at = unsyncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + (6 if major == 2 else 10) <= len(body) and body[at : at + name_bytes].isalnum():
        name, how = body[at : at + name_bytes].decode("ascii"), body[at + name_bytes : at + 2 * name_bytes]
        n = unsyncsafe(how) if major == 4 else int.from_bytes(how, "big")
        mark = 0 if major == 2 else body[at + 9]
        at += 6 if major == 2 else 10
        value, at = body[at : at + n], at + n
        if major == 4:
            value = value[4:] if mark & 1 else value
            value = value.replace(b"\xff\0", b"\xff") if mark & 2 else value
        name = OLD_NAMES.get(name, name)
        if not name.startswith("T") or not value:
            continue
        text = value[1:].decode(ENCODINGS[value[0]] if value[0] < 4 else "latin-1", "replace")
        if name == "TXXX":
            name, _, text = text.partition("\0")
            text = text.lstrip("\ufeff")  # each string of UTF-16 has a mark of its own
        tags[name] = text.rstrip("\0")
    return tags, min(end, len(stream))


def bitrate_table(frame: bytes, side: int, protected: bool) -> dict | None:
    """Number of frames and bytes that a first frame states instead of audio: a Xing or Info table behind the side information, or a VBRI one."""
    rest = frame[4 + 2 * protected + side :]
    if rest[:4] in (b"Xing", b"Info"):
        flags, at, table = int.from_bytes(rest[4:8], "big"), 8, {}
        for bit, name, width in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit:
                table[name] = rest[at : at + width] if name == "toc" else int.from_bytes(rest[at : at + width], "big")
                at += width
        return table
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        entries, scale, width = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58))
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)] if 0 < width <= 4 else []
        return {"bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "steps": steps}
    return None


def parse_mpeg(stream: bytes) -> dict:
    """Tags, frames, checksums and ancillary data of a stream; damage is skipped and counted.

    The table holds if its numbers of frames and of bytes (with or without the table's own frame) are those found.
    """
    tags, pos = id3_tags(stream)
    end = len(stream)
    # audio data may hold the mark of a trailing tag by chance: where the frames reach the end, there is no tag
    if end - pos >= 128 and stream[end - 128 : end - 125] == b"TAG" and not reaches_end(stream, pos):
        end -= 128
        tags.setdefault("TIT2", stream[end + 3 : end + 33].split(b"\0")[0].rstrip(b" ").decode("latin-1"))
    offsets, data, lost, bad_crc, table, samples, table_bytes, audio = [], [], 0, 0, None, {}, 0, 0
    while pos + 4 <= end:
        head = header(stream[pos : pos + 4])
        follows = head and (pos + head.length == end or pos + head.length < end and header(stream[pos + head.length : pos + head.length + 4]))
        if not follows:
            found = stream.find(b"\xff", pos + 1, end)
            found = end if found < 0 else found
            lost, pos = lost + found - pos, found
            continue
        start = pos + 4 + 2 * head.protected
        after = start + head.side
        if head.protected and head.layer == 3 and crc16(stream[pos + 2 : pos + 4] + stream[start:after]) != int.from_bytes(stream[pos + 4 : pos + 6], "big"):
            bad_crc += 1
        stated = bitrate_table(stream[pos : pos + head.length], head.side, head.protected) if not offsets and table is None and head.layer == 3 else None
        if stated is not None:
            table, table_bytes = stated, head.length
        else:
            offsets.append(pos)
            data.append(stream[after : pos + head.length])
            samples[head.rate] = samples.get(head.rate, 0) + head.samples
            audio += head.length
        pos += head.length
    lost += max(0, end - pos)
    table = table or {}
    rate = max(samples, key=lambda r: (samples[r], r), default=0)
    return {
        "tags": tags, "offsets": offsets, "ancillary": data, "lost_bytes": lost, "bad_crc": bad_crc, "samples": sum(samples.values()),
        "sample_rate": rate, "duration_s": float(sum(Fraction(n, r) for r, n in samples.items())), "table_frames": table.get("frames"), "toc": table.get("toc"), "steps": table.get("steps"),
        "table_holds": table.get("frames") == len(offsets) and table.get("bytes", audio) in (audio, audio + table_bytes),
    }


def stored_payload(parsed: dict) -> tuple[bytes, int] | None:
    """(payload, bytes of data in it) of a stream that ``write_mpeg`` wrote, else None."""
    sizes = re.fullmatch(r"([0-9]{1,18})/([0-9]{1,18})", parsed["tags"].get("payload", ""), re.ASCII)
    if not sizes:
        return None
    payload = b"".join(d[:FULL] for d in parsed["ancillary"])[: int(sizes[2])]
    return payload, int(sizes[1])


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as MPEG audio.

    Null texts count as empty (one unit of zeros); texts of any length are stored whole (a
    task holds 512 streams at once). Row by row: repeated rows and null ids stay; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                media = [write_mpeg(r.ljust(max(UNIT, -(-len(r) // UNIT) * UNIT), b"\0"), len(r)) for r in raw]
                yield pa.record_batch([part.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, media binary")


def media_columns(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Parsed columns of a media column, one row per stream; null streams count as empty ones, an empty table gives no rows.

    ``seek_offsets`` has the byte offset of each audio frame; ``sample_rate`` is that of most samples, ``duration_s`` counts each
    frame at its own. Streams of other writers have no payload columns. Damaged stretches are counted in
    ``lost_bytes`` and frames whose checksum fails in ``bad_crc``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream in batch.column(1).to_pylist():
                stream = stream or b""
                p = parse_mpeg(stream)
                own = stored_payload(p)
                has, (payload, n_bytes) = own is not None, own or (None, None)
                out.append(
                    (n_bytes, len(payload) if has else None, sha256(payload).hexdigest() if has else None, crc32(payload[-64:]) if has else None,
                     len(stream), sha256(stream).hexdigest(), len(p["offsets"]), p["samples"], p["sample_rate"], p["duration_s"], p["lost_bytes"], p["bad_crc"],
                     p["table_holds"], p["offsets"])
                )
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in out], f.type) for i, f in enumerate(list(OUT)[1:]))], schema=OUT)

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, samples long, "
        "sample_rate long, duration_s double, lost_bytes long, bad_crc long, table_holds boolean, seek_offsets array<long>"
    )
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, schema)


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int64()), ("samples", pa.int64()), ("sample_rate", pa.int64()),
     ("duration_s", pa.float64()), ("lost_bytes", pa.int64()), ("bad_crc", pa.int64()), ("table_holds", pa.bool_()), ("seek_offsets", pa.list_(pa.int64()))]
)
