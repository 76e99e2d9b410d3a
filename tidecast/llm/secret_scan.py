"""Secret scans: one Aho-Corasick pass finds keywords, anchored patterns run only at their
hits, and formats that carry a checksum are kept only if it holds.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_scan import lower

#: Kinds in their order, and the formats' patterns.
KINDS = ["assign", "access", "hex", "forge-token", "package-token", "jwt"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[opsur]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PART = re.compile(r"[A-Za-z0-9_-]+")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "forge-token": ["gho_", "ghp_", "ghr_", "ghs_", "ghu_"],
    "package-token": ["npm_"],
    "jwt": ["eyj"],
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    out = ""
    while number:
        number, digit = divmod(number, 62)
        out = BASE62[digit] + out
    return out.rjust(width, BASE62[0])


def checksum_holds(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    return base62(crc32(m[1].encode()), 6) == m[2]


def header_holds(m: re.Match) -> bool:
    """The first part of a web token decodes to a JSON object that names an algorithm."""
    try:
        header = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except ValueError:
        return False
    return isinstance(header, dict) and "alg" in header


ANCHORED = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "forge-token": (CHECKED, checksum_holds),
    "package-token": (CHECKED, checksum_holds),
    "jwt": (JWT, header_holds),
}


def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    return automaton


def find_secrets(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then kind.

    Matches of one kind do not overlap: the leftmost stands, also where it is
    then dropped for its length or checksum.
    """
    found, ends, dead = [], dict.fromkeys(KINDS, 0), 0
    hits = sorted((end + 1 - n, KINDS.index(kind)) for end, (n, kind) in automaton.iter(lower(text)))
    for start, k in hits:
        kind = KINDS[k]
        if start < ends[kind] or kind == "jwt" and start < dead:
            continue
        pattern, holds = ANCHORED[kind]
        if m := pattern.match(text, start):
            ends[kind] = m.end()
            if holds(m):
                found.append((start, m.end(), kind))
        elif kind == "jwt" and (part := PART.match(text, start)):
            dead = part.end()  # what follows the first part is missing for all hits in it
    # runs of hex digits have no keyword; a pattern of that length alone is the prefilter
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{32,}", text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds and the places of all secrets.

    Places are code points, the end exclusive. Null and empty texts have no
    secrets; long texts are searched whole, in linear time. Rows are handled one by one: repeated rows and null ids stay; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find_secrets(text, automaton) if text else []
                base = [s for s in spans if s[2] in KINDS[:3]]
                n = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                rows.append((*n, sha256(digest(base).encode()).hexdigest(), digest(spans)))
            columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.record_batch([batch.column(0), *columns], names=NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
