"""Packing of documents into training sequences by vector bin packing.

Each sequence has three limits at once: tokens, segments (pieces) and
loss-bearing tokens. Whole sequences are cut off long documents first; the
remaining tails are placed by the dot-product heuristic: among the tails that
fit, the one whose vector (tokens, segment, loss), each scaled by its limit,
has the largest dot product with the room left. When no tail fits whole, the
largest one is cut to close the sequence. A sequence that meets its segment or loss limit
early, and what is left over at the end of a task, is cut at powers of two, so nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .common import give_back

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
#: Tails that are packed against each other at once; bounds memory and the search per placement.
WINDOW = 4096


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], last: bool) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """Place tails into sequences: lists of (item, tokens already used, tokens taken).

    ``loss`` counts the loss-bearing tokens at the *end* of each item. Returns
    the sequences and how much of each item has been used; unless ``last``, a
    sequence that cannot be filled is not opened and its items stay over.
    """
    cap, most, loss_cap = limits
    scale = np.array([1 / cap, 1 / most, 1 / loss_cap])
    used = np.zeros(len(tokens), np.int64)
    left = tokens.astype(np.int64)
    out: list[list[tuple[int, int, int]]] = []
    live = np.flatnonzero(left > 0)
    while len(live):
        if not last and left[live].sum() < 2 * cap:
            break
        room, rows = np.array([cap, most, loss_cap], float), []
        while room[0] > 0 and room[1] > 0 and len(live):
            n = left[live]
            heavy = np.minimum(n, loss[live])
            fits = (n <= room[0]) & (heavy <= room[2])
            if fits.any():
                w = room * scale * scale
                dot = np.where(fits, n * w[0] + w[1] + heavy * w[2], -1.0)
                k = int(np.argmax(dot))
                take = int(n[k])
            else:
                k = int(np.argmax(n))
                # the head of an item bears loss only beyond its loss-free prefix
                free = int(n[k] - heavy[k])
                take = int(min(n[k], room[0], free + room[2]))
                if take <= 0:
                    break
            i = int(live[k])
            rows.append((i, int(used[i]), take))
            room -= (take, 1, max(0, take - int(n[k] - heavy[k])))
            used[i] += take
            left[i] -= take
            if not left[i]:
                live = np.delete(live, k)
        out.append(rows)
    return out, used


def powers(rows: list[tuple[int, int, int]], cap: int) -> list[list[tuple[int, int, int]]]:
    """Cut a partly filled sequence into sequences whose lengths are powers of two."""
    total, out, k = sum(r[2] for r in rows), [], 0
    if total >= cap:
        return [rows]
    rows = list(rows)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        need, part = 1 << bit, []
        while need:
            i, at, n = rows[k]
            take = min(n, need)
            part.append((i, at, take))
            need -= take
            if take == n:
                k += 1
            else:
                rows[k] = (i, at + take, n - take)
        out.append(part)
    return out


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    vocabulary: str | None = None,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 512,
    max_loss_tokens: int | None = None,
) -> DataFrame:
    """One row per placed piece; each id of each document lies in exactly one piece.

    ``prompt_col`` may count the leading characters of a text that bear no loss
    (the instruction part); by default all tokens bear loss. Null texts count
    as empty: a document of one end id. Repeated rows are packed as often as
    they occur; an empty table gives no pieces. Texts of any length are cut into whole sequences first; of equal candidates the
    first read is placed. No shuffle: each task packs what it reads, in windows of
    ``WINDOW`` tails, and sequence ids carry the task's number.
    """
    vocabulary = vocabulary or default_vocabulary()
    limits = (max_tokens, max_segments, max_loss_tokens or max_tokens)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # doc, ids, first token of the rest, loss from there on
        rows: list[tuple] = []

        def put(doc, ids: bytes, start: int, length: int, free: int, offset: int) -> None:
            piece = ids[4 * start : 4 * (start + length)]
            bearing = max(0, start + length - max(start, free))
            rows.append((doc, start, length, crc32(piece), len(ids) // 4, sequence, offset, bearing))

        def settle(last: bool) -> None:
            nonlocal held, sequence
            n = np.array([len(x[1]) // 4 - x[2] for x in held], np.int64)
            heavy = np.array([max(0, len(x[1]) // 4 - max(x[2], x[3])) for x in held], np.int64)
            placed, used = fill(n, heavy, limits, last)
            for rows_of in placed:
                full = sum(r[2] for r in rows_of) >= max_tokens
                for part in [rows_of] if full else powers(rows_of, max_tokens):
                    offset = 0
                    for i, at, take in part:
                        doc, ids, start, free = held[i]
                        put(doc, ids, start + at, take, free, offset)
                        offset += take
                    sequence += 1
            held = [(d, ids, s + int(u), f) for (d, ids, s, f), u in zip(held, used) if s + u < len(ids) // 4]

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=NAMES)
                rows.clear()

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple]:
            """(document, ids, length of the loss-free prefix) of each row, some rows at a time."""
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                docs, texts, prompts = (c.to_pylist() for c in part.columns)
                cuts = [max(0, p or 0) for p in prompts]
                texts = [t or "" for t in texts]
                heads = enc.encode_all([t[:c] for t, c in zip(texts, cuts)]) if any(cuts) else [b""] * len(texts)
                bodies = enc.encode_all([t[c:] for t, c in zip(texts, cuts)])
                for doc, head, body in zip(docs, heads, bodies):
                    yield doc, head + body + end, len(head) // 4

        for batch in batches:
            for doc, ids, free in encoded(batch):
                total, start = len(ids) // 4, 0
                while total - start >= max_tokens and limits[2] >= max_tokens:
                    put(doc, ids, start, max_tokens, free, 0)
                    sequence += 1
                    start += max_tokens
                if start < total:
                    held.append((doc, ids, start, free))
                if len(held) >= WINDOW:
                    settle(False)
                if len(rows) >= 20_000:
                    yield from flush()
        settle(True)
        yield from flush()
        give_back()

    prompt = F.col(prompt_col).cast("int") if prompt_col else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), prompt.alias("prompt"))
    return rows.mapInArrow(run, SCHEMA)


def instruction_examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", answer: str = "assistant") -> DataFrame:
    """``doc_id, text, prompt``: each answer with the turn before it, which bears no loss (``prompt`` has its characters).

    An answer without a turn before it stands alone. Of several rows of one turn the largest (role, text) counts; rows without a
    conversation or turn are left out; null texts count as empty. ``doc_id`` is conversation * 2^20 + turn. No conversation is held in one task.
    """
    key = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.struct(F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("x"))
    one = key.where("c is not null and t is not null").groupBy("c", "t").agg(F.max("x").alias("x"))
    asked = one.select(F.col("c").alias("c0"), F.col("t").alias("t0"), F.concat(F.col("x.text"), F.lit("\n")).alias("before"))
    both = one.where(F.col("x.role") == answer).join(asked, (F.col("c") == F.col("c0")) & (F.col("t") - 1 == F.col("t0")), "left").withColumn("before", F.coalesce("before", F.lit("")))
    return both.select((F.col("c") * (1 << 20) + F.col("t")).alias("doc_id"), F.concat("before", "x.text").alias("text"), F.length("before").alias("prompt"))
