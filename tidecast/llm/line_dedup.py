"""Line dedup over the whole corpus, exact and within one edit, in DataFrame functions only.

A line is dropped where the same line, or a line within edit distance 1 of it, stands
earlier (by document id, then line number). The deletion neighbourhood of a line is
the set of strings left when one position is taken out; two lines are within one edit
if and only if such variants agree at one position of the longer line. Lines can be
long, so variants are emitted coarse to fine: first with half of the line taken out,
then with a block of about the square root of its length, then with one position. Each step
keeps only the (line, range) rows whose hashed key is shared with another line, which
loses no pair: what agrees outside one position agrees outside any range around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many keys or line hashes (8 or 16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, th, line_no, line``; th tells apart different texts under one id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )


def hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Keys under which different lines meet."""
    return keyed.groupBy("key").agg(F.min("h.a").alias("x"), F.max("h.a").alias("y")).where("x <> y").select("key")


def bounded_semi(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Semi join that broadcasts ``wanted`` (materialised) only if it has few rows."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, on, "left_semi")


def shared_ranges(lines: DataFrame, ranges: DataFrame, parts: Column) -> DataFrame:
    """Split each row's range [lo, hi) and keep those whose outside is shared by another line.

    ``lines``: h, line. ``ranges``: h, m (length of the longer line of a pair), lo, hi.
    A line of length m - 1 stands for the shorter line of a pair: its range is one
    position shorter. The key hashes m, the range, and the text before and after it.
    """
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / parts).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("lo")) / F.col("w")).cast("int") - 1))
    cutouts = (
        ranges.withColumn("w", width)
        .select("h", "m", F.col("hi").alias("end"), "w", F.explode(F.transform(starts, lambda k: F.col("lo") + k * F.col("w"))).alias("lo"))
        .select("h", "m", "lo", F.least(F.col("lo") + F.col("w"), F.col("end")).alias("hi"))
    )
    before = F.substring("line", F.lit(1), F.col("lo"))
    after = F.substring("line", F.col("n") - (F.col("m") - F.col("hi")) + 1, F.col("m") - F.col("hi"))
    keyed = (
        cutouts.join(lines, "h")
        .withColumn("n", F.length("line"))
        .select("h", "m", "lo", "hi", F.xxhash64("m", "lo", before, after).alias("key"))
    )
    return keyed.join(shared_keys(keyed), "key", "left_semi")


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """``doc, th, drops``: the line numbers to drop, for each document that has any."""
    rows = hashed(line_rows(docs, id_col, text_col)).where(F.length("line") > 0)
    order = F.struct("doc", "th", "line_no")
    firsts = cut(rows.groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")))

    # the halves are hashed where the lines are read, so no text moves for lines that share none
    sized = rows.where(F.length("line") >= min_chars).select("h", "line", F.length("line").alias("n"))
    half = F.col("n").bitwiseAND(1)  # of n + 1 when n is odd, the first half is one longer

    def cut_out(m: Column, lo: Column, hi: Column, outside: Column) -> Column:
        return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.xxhash64(m, lo, outside).alias("key"))

    n, k = F.col("n"), F.shiftright("n", 1)
    longer, k1 = n + 1, F.shiftright("n", 1) + half
    cuts = F.array(
        cut_out(n, F.lit(0), k, F.substring("line", k + 1, n - k)),
        cut_out(n, k, n, F.substring("line", F.lit(1), k)),
        cut_out(longer, F.lit(0), k1, F.substring("line", n - (longer - k1) + 1, longer - k1)),
        cut_out(longer, k1, longer, F.substring("line", F.lit(1), k1)),
    )
    keyed = sized.select("h", F.inline(cuts))
    ranges = cut(bounded_semi(keyed, cut(shared_keys(keyed)), "key").select("h", "m", "lo", "hi").distinct())
    found = bounded_semi(rows.select("h", "line"), ranges.select("h").distinct(), "h")
    lines = cut(found.groupBy("h").agg(F.min("line").alias("line")))
    blocks = shared_ranges(lines, ranges, F.ceil(F.sqrt(F.col("hi") - F.col("lo"))))
    single = cut(shared_ranges(lines, blocks.select("h", "m", "lo", "hi"), F.col("hi") - F.col("lo")))

    # all lines under one final key are within one edit of each other: the earliest stays
    placed = single.join(firsts.select("h", "first"), "h")
    earliest = placed.groupBy("key").agg(F.min(F.struct("first", "h")).alias("e"))
    later = placed.join(earliest, "key").where(F.col("first") > F.col("e.first")).select("h", F.col("e.h").alias("g")).distinct()
    other = lines.select(F.col("h").alias("g"), F.col("line").alias("earlier"))
    near = later.join(lines, "h").join(other, "g").where(F.levenshtein("line", "earlier", 1) >= 0).select("h").distinct()

    drop_firsts = firsts.join(near, "h", "left_semi").select("first.doc", "first.th", "first.line_no")
    copies = firsts.where("copies > 1").select("h", "first")
    drop_copies = (
        rows.select("h", "doc", "th", "line_no").join(copies, "h").where(F.struct("doc", "th", "line_no") != F.col("first")).select("doc", "th", "line_no")
    )
    drops = drop_firsts.unionByName(drop_copies)
    return drops.groupBy("doc", "th").agg(F.collect_set("line_no").alias("drops"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, counts: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``; all rows and columns stay.

    A line goes if an equal line stands earlier, whatever its length, or, from ``min_chars``
    characters (code points) on, one within one edit: in a shorter line one edit changes too much of what it says.
    Empty lines stay. Null texts stay null and empty texts empty; a text all of whose lines go
    becomes empty; texts and lines may have any length. Rows with equal id and text count as one
    document and come out alike; null ids sort first; an empty table stays empty. With
    ``counts``, ``n_lines`` and ``n_dropped`` are added (in place of columns of these names).
    """
    drops = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    drops = drops.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("drops").alias("__drops"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.withColumn("__of", F.xxhash64(text)).join(drops, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__of") == F.col("__th")), "left")
    # the parts are a column, used more than once, so that they are not split again for each line
    parts = F.when(F.col("__drops").isNotNull(), F.split(F.col(text_col).cast("string"), "\n"))
    joined = joined.withColumn("__parts", parts)
    stays = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__drops")))
    kept = F.when(F.col("__drops").isNull(), F.col(text_col).cast("string")).otherwise(
        F.array_join(F.transform(stays, lambda i: F.element_at(F.col("__parts"), i + 1)), "\n")
    )
    added = ("n_lines", "n_dropped") if counts else ()
    out = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in added]
    if counts:
        out += [F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*out)
