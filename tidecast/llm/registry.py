"""The queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import leaks
from .language_id import identify_languages
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mpeg_audio import media_columns, store_media
from .packing import instruction_examples, pack
from .periodic_runs import periodic_runs
from .quality import score_quality
from .secret_scan import scan_secrets
from .simhash import simhash_groups
from .token_files import ids_digest, token_files
from .toxicity import score_toxicity
from .whitening import whiten


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir), counts=True)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_digest(token_files(documents(spark, sf_dir)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = media_columns(store_media(documents(spark, sf_dir)))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), "frames"),
        F.concat(F.lit("samples="), "samples"),
        F.concat(F.lit("rate="), "sample_rate"),
        F.concat(F.lit("lost="), "lost_bytes"),
        F.concat(F.lit("bad_crc="), "bad_crc"),
        F.concat(F.lit("table="), "table_holds"),
        F.concat(F.lit("last_offset="), F.element_at("seek_offsets", -1)),
    )
    return parsed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "duration_s")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` as op13 searches it: every tenth document by the checksum of its id repeats a stretch of itself.

    Of its n words those from a on become the words a to a + p - 1, over and over. Documents without words or an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.where("text is not null").withColumn("g", g).where(h % 10 == 0).select("doc_id", "text", "g", words.alias("w"))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.greatest("n", F.lit(1))).cast("int")))
    chosen = chosen.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int"))
    rest = F.col("n") - F.col("a")
    turns = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.when(F.col("n") > 0, F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), rest))).otherwise(F.col("text"))
    return chosen.select("doc_id", text.alias("text")).unionByName(docs.where(F.col("text").isNull() | F.col("doc_id").isNull() | (h % 10 != 0)).select("doc_id", "text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(documents(spark, sf_dir)))
    # ties of length: the smallest start, then period
    order = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("back"), (-r["period"]).alias("q")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(order).alias("best"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.back"), F.col("best.length"), -F.col("best.q")
    return out.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def packing_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all conversations with what they answer, loss on the answers alone: segments and loss limit the sequences besides tokens."""
    return pack(instruction_examples(read_table(spark, sf_dir, "conversations")), prompt_col="prompt", max_segments=6, max_loss_tokens=1800)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_quality, op3_simhash, op4_secret_scan, op5_line_dedup, op6_token_files, op7_decontamination, op8_mpeg_audio, op9_packing, op10_toxicity, op11_whitening, op12_language_id, op13_periodic_runs, packing_instructions)
}

#: A line goes where an equal line stands earlier, or, if it has 20 or more characters, one of 20 or
#: more within one edit. Pairs within one edit share the first half of the longer line or the rest.
LINE_DEDUP_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, i - 1 as line_no, parts[i] as line
  from (select doc_id, string_split(text, chr(10)) as parts, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from d)
),
firsts as (select line, min(struct_pack(a := doc_id, b := line_no)) as f, length(line) as n from lines where length(line) > 0 group by line),
keys as (
  select line, f, m, 0 as side, substring(line, 1, m // 2) as part from (select *, unnest([n, n + 1]) as m from firsts where n >= 20)
  union all
  select line, f, m, 1, substring(line, n - (m - m // 2) + 1, m - m // 2) from (select *, unnest([n, n + 1]) as m from firsts where n >= 20)
),
near as (
  select distinct x.line from keys x join keys y on x.m = y.m and x.side = y.side and x.part = y.part and x.f > y.f and x.line <> y.line
  where levenshtein(x.line, y.line) <= 1
),
flagged as (
  select l.*, length(l.line) > 0 and (n.line is not null or struct_pack(a := l.doc_id, b := l.line_no) <> f.f) as gone
  from lines l left join firsts f on l.line = f.line left join near n on l.line = n.line
)
select doc_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where not coalesce(gone, false)), '') as text,
       count(*) as n_lines, count(*) filter (where coalesce(gone, false)) as n_dropped
from flagged group by doc_id
"""

ORACLE_SQL = {"op5_line_dedup": LINE_DEDUP_SQL}
