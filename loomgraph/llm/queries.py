"""The queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, avi, bpe, chat, importance, mixing, near_dup, pieces, quality, secret_scan, syncmers, token_counts, warc
from .common import table


def op1_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(avi.films(table(spark, sf_dir, "documents"))).drop("clips")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more, -1, whose texts hold the template's own marks."""
    marks = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digests(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_superminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_avi_mjpeg, op2_chat_format, op3_sentencepiece, op4_secret_scan, op5_warc, op6_mix_sources, op7_token_counts, op8_quality_mil, op9_superminhash_near_dup, op10_closed_syncmers,
        op11_importance_resampling, op12_bpe, op13_token_alignment,
    )
}

_CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text, case when conv_id is null then row_number() over () end own from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok', null), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', null)
)
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::bigint formatted_chars
from rows group by conv_id, own
"""

_MIX = r"""
with recursive sized as (
  select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents
), sources as (
  select source, sum(size)::bigint s, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double w from sized group by source
), ranked as (
  select *, row_number() over (order by 3.0 * s / w, source nulls first) k, sum(s) over ()::double total, sum(w) over () weights,
    coalesce(sum(3.0 * s) over (order by 3.0 * s / w, source nulls first rows between unbounded preceding and 1 preceding), 0) spent,
    coalesce(sum(w) over (order by 3.0 * s / w, source nulls first rows between unbounded preceding and 1 preceding), 0) gone from sources
), capped as (
  select *, 3.0 * s * (weights - gone) < w * (total - spent) over_cap from ranked
), shares as (
  select source, s, case when over_cap then 3.0 * s else w * (total - coalesce(sum(3.0 * s) filter (over_cap) over (), 0)) / sum(w) filter (not over_cap) over () end target from capped
), rated as (
  select d.doc_id, d.size, s.s source_size, s.target::double target, least(case when s.s > 0 then s.target / s.s else 0 end, 3.0)::double rate, d.source,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::varchar, 'text:' || coalesce(d.text, ''))), 1, 13))::bigint hash
  from sized d join shares s on d.source is not distinct from s.source
), drawn as (
  select *, sum(size) over (partition by source order by hash range unbounded preceding) - sum(size) over (partition by source, hash) / 2 middle,
    (1 - ('0x' || substr(md5('42:source:' || coalesce('of:' || source, 'null')), 1, 13))::bigint / 4503599627370496.0::double) * source_size low from rated
), placed as (
  select *, low + (rate - floor(rate)) * source_size high from drawn
)
select doc_id, size, source_size, target, (size * (floor(rate) + case when high > source_size then (middle >= low or middle < high - source_size)::int else (middle >= low and middle < high)::int end))::bigint taken from placed
"""

#: The other operators decode media, train models or go through a library's tokens; their tests compare them with
#: brute force, round trips and held-out labels.
ORACLE: dict[str, str] = {"op2_chat_format": _CHAT, "op6_mix_sources": _MIX}
