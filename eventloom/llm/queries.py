"""One thin query per text operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, chat, decontaminate, exact_dedup, language, line_dedup, near_dedup, quality, secret_scan, token_count
from eventloom.llm._base import table, written


#: Shares of the speaker markers that op1's transcripts leave out, write otherwise, or get wrong.
OP1_MARKERS = {"dropped": 0.3, "other": 0.1, "wrong": 0.02}


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(chat.transcripts(table(spark, sf_dir, "conversations"), **OP1_MARKERS), "transcripts")
    held_out = language.held_out("conv_id")
    parsed = chat.parse_transcripts(found, chat.learn(found.where(~held_out)))
    own = F.filter("turns", lambda t: ~t["continued"])
    return chat.rendered(parsed).select(
        "conv_id", "block", held_out.alias("held_out"), F.size(own).cast("long").alias("n_turns"), F.array_join(F.transform(own, lambda t: t["role"]), ">").alias("roles"), F.sha2("rendered", 256).alias("rendered_sha256")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_index", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, F.col("doc_id").isNotNull() & ~language.held_out())
    labelled = language.identify(docs, model)
    return labelled.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "tokens", "reparameterised")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which stands above this package, and imports it

    return corpus_pipeline.run(spark, sf_dir)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OP8_SQL = f"""
with d as (
  select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') as t from documents
)
select doc_id,
       max(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from d
"""


# Sets of shingles, pairs by their common ones, and all that can be reached over links.
_OP5_SQL = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x09-\\x0D ]+'), lambda x: x <> '') as ws from documents
), sh as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as s from w
), n as (
  select doc_id, count(*) as n from sh group by doc_id
), p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select x, y from p join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 100 * c >= 85 * (nx.n + ny.n - c)
), either as (
  select x, y from links union select y, x from links
), reach as (
  select doc_id, doc_id as r from documents union select either.y, reach.r from reach join either on reach.doc_id = either.x
)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r) as component_id, d.doc_id = min(r) as kept
from documents d join reach using (doc_id) left join n using (doc_id) group by d.doc_id
"""

_OP10_SQL = f"""
with l as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents
), b as (
  select line from l where line <> '' group by line having count(distinct source) >= {line_dedup.SITES}
), f as (
  select l.doc_id, l.pos, l.line, b.line is not null as gone from l left join b on l.line = b.line
)
select doc_id, count(*) filter (where line <> '') as n_lines, count(*) filter (where gone) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as text_sha256
from f group by doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_format, op2_quality, op3_token_counts, op4_bpe_codec, op5_minhash_near_dedup, op6_secret_scan, op7_language, op8_exact_dedup, op9_decontamination, op10_line_dedup, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_dedup": _OP5_SQL, "op8_exact_dedup": _OP8_SQL, "op10_line_dedup": _OP10_SQL}
