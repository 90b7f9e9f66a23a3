"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.chat import format_table
from tidegrid.llm.common import read_table
from tidegrid.llm.exact_dedup import duplicate_groups
from tidegrid.llm.language import identify
from tidegrid.llm.language_model import score_documents as score_language
from tidegrid.llm.near_dedup import near_groups
from tidegrid.llm.negatives import labelled, mine_negatives, shifted_label
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.pieces import encode_and_decode
from tidegrid.llm.quality import score_documents
from tidegrid.llm.runs import find_runs, repeated_tail, run_digest
from tidegrid.llm.secrets import scan_documents
from tidegrid.llm.sharding import shard_documents
from tidegrid.llm.tokenizer_files import tokenizer_file
from tidegrid.llm.topk import search_every_nth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@_register
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@_register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=16)


@_register
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(read_table(spark, sf_dir, "documents"))


@_register
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@_register
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(read_table(spark, sf_dir, "documents"))


ORACLES["op5_exact_dedup"] = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
    doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from texts"""


@_register
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))


@_register
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read_table(spark, sf_dir, "documents"), width=4, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op7_minhash_dedup"] = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'),
        lambda w: w <> '') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
shared as (
    select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as c
    from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (
    select x, y from shared where 100 * c >= 80 * (nx + ny - c)
    union all select y, x from shared where 100 * c >= 80 * (nx + ny - c)),
reach as (select doc_id, doc_id as other from sets union select r.doc_id, l.y from reach r join links l on l.x = r.other)
select s.doc_id, cast(len(s) as bigint) as n_shingles, r.c as component_id, s.doc_id = r.c as kept
from sets s join (select doc_id, min(other) as c from reach group by 1) r using (doc_id)"""


@_register
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


@_register
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_every_nth(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


ORACLES["op10_exact_topk"] = """
with rows as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
    where vec_id is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, r.vec_id, cast(list_dot_product(q.v, r.v) as bigint) as score
    from rows q join rows r on q.vec_id <> r.vec_id and len(q.v) = len(r.v) where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20"""


@_register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(find_runs(read_table(spark, sf_dir, "documents"), exponent=3, least_length=24, reorder=repeated_tail))


@_register
def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_table(read_table(spark, sf_dir, "conversations"))


ORACLES["op12_chat_formatting"] = r"""
with said as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
    select *, regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') as r,
        regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') as t from said)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(r) + length(t) + length('<s>[INST]  [/INST] </s>')) as bigint) as formatted_chars
from escaped group by conv_id"""


@_register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(read_table(spark, sf_dir, "embeddings"), factor=256, label=shifted_label(7, 10))
    return mine_negatives(rows, every=100, n_positives=5, n_negatives=10, least=30, most=90)


ORACLES["op13_hard_negatives"] = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
    select a.vec_id as a, r.vec_id as r, a.label = r.label as same, cast(list_dot_product(a.v, r.v) as bigint) as score
    from rows a join rows r on a.vec_id <> r.vec_id and len(a.v) = len(r.v) where a.vec_id % 100 = 0),
near as (
    select a, r as p, score as ps from scored where same
    qualify row_number() over (partition by a order by score desc, r) <= 5),
ranked as (
    select n.a, n.p, n.ps, s.r, s.score, row_number() over (partition by n.a, n.p order by s.score desc, s.r) as rank
    from near n join scored s on s.a = n.a and not s.same and 30 * n.ps <= 100 * s.score and 100 * s.score <= 90 * n.ps)
select a as anchor_id, p as positive_id, cast(rank as integer) as rank, r as negative_id, ps as positive_score, score as negative_score
from ranked where rank <= 10"""
