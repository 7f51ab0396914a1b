"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, langid, mixing, neardup, packing, quality_lm, rules, tokens, toxicity
from .common import fresh_path, held_out, track, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out(F.col("doc_id")))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    out = toxicity.predict(docs.select("doc_id", "text"), lexicon)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "hits")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_lm.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "lm_symbols", "perplexity", "threshold", "kept")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    track(spark, folder)
    manifest, _ = written(tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2), "tokens-manifest")
    return tokens.read(spark, manifest, folder)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql("select * from values (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) as t(conv_id, turn, role, text)", {"said": said})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    parts, _ = written(chat.formatted(rows), "chat-parts")
    return chat.read_back(parts)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_neighbours(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, _ = written(rules.with_counts(table(spark, sf_dir, "documents"), ["doc_id"]), "rules-counts")
    out = rules.judged(counted, rules.fit(counted))
    return out.select("doc_id", *rules.COUNTS, "base_failed", "p_good", "kept")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_quality_classifier, op4_token_ids, op5_chat_format, op6_minhash_near_dedup, op7_fingerprints, op8_source_mixing, op9_best_fit_packing, op10_quality_rules)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"


def _escaped(column: str) -> str:
    """A column with each control string, and each backslash, as two characters."""
    out = f"replace({column}, chr(92), '##')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '##')"
    return out


#: Whole answers of the operators that SQL can express; the others are held against brute force in tests/llm.
SQL = {
    "op5_chat_format": f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_escaped("role")}) + length({_escaped("text")})) as bigint) as formatted_chars
from c group by conv_id""",
    "op6_minhash_near_dedup": f"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 2 then [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] else ws end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
t as (select s.doc_id, s.sh, n.n from s join n using (doc_id)),
p as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c
  from t a join t b on a.sh = b.sh and a.doc_id < b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by all),
e as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
both_ways as (select a, b from e union all select b, a from e),
r(doc_id, root) as (select distinct a, a from both_ways union select both_ways.b, r.root from r join both_ways on both_ways.a = r.doc_id),
least as (select doc_id, min(root) as root from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least.root, d.doc_id) as component_id, d.doc_id = coalesce(least.root, d.doc_id) as kept
from documents d left join n on n.doc_id = d.doc_id left join least on least.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
