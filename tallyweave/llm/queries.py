"""The queries op1 to op13 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import audit, bpe, decontam, jaccard, langid, oracle, passages, pii, quality, repeats, search, secrets, toxicity, warc
from .util import held_out, table


#: Of this query's surrogates alone; callers of the operator give a key of their own.
QUERY_KEY = "registered query"


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held_out(4, 2)
    model = langid.learn(docs.select("doc_id", "text", "lang"), ~out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_bpe(spark, sf_dir):
    return bpe.encoding_digest(table(spark, sf_dir, "documents"))


def op3_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark, sf_dir):
    return pii.replace_entities(table(spark, sf_dir, "documents"), QUERY_KEY)


def op6_decontamination(spark, sf_dir):
    return decontam.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_suffix_array_dedup(spark, sf_dir):
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("verified")


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held_out(3, 1)
    model = toxicity.learn(docs.select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op11_vbm_wand(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_attention_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = held_out(3, 1)
    model = passages.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~out)
    return passages.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def queries() -> dict:
    return {"op1_language_id": op1_language_id, "op2_bpe": op2_bpe, "op3_secrets": op3_secrets, "op4_quality_rules": op4_quality_rules, "op5_pii_surrogates": op5_pii_surrogates, "op6_decontamination": op6_decontamination, "op7_suffix_array_dedup": op7_suffix_array_dedup, "op8_ngram_jaccard_join": op8_ngram_jaccard_join, "op9_warc": op9_warc, "op10_toxicity": op10_toxicity, "op11_vbm_wand": op11_vbm_wand, "op12_filter_audit": op12_filter_audit, "op13_attention_quality": op13_attention_quality}


def oracle_sql() -> dict:
    return dict(oracle.SQL)
