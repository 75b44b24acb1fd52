"""The registered queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from scholia.llm import bpe, bwt_dedup, chat, collocations, decontam, exact_dedup, hilbert, html_extract, langid, ngram_join, pieces, quality, repair
from scholia.llm.common import read


def op1_chat_formatting(spark, sf_dir):
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op2_html_extraction(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op3_suffix_array_dedup(spark, sf_dir):
    return bwt_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op4_hilbert_sharding(spark, sf_dir):
    return hilbert.hilbert_shards(read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_language_id(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark, sf_dir):
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(read(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return repair.summaries(repair.damage(read(spark, sf_dir, "conversations")))


def op12_bpe(spark, sf_dir):
    return bpe.digests(bpe.decode_documents(bpe.encode_documents(read(spark, sf_dir, "documents"))))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql():
    return {
        "op1_chat_formatting": chat.SQL,
        "op4_hilbert_sharding": hilbert.SQL,
        "op5_benchmark_decontamination": decontam.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
        "op10_ngram_jaccard_join": ngram_join.SQL,
        "op11_conversation_repair": repair.SQL,
        "op13_phrase_collocations": collocations.SQL,
    }
