"""Queries of the text operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import exact_dedup, language_id, language_model, line_dedup, near_dedup, packing, quality, secret_scan, segmentation, sharding, spelling, toxicity, vector_codes
from .common import documents


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_robust_outliers(spark, sf_dir):
    return quality.quality_verdicts(documents(spark, sf_dir))


def op2_ftrl_toxicity(spark, sf_dir):
    return toxicity.held_out_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_content_sort(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op4_sampled_pieces(spark, sf_dir):
    return segmentation.encode_digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_swap_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op6_fuzzy_lines(spark, sf_dir):
    return line_dedup.line_report(documents(spark, sf_dir))


def op7_log_bilinear(spark, sf_dir):
    return language_model.held_out_scores(documents(spark, sf_dir))


def op8_bbit_minhash(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op9_bounded_ring(spark, sf_dir):
    return sharding.assign_shards(documents(spark, sf_dir), 24)


def op10_markov_secrets(spark, sf_dir):
    return secret_scan.secret_report(documents(spark, sf_dir))


def op11_segment_means(spark, sf_dir):
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_sparse_languages(spark, sf_dir):
    return language_id.held_out_languages(documents(spark, sf_dir))


def op13_pigeonhole_variants(spark, sf_dir):
    return spelling.spelling_variants(documents(spark, sf_dir))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_robust_outliers": op1_robust_outliers,
        "op2_ftrl_toxicity": op2_ftrl_toxicity,
        "op3_content_sort": op3_content_sort,
        "op4_sampled_pieces": op4_sampled_pieces,
        "op5_swap_packing": op5_swap_packing,
        "op6_fuzzy_lines": op6_fuzzy_lines,
        "op7_log_bilinear": op7_log_bilinear,
        "op8_bbit_minhash": op8_bbit_minhash,
        "op9_bounded_ring": op9_bounded_ring,
        "op10_markov_secrets": op10_markov_secrets,
        "op11_segment_means": op11_segment_means,
        "op12_sparse_languages": op12_sparse_languages,
        "op13_pigeonhole_variants": op13_pigeonhole_variants,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op3_content_sort": exact_dedup.ORACLE, "op11_segment_means": vector_codes.ORACLE, "op13_pigeonhole_variants": spelling.ORACLE}
