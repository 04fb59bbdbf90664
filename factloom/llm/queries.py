"""The queries of this package and their SQL."""

from __future__ import annotations

from . import embeddings, jaccard, licenses, media, mixing, quality, sharding, substrings, tokens, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_mix": mixing.op1_mix,
        "op2_media": media.op2_media,
        "op3_sentencepiece": tokens.op3_sentencepiece,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_sharding": sharding.op5_sharding,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_substrings": substrings.op8_substrings,
        "op9_quality": quality.op9_quality,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.OP1_SQL, "op4_jaccard": jaccard.OP4_SQL, "op8_substrings": substrings.OP8_SQL}
