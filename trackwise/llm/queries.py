"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from trackwise.llm.common import table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


from trackwise.llm import (  # noqa: E402
    byte_bpe, decontaminate, exact_dedup, langid, merkle, minhash, mixing, ppm, repeats, secrets, token_count, toxicity, whitening,
)


@query("op1_language_id")
def op1(spark, sf_dir):
    import public_tokenizers

    pieces = langid.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(table(spark, sf_dir, "documents"), pieces)


@query("op2_decontaminate")
def op2(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_ppm_scores")
def op3(spark, sf_dir):
    return ppm.lm_scores(table(spark, sf_dir, "documents"))


@query("op4_secrets")
def op4(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_toxicity")
def op6(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_token_count")
def op7(spark, sf_dir):
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_exact_dedup", exact_dedup.ORACLE)
def op8(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op9_minhash_odd_sketch")
def op9(spark, sf_dir):
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


@query("op10_suffix_repeats")
def op10(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_source_mix", mixing.ORACLE)
def op12(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_merkle_manifest", merkle.ORACLE)
def op13(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))
