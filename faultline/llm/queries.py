"""The queries of the training-data operators."""

from __future__ import annotations

from . import bpe, embeddings, fingerprints, html, langid, middle, minhash, oracles, packing, pii, seqpack, sharding, suffix, whitening
from .common import table


def op1_language_id(spark, sf_dir):
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_suffix_array(spark, sf_dir):
    return suffix.measure_repeats(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_minhash(spark, sf_dir):
    return minhash.group_documents(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark, sf_dir, vocabulary: str | None = None):
    """vocabulary: the path of a rank file; by default the one that the tokenizer package of this machine has."""
    import public_tokenizers

    ranks = bpe.read_ranks(spark, vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return middle.measure(table(spark, sf_dir, "documents"))


def op12_sequence_packing(spark, sf_dir, tokenizer: str | None = None):
    """tokenizer: the path of a tokenizer file; by default the one that the tokenizer package of this machine has."""
    import public_tokenizers

    text = seqpack.read_tokenizer(spark, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return seqpack.pack(table(spark, sf_dir, "documents"), text)


def op13_whitening(spark, sf_dir):
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sharding,
        op3_suffix_array,
        op4_pii,
        op5_minhash,
        op6_html_extraction,
        op7_byte_bpe,
        op8_fingerprints,
        op9_embeddings,
        op10_packing,
        op11_fill_in_middle,
        op12_sequence_packing,
        op13_whitening,
    )
}
#: What SQL can say (on small tables: pairs by brute force); the others (trained models, tries, sorts of suffixes, best fit, patterns that look around) are held against plain versions by tests.
ORACLE_SQL: dict[str, str] = {"op2_sharding": oracles.SHARDING, "op5_minhash": oracles.MINHASH, "op9_embeddings": oracles.EMBEDDINGS, "op11_fill_in_middle": oracles.MIDDLE}
