"""Operators for training-data pipelines and their registered queries."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from iotrail.llm import bpe, embedding_dups, exact_dedup, hard_negatives, html_text, language, language_model, merkle, near_dups, packing, secrets, sharding, token_files  # noqa: E402

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_token_files": token_files.op2_token_files,
    "op3_embedding_dups": embedding_dups.op3_embedding_dups,
    "op4_packing": packing.op4_packing,
    "op5_secrets": secrets.op5_secrets,
    "op6_language": language.op6_language,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_language_model": language_model.op9_language_model,
    "op10_near_dups": near_dups.op10_near_dups,
    "op11_merkle": merkle.op11_merkle,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_html_text": html_text.op13_html_text,
}
SQL = {
    "op3_embedding_dups": embedding_dups.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op10_near_dups": near_dups.SQL,
    "op11_merkle": merkle.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
