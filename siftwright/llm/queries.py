"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from siftwright.llm import ann, bpe, chat_format, edit_fingerprint, fill_in_middle, language_id, near_dedup, packing, prefix_trie, quality, secret_scan, suffix_dedup, warc
from siftwright.llm.common import table


def _bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict:
    return {
        "op1_packing": lambda spark, sf_dir: packing.pack(table(spark, sf_dir, "documents")),
        "op2_warc": warc.query,
        "op3_chat_format": chat_format.query,
        "op4_quality": quality.query,
        "op5_edit_fingerprint": edit_fingerprint.query,
        "op6_bpe": _bpe,
        "op7_near_dedup": near_dedup.query,
        "op8_language_id": language_id.query,
        "op9_secret_scan": lambda spark, sf_dir: secret_scan.digests(table(spark, sf_dir, "documents")),
        "op10_ann": ann.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_fill_in_middle": fill_in_middle.query,
        "op13_suffix_dedup": suffix_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op3_chat_format": chat_format.ORACLE_SQL,
        "op7_near_dedup": near_dedup.ORACLE_SQL,
        "op9_secret_scan": secret_scan.ORACLE_SQL,
        "op11_prefix_trie": prefix_trie.ORACLE_SQL,
        "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
        "op13_suffix_dedup": suffix_dedup.ORACLE_SQL,
    }
