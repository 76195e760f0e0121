"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.llm.alignment import op11_token_alignment
from stratalens.llm.decontaminate import op4_decontaminate
from stratalens.llm.langid import op2_language_id
from stratalens.llm.lines import op8_line_dedup
from stratalens.llm.media import op12_interleaved_media
from stratalens.llm.mixing import op5_mix
from stratalens.llm.neardup import op7_near_dedup
from stratalens.llm.oracles import MEDIA, MIX_TARGETS, NEAR, PII_COUNTS, QUALITY, VARIANTS
from stratalens.llm.pii import op9_pii
from stratalens.llm.quality import op6_quality_rules
from stratalens.llm.suffixes import op1_suffix_dedup
from stratalens.llm.tokens import op10_token_counts
from stratalens.llm.toxicity import op3_toxicity
from stratalens.llm.variants import op13_spelling_variants


def llm_mix_targets(spark, sf_dir: str):
    """The part of op5_mix that SQL can state: sizes and targets."""
    return op5_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def llm_pii_counts(spark, sf_dir: str):
    """The part of op9_pii that SQL can state: counts of the fixed patterns."""
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_language_id": op2_language_id, "op3_toxicity": op3_toxicity, "op4_decontaminate": op4_decontaminate, "op5_mix": op5_mix, "op6_quality_rules": op6_quality_rules, "op7_near_dedup": op7_near_dedup, "op8_line_dedup": op8_line_dedup, "op9_pii": op9_pii, "op10_token_counts": op10_token_counts, "op11_token_alignment": op11_token_alignment, "op12_interleaved_media": op12_interleaved_media, "op13_spelling_variants": op13_spelling_variants, "llm_mix_targets": llm_mix_targets, "llm_pii_counts": llm_pii_counts}

#: The others learn models, permute by hashes, or work on bytes and edits: tests hold them against brute force.
ORACLE: dict[str, str] = {"op6_quality_rules": QUALITY, "op7_near_dedup": NEAR, "op12_interleaved_media": MEDIA, "op13_spelling_variants": VARIANTS, "llm_mix_targets": MIX_TARGETS, "llm_pii_counts": PII_COUNTS}
