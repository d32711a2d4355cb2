"""The operators' queries by name, and their SQL where SQL can express them (models, keyed hashes and iteration are beyond it)."""

from __future__ import annotations

from loomtext.llm.audio import op5_audio
from loomtext.llm.decontaminate import op7_decontaminate
from loomtext.llm.langid import op3_langid
from loomtext.llm.oracles import ORACLE_SQL
from loomtext.llm.pieces import op10_pieces
from loomtext.llm.pii import op8_pii
from loomtext.llm.repeats import op9_repeats
from loomtext.llm.sharding import op2_sharding
from loomtext.llm.simhash import op6_simhash
from loomtext.llm.urls import op1_urls
from loomtext.llm.warc import op4_warc

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_url_templates": op1_urls,
    "op2_jump_shards": op2_sharding,
    "op3_crf_language": op3_langid,
    "op4_warc_revisits": op4_warc,
    "op5_audio_features": op5_audio,
    "op6_pigeonring_simhash": op6_simhash,
    "op7_decontamination": op7_decontaminate,
    "op8_disclosure_pii": op8_pii,
    "op9_bwt_repeats": op9_repeats,
    "op10_merge_dropout": op10_pieces,
}
