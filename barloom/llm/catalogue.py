"""Registered queries of the training-data operators."""

from __future__ import annotations

from barloom.llm.bpe import op5_bpe
from barloom.llm.conversation_trie import ORACLE_SQL as OP13_SQL
from barloom.llm.conversation_trie import op13_conversation_trie
from barloom.llm.embedding_dedup import op7_embedding_dedup
from barloom.llm.licenses import op2_licenses
from barloom.llm.multiset_hash import ORACLE_SQL as OP11_SQL
from barloom.llm.multiset_hash import op11_fingerprints
from barloom.llm.oracles import ORACLES as SQL_ORACLES
from barloom.llm.packing import op4_packing
from barloom.llm.quality_classifier import op8_quality_classifier
from barloom.llm.quality_rules import op3_quality_rules
from barloom.llm.records import op6_records
from barloom.llm.sharding import op10_sharding
from barloom.llm.simhash import op1_simhash
from barloom.llm.source_audit import ORACLE_SQL as OP12_SQL
from barloom.llm.source_audit import op12_source_divergence
from barloom.llm.warc import ORACLE_SQL as OP9_SQL
from barloom.llm.warc import op9_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_records": op6_records,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
    "op11_fingerprints": op11_fingerprints,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES: dict[str, str] = {"op9_warc": OP9_SQL, "op11_fingerprints": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_conversation_trie": OP13_SQL} | SQL_ORACLES
