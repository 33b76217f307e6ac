"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from helixlake.llm.bpe import op8_byte_bpe
from helixlake.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from helixlake.llm.embedding_dedup import OP4_SQL, op4_embedding_dedup
from helixlake.llm.fill_middle import OP12_SQL, op12_fill_middle
from helixlake.llm.hnsw import op9_hnsw_search
from helixlake.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from helixlake.llm.language_model import op10_attention_lm
from helixlake.llm.license_scan import OP13_SQL, op13_license_scan
from helixlake.llm.line_dedup import OP3_SQL, op3_line_dedup
from helixlake.llm.mixing import OP5_SQL, op5_source_mixing
from helixlake.llm.quality import op6_quality_nbsvm
from helixlake.llm.sharding import op2_lpt_sharding
from helixlake.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lpt_sharding, op3_line_dedup, op4_embedding_dedup, op5_source_mixing, op6_quality_nbsvm, op7_jaccard_join, op8_byte_bpe, op9_hnsw_search, op10_attention_lm, op11_conversation_repair, op12_fill_middle, op13_license_scan)}
ORACLE_SQL = {"op3_line_dedup": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op5_source_mixing": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op11_conversation_repair": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_license_scan": OP13_SQL}
