"""Queries of the corpus operators, and their SQL where SQL can express them."""

import corpus_pipeline
from factorloom.llm.embedding_dedup import op1_embedding_dedup
from factorloom.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from factorloom.llm.line_dedup import op4_line_dedup
from factorloom.llm.packing import op5_packing
from factorloom.llm.periodic_runs import op12_periodic_runs
from factorloom.llm.quality import op10_quality
from factorloom.llm.sentence_pieces import op9_sentence_pieces
from factorloom.llm.sharding import op11_sharding
from factorloom.llm.simhash_dedup import op6_simhash_dedup
from factorloom.llm.spelling_variants import op13_spelling_variants
from factorloom.llm.substring_dedup import op3_suffix_array_dedup
from factorloom.llm.token_counts import op2_token_counts
from factorloom.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_quality": op10_quality,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op8_exact_dedup": OP8_SQL,
}
