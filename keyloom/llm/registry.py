"""The queries of this subpackage and the SQL of those that SQL can express."""

from keyloom.llm import sql
from keyloom.llm.decontaminate import op10_benchmark_hits
from keyloom.llm.embeddings import op8_embedding_near_dedup
from keyloom.llm.fm_index import op5_substring_fm_index
from keyloom.llm.mixing import op2_mix_sources
from keyloom.llm.ngram_join import op1_ngram_jaccard_join
from keyloom.llm.pii import op4_pii_spans
from keyloom.llm.run_index import op7_run_length_index
from keyloom.llm.sharding import op3_balanced_shards
from keyloom.llm.toxicity import op6_toxicity_crf
from keyloom.llm.warc import op9_warc_capture_index

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_mix_sources, op3_balanced_shards, op4_pii_spans, op5_substring_fm_index,
        op6_toxicity_crf, op7_run_length_index, op8_embedding_near_dedup, op9_warc_capture_index, op10_benchmark_hits,
    )
}
SQL: dict[str, str] = {k: v for k, v in sql.SQL.items() if k in QUERIES}
