"""The operators' queries and the SQL of those that SQL can express."""

from spanloom.llm.alignment import op11_token_alignment
from spanloom.llm.collocations import OP13_SQL, op13_phrases
from spanloom.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from spanloom.llm.licenses import op9_license_scan
from spanloom.llm.main_text import op12_main_text
from spanloom.llm.mixing import op10_mixing
from spanloom.llm.ngram_jaccard import OP4_SQL, op4_ngram_jaccard
from spanloom.llm.packing import op2_packing
from spanloom.llm.quality import op7_quality
from spanloom.llm.secrets import OP1_SQL, op1_secret_scan
from spanloom.llm.sharding import op6_sharding
from spanloom.llm.token_counts import op5_token_counts
from spanloom.llm.topk import OP8_SQL, op8_exact_topk

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_exact_topk": op8_exact_topk,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_main_text": op12_main_text,
    "op13_phrases": op13_phrases,
}
ORACLES = {
    "op1_secret_scan": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op8_exact_topk": OP8_SQL,
    "op13_phrases": OP13_SQL,
}
