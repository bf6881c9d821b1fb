"""The training-data queries: one for each operator, over its whole table. SQL has those that DuckDB can express."""

from augur.llm.chat import op13_chat
from augur.llm.clustering import op11_clustering
from augur.llm.decontamination import op5_decontamination
from augur.llm.jaccard import op6_jaccard
from augur.llm.mixing import op7_mixing
from augur.llm.neighbours import op9_neighbours
from augur.llm.oracle import SQL  # noqa: F401
from augur.llm.pii import op3_pii
from augur.llm.quality import op2_quality
from augur.llm.resampling import op12_resampling
from augur.llm.sharding import op4_sharding
from augur.llm.substrings import op10_substrings
from augur.llm.tokens import op1_tokens
from augur.llm.toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_tokens, op2_quality, op3_pii, op4_sharding, op5_decontamination, op6_jaccard, op7_mixing, op8_toxicity, op9_neighbours, op10_substrings, op11_clustering, op12_resampling, op13_chat)}

