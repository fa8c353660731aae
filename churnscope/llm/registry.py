"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from churnscope.llm.alignment import op13_alignment
from churnscope.llm.bpe import op7_byte_bpe
from churnscope.llm.host_rules import OP9_SQL, op9_host_rules
from churnscope.llm.jaccard_join import OP4_SQL, op4_jaccard_join
from churnscope.llm.mixing import OP6_SQL, op6_mixing
from churnscope.llm.pseudonyms import op2_pseudonyms
from churnscope.llm.quotes import op1_quotes
from churnscope.llm.repair import op12_repair
from churnscope.llm.sharding import op5_sharding
from churnscope.llm.simhash import op11_simhash
from churnscope.llm.token_counts import op8_token_counts
from churnscope.llm.token_files import op3_token_files
from churnscope.llm.topk import OP10_SQL, op10_top_k

QUERIES = {f.__name__: f for f in (op1_quotes, op2_pseudonyms, op3_token_files, op4_jaccard_join, op5_sharding, op6_mixing, op7_byte_bpe, op8_token_counts, op9_host_rules, op10_top_k, op11_simhash, op12_repair, op13_alignment)}
SQL = {"op4_jaccard_join": OP4_SQL, "op6_mixing": OP6_SQL, "op9_host_rules": OP9_SQL, "op10_top_k": OP10_SQL}
