"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from millrace.llm.bbit import OP13_SQL, op13_minhash
from millrace.llm.bins import op2_token_matrices
from millrace.llm.language import op4_language
from millrace.llm.lines import OP8_SQL, op8_lines
from millrace.llm.minhash import op5_minhash
from millrace.llm.mixing import OP3_SQL, op3_mixing
from millrace.llm.neighbours import op1_neighbours
from millrace.llm.packing import op10_packing
from millrace.llm.quality import op7_quality
from millrace.llm.search import OP11_SQL, op11_search
from millrace.llm.simhash import op9_simhash
from millrace.llm.substrings import OP6_SQL, op6_substrings
from millrace.llm.trie import OP12_SQL, op12_trie

QUERIES = {f.__name__: f for f in (op1_neighbours, op2_token_matrices, op3_mixing, op4_language, op5_minhash, op6_substrings, op7_quality, op8_lines, op9_simhash, op10_packing, op11_search, op12_trie, op13_minhash)}

SQL = {"op3_mixing": OP3_SQL, "op6_substrings": OP6_SQL, "op8_lines": OP8_SQL, "op11_search": OP11_SQL, "op12_trie": OP12_SQL, "op13_minhash": OP13_SQL}
