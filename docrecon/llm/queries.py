"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from docrecon.llm.decontaminate import op6_decontaminate
from docrecon.llm.fingerprint import op7_fingerprint
from docrecon.llm.html_text import op2_html
from docrecon.llm.licences import OP9_SQL, op9_licences
from docrecon.llm.near_dup import op3_minhash
from docrecon.llm.packing import op10_packing
from docrecon.llm.prefix_trie import op13_prefix_trie
from docrecon.llm.shards import op5_sharding
from docrecon.llm.substring import op1_substring
from docrecon.llm.toxicity import op4_toxicity
from docrecon.llm.warc import OP12_SQL, op12_warc
from docrecon.llm.wavelet import op8_wavelet
from docrecon.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_substring, op2_html, op3_minhash, op4_toxicity, op5_sharding, op6_decontaminate, op7_fingerprint, op8_wavelet, op9_licences, op10_packing, op11_whitening, op12_warc, op13_prefix_trie)}
SQL = {"op9_licences": OP9_SQL, "op12_warc": OP12_SQL}
