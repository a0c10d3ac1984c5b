"""The queries of this subpackage by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from .collocations import OP12_SQL, op12_collocations
from .decontaminate import OP8_SQL, op8_decontamination
from .huffman import op9_huffman
from .maxent import op5_maxent
from .mixing import op2_mixing
from .pii import op1_pii
from .prefixes import OP13_SQL, op13_prefix_trie
from .repeats import op4_repeats
from .sharding import op3_sharding
from .simhash import op7_simhash
from .toxicity import op6_toxicity
from .urls import op11_urls
from .winnow import op10_winnowing

QUERIES = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_repeats": op4_repeats,
    "op5_maxent": op5_maxent,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_huffman": op9_huffman,
    "op10_winnowing": op10_winnowing,
    "op11_urls": op11_urls,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op8_decontamination": OP8_SQL,
    "op12_collocations": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
