"""Registered queries of this subpackage: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from buyerlens.llm.chaining import op4_chaining
from buyerlens.llm.decontaminate import op7_decontaminate
from buyerlens.llm.divergence import OP13_SQL, op13_divergence
from buyerlens.llm.embedding_dedup import op2_embedding
from buyerlens.llm.minhash_join import op9_minhash
from buyerlens.llm.mixing import op5_mixing
from buyerlens.llm.packing import op12_packing
from buyerlens.llm.periodic_runs import op11_periodic_runs
from buyerlens.llm.pii import op3_pii
from buyerlens.llm.quality_crf import op10_quality
from buyerlens.llm.sharding import op6_sharding
from buyerlens.llm.suffix_dedup import op1_suffix_dedup
from buyerlens.llm.toxicity import op8_toxicity

#: Hashing, training, alignment and sampling have no SQL form; tests/llm holds the rows against plain Python.
QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_embedding": (op2_embedding, None),
    "op3_pii": (op3_pii, None),
    "op4_chaining": (op4_chaining, None),
    "op5_mixing": (op5_mixing, None),
    "op6_sharding": (op6_sharding, None),
    "op7_decontaminate": (op7_decontaminate, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_minhash": (op9_minhash, None),
    "op10_quality": (op10_quality, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_packing": (op12_packing, None),
    "op13_divergence": (op13_divergence, OP13_SQL),
}
