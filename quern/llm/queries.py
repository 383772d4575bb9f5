"""The queries of this package, by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

from quern.llm.covering_simhash import op8_covering_simhash
from quern.llm import host_rules, pfair_mix, prefix_trie, threshold_search
from quern.llm.host_rules import op12_host_rules
from quern.llm.pfair_mix import op6_pfair_mix
from quern.llm.posting_ann import op9_posting_ann
from quern.llm.prefix_trie import op13_prefix_trie
from quern.llm.repeat_intervals import op5_repeat_intervals
from quern.llm.secret_battery import op10_secret_battery
from quern.llm.shard_tree import op3_shard_tree
from quern.llm.site_templates import op7_site_templates
from quern.llm.template_decontam import op1_template_decontam
from quern.llm.token_store import op2_token_store
from quern.llm.threshold_search import op11_threshold_search
from quern.llm.toxicity_cnn import op4_toxicity_cnn

QUERIES = {f.__name__: f for f in (op1_template_decontam, op2_token_store, op3_shard_tree, op4_toxicity_cnn, op5_repeat_intervals, op6_pfair_mix, op7_site_templates, op8_covering_simhash, op9_posting_ann, op10_secret_battery, op11_threshold_search, op12_host_rules, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op6_pfair_mix": pfair_mix.SQL, "op11_threshold_search": threshold_search.SQL, "op12_host_rules": host_rules.SQL, "op13_prefix_trie": prefix_trie.SQL}
