"""The queries of this folder and their SQL, by name."""

import importlib

# Query: module and function; the SQL, where there is any, is NAME_SQL there.
_PLACES = {
    "op1_toxicity": "toxicity",
    "op2_personal_data": "pii",
    "op3_token_counts": "tokens",
    "op4_warc_fixity": "fixity",
    "op5_benchmark_decontamination": "decontaminate",
    "op6_quality_classifier": "quality",
    "op7_jaccard_join": "trees",
    "op8_embedding_near_dedup": "lattice",
    "op9_best_fit_packing": "packing",
    "op10_url_filters": "urls",
    "op11_dataset_manifest": "dataset_manifest",
    "op12_prefix_trie": "prefix_trie",
    "op13_substring_dedup": "substrings",
}


def _load():
    queries, oracles = {}, {}
    for name, module in _PLACES.items():
        found = importlib.import_module(f"nodeglass.llm.{module}")
        queries[name] = getattr(found, name)
        sql = getattr(found, f"{name.split('_')[0].upper()}_SQL", None)
        if sql:
            oracles[name] = sql
    return queries, oracles


QUERIES, ORACLES = _load()
