"""Operators of a training-data pipeline, one module each, and the queries that apply them to the test tables.

`QUERIES` and `ORACLE` gather what the modules register; corpus_pipeline.py adds the pipeline.
"""

import sys

from pyspark import cloudpickle

# What tasks run is sent with them, so that the executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from . import (  # noqa: E402
    bag_minhash,
    decontamination,
    exact_dedup,
    gru_lm,
    html_extraction,
    mixing,
    phrase_fingerprints,
    prefix_trie,
    site_quality,
    spelling_variants,
    token_files,
    toxicity,
    warc,
)

_MODULES = [
    mixing,
    token_files,
    html_extraction,
    site_quality,
    decontamination,
    bag_minhash,
    exact_dedup,
    warc,
    toxicity,
    gru_lm,
    phrase_fingerprints,
    prefix_trie,
    spelling_variants,
]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
