"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, oracles, url_filter
from .decontaminate import op10_decontamination
from .fingerprint import op9_fingerprints
from .html_extract import op2_html_extraction
from .jaccard_join import op7_jaccard_join
from .langid import op3_language_id
from .packing import op4_packing
from .resample import op13_importance_resampling
from .spelling import op11_spelling_variants
from .substring_dedup import op6_substring_dedup
from .token_counts import op1_token_counts
from .token_store import op8_token_store
from .url_filter import op5_url_filters
from .warc import op12_warc

_ALL = (op1_token_counts, op2_html_extraction, op3_language_id, op4_packing, op5_url_filters, op6_substring_dedup, op7_jaccard_join, op8_token_store, op9_fingerprints, op10_decontamination, op11_spelling_variants, op12_warc, op13_importance_resampling)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {"op6_substring_dedup": oracles.SUBSTRINGS, "op7_jaccard_join": oracles.JACCARD, "op10_decontamination": decontaminate.ORACLE, "op5_url_filters": url_filter.ORACLE, "op11_spelling_variants": oracles.SPELLING, "op12_warc": oracles.WARC, "op13_importance_resampling": oracles.RESAMPLE}
