"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, lexical_search, oracles, vector_codes
from .decontaminate import op2_decontaminate
from .html_text import op4_html_text
from .language_id import op1_language_id
from .lexical_search import op13_lexical_search
from .media import op5_media
from .near_dup import op10_near_dedup
from .packing import op7_packing
from .quality import op9_quality
from .simhash_dedup import op11_simhash
from .substring_dedup import op8_substring_dedup
from .suffix_array_dedup import op6_suffix_array_dedup
from .token_store import op3_token_store
from .vector_codes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_decontaminate,
        op3_token_store,
        op4_html_text,
        op5_media,
        op6_suffix_array_dedup,
        op7_packing,
        op8_substring_dedup,
        op9_quality,
        op10_near_dedup,
        op11_simhash,
        op12_vector_codes,
        op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op6_suffix_array_dedup": oracles.OP6,
    "op8_substring_dedup": oracles.OP8,
    "op10_near_dedup": oracles.OP10,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
