"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import op1_exact_dedup
from .language_id import op5_language_id
from .licenses import OP8_SQL, op8_license_scan
from .mixing import op2_mixing
from .mtree import OP3_SQL, op3_mtree_search
from .pieces import op10_sentencepiece
from .preference import OP7_SQL, op7_preference
from .simhash import op9_simhash
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_counts import op6_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_mtree_search": op3_mtree_search,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_preference": op7_preference,
    "op8_license_scan": op8_license_scan,
    "op9_simhash": op9_simhash,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_mtree_search": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_preference": OP7_SQL,
    "op8_license_scan": OP8_SQL,
}
