"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_format
from .decontaminate import OP9_SQL, op9_decontaminate
from .jaccard_join import OP3_SQL, op3_jaccard_join
from .license_scan import op2_license_scan
from .mixing import op1_mix_sources
from .pii import op4_pii
from .quality_classifier import op8_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_pii": op4_pii,
    "op5_chat_format": op5_chat_format,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
}

SQL = {
    "op3_jaccard_join": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_url_filter": OP7_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
}
