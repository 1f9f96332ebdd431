"""The queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_decontamination
from .fill_middle import OP12_SQL, op12_fill_middle
from .html_extract import op4_html_extraction
from .language_id import op6_language_id
from .ngram_join import op1_ngram_join
from .piece_codec import op5_sentencepiece
from .quality_model import op9_quality_classifier
from .quality_rules import BASE_SQL as QUALITY_SQL
from .quality_rules import base_quality_counts, op7_quality_rules
from .secret_scan import BASE_SQL as SECRET_SQL
from .secret_scan import base_secret_counts, op10_secret_scan
from .simhash import op11_simhash
from .substring_dedup import op8_substring_dedup
from .url_filter import OP3_SQL, op3_url_filter
from .whitening import op13_whitening

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_html_extraction": op4_html_extraction,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_secret_scan": op10_secret_scan,
    "op11_simhash": op11_simhash,
    "op12_fill_middle": op12_fill_middle,
    "op13_whitening": op13_whitening,
    # What SQL can express of op7 and op10.
    "base_quality_counts": base_quality_counts,
    "base_secret_counts": base_secret_counts,
}

ORACLE_SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op3_url_filter": OP3_SQL, "op12_fill_middle": OP12_SQL, "base_quality_counts": QUALITY_SQL, "base_secret_counts": SECRET_SQL}
