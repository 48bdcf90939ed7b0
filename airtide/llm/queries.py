"""The queries of the corpus operators, by name, and their SQL where there is one."""

from __future__ import annotations

from airtide.llm.language_id import language_query
from airtide.llm.license_scan import licenses_query
from airtide.llm.lm_scoring import scoring_query
from airtide.llm.packing import packing_query
from airtide.llm.pieces import pieces_query
from airtide.llm.quality_rules import QUALITY_SQL, quality_query
from airtide.llm.runs import runs_query
from airtide.llm.secret_scan import secrets_query
from airtide.llm.shuffle import shuffle_query
from airtide.llm.simhash import simhash_query
from airtide.llm.topk import TOPK_SQL, topk_query
from airtide.llm.vector_codes import CODES_SQL, codes_query
from airtide.llm.warc_archive import ARCHIVE_SQL, archive_query

QUERIES = {
    "op1_lm_scoring": scoring_query,
    "op2_topk": topk_query,
    "op3_license_scan": licenses_query,
    "op4_secret_scan": secrets_query,
    "op5_warc_archive": archive_query,
    "op6_packing": packing_query,
    "op7_simhash": simhash_query,
    "op8_pieces": pieces_query,
    "op9_quality_rules": quality_query,
    "op10_language_id": language_query,
    "op11_vector_codes": codes_query,
    "op12_shuffle": shuffle_query,
    "op13_runs": runs_query,
}

ORACLES = {
    "op2_topk": TOPK_SQL,
    "op5_warc_archive": ARCHIVE_SQL,
    "op9_quality_rules": QUALITY_SQL,
    "op11_vector_codes": CODES_SQL,
}
