"""The subpackage's registered queries, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import op1_voronoi, op7_mixing
from .op1_voronoi import op1_voronoi as op1
from .op2_token_files import op2_token_files
from .op3_anisotropic import op3_anisotropic
from .op4_url_filter import op4_url_filter
from .op5_quality import op5_quality
from .op6_language import op6_language
from .op7_mixing import op7_mixing as op7
from .op8_simhash import op8_simhash
from .op9_token_counts import op9_token_counts
from .op10_packing import op10_packing

QUERIES = {
    "op1_voronoi": op1,
    "op2_token_files": op2_token_files,
    "op3_anisotropic": op3_anisotropic,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_mixing": op7,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op1_voronoi": op1_voronoi.SQL, "op7_mixing": op7_mixing.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
