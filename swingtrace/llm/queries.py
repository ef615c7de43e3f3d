"""The registered query of each operator, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from swingtrace.llm import (
    archives,
    contamination,
    crossentropy,
    mixing,
    nearcopies,
    pagetext,
    periodic,
    prefixjoin,
    private,
    quality,
    repeats,
    secrets,
    vectorcodes,
)

QUERIES = {
    "op1_page_text": pagetext.query,
    "op2_repeats": repeats.query,
    "op3_private": private.query,
    "op4_near_copies": nearcopies.query,
    "op5_contamination": contamination.query,
    "op6_archives": archives.query,
    "op7_cross_entropy": crossentropy.query,
    "op8_mixing": mixing.query,
    "op9_quality": quality.query,
    "op10_secrets": secrets.query,
    "op11_prefix_join": prefixjoin.query,
    "op12_periodic_runs": periodic.query,
    "op13_vector_codes": vectorcodes.query,
}

ORACLE = {
    "op4_near_copies": nearcopies.sql(),
    "op5_contamination": contamination.sql(),
    "op8_mixing": mixing.sql(),
    "op9_quality": quality.sql(),
    "op11_prefix_join": prefixjoin.sql(),
    "op13_vector_codes": vectorcodes.sql(),
}
