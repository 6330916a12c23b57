"""The subpackage's queries and their SQL."""

from __future__ import annotations

from plexmat.llm import exact_dedup, fingerprints, language, licenses, mixing, near_dedup, packing, quality, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        fingerprints.op1_fingerprints, exact_dedup.op2_exact_dedup, language.op3_language, quality.op4_quality, licenses.op5_license_scan,
        packing.op6_packing, warc.op7_warc_derivatives, toxicity.op8_toxicity, mixing.op9_mixing, near_dedup.op10_near_dedup,
    )
}
SQL = {"op2_exact_dedup": exact_dedup.OP2_SQL, "op9_mixing": mixing.OP9_SQL}
