"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, language, merkle, mixing, periodic, phrases, pii, secrets, tiff, tokencount, tokenfile, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_spaced_seeds": decontaminate.op3_spaced_seeds,
    "op4_partenum_join": jaccard.op4_partenum_join,
    "op5_viterbi_counts": tokencount.op5_viterbi_counts,
    "op6_pii_skip_chain": pii.op6_pii_skip_chain,
    "op7_token_frames": tokenfile.op7_token_frames,
    "op8_warc_revisits": warc.op8_warc_revisits,
    "op9_tiff_pages": tiff.op9_tiff_pages,
    "op10_language_mixture": language.op10_language_mixture,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_repeated_phrases": phrases.op12_repeated_phrases,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE = {"op8_warc_revisits": warc.ORACLE}
