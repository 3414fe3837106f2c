"""The registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from lexiloom.llm import capfilters, decontam, lattice, linededup, minhash, mixing, quality, sharding, urlrules, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_minhash": minhash.op2_minhash,
        "op3_mix": mixing.op3_mix,
        "op4_urls": urlrules.op4_urls,
        "op5_decontaminate": decontam.op5_decontaminate,
        "op6_caps": capfilters.op6_caps,
        "op7_quality": quality.op7_quality,
        "op8_lines": linededup.op8_lines,
        "op9_shard": sharding.op9_shard,
        "op10_lattice": lattice.op10_lattice,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_warc": warc.OP1_SQL, "op3_mix": mixing.OP3_SQL, "op5_decontaminate": decontam.OP5_SQL, "op8_lines": linededup.OP8_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {k: v for k, v in found.items() if v}
