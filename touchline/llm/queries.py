"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, collocations, exactdedup, linededup, mainpage, mixing, pieces, quality, sharding, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substrings": substrings.op2_substrings,
    "op3_sharding": sharding.op3_sharding,
    "op4_exactdedup": exactdedup.op4_exactdedup,
    "op5_quality": quality.op5_quality,
    "op6_pieces": pieces.op6_pieces,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_linededup": linededup.op10_linededup,
    "op11_mainpage": mainpage.op11_mainpage,
    "op12_centroids": centroids.op12_centroids,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE: dict[str, str] = {
    "op3_sharding": sharding.oracle(sharding.uniform_tree(16)),
    "op4_exactdedup": exactdedup.ORACLE,
    "op5_quality": quality.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_linededup": linededup.ORACLE,
    "op12_centroids": centroids.oracle(),
    "op13_collocations": collocations.ORACLE,
}
