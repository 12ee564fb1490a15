"""Queries of the training-data operators, with SQL where SQL can express them."""

from terrace.llm import audit, codes, embeddings, language, lines, media, mixing, pieces, quality, secrets, sharding, simhash, tokenfile

QUERIES = {
    "op1_media": media.op1_media,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_lines": lines.op11_lines,
    "op12_filters": audit.op12_filters,
    "op13_codes": codes.op13_codes,
    "op2_shards": sharding.op2_shards,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality": quality.op4_quality,
    "op5_language": language.op5_language,
    "op6_tokens": tokenfile.op6_tokens,
    "op7_mix": mixing.op7_mix,
    "op8_pieces": pieces.op8_pieces,
    "op9_secrets": secrets.op9_secrets,
}
ORACLES = {"op10_embeddings": embeddings.ORACLE, "op11_lines": lines.ORACLE, "op12_filters": audit.ORACLE, "op13_codes": codes.ORACLE, "op7_mix": mixing.ORACLE}
