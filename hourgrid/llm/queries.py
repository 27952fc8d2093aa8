"""The registered queries of this subpackage and their SQL twins."""

from hourgrid.llm import bpe, codes, langid, licenses, media, minhash, mixing, sharding, spelling, suffixes, toxicity, urls, vectors

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_media": media.op2_media,
    "op3_bpe": bpe.op3_bpe,
    "op4_sharding": sharding.op4_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op5_minhash_neardup": minhash.op5_minhash_neardup,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op9_embedding_neardup": vectors.op9_embedding_neardup,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_url_filter": urls.op13_url_filter,
}
SQL = {"op8_mixing": mixing.SQL, "op10_license_scan": licenses.SQL, "op11_vector_codes": codes.SQL, "op12_spelling_variants": spelling.SQL}
