"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import crosstok, deal, decontaminate, embeddings, lm, minhash, mixing, secrets, shards, toxicity, turns, urls, warc

QUERIES = {
    f.__name__: f
    for f in (
        minhash.op1_minhash_near_dedup,
        urls.op2_url_filter,
        decontaminate.op3_decontamination,
        shards.op4_token_shards,
        warc.op5_warc,
        secrets.op6_secret_scan,
        toxicity.op7_toxicity,
        embeddings.op8_embedding_near_dedup,
        lm.op9_lm_scoring,
        mixing.op10_source_mixing,
        turns.op11_conversation_repair,
        crosstok.op12_cross_tokenizer,
        deal.op13_sharding,
    )
}

ORACLES: dict[str, str] = {
    "op2_url_filter": urls.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_secret_scan": secrets.ORACLE,
    "op8_embedding_near_dedup": embeddings.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "op11_conversation_repair": turns.ORACLE,
    "op13_sharding": deal.ORACLE,
}
