import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from larkspur.llm import byte_bpe, simhash_dedup
from tests.llm.test_operators import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    extra = spark.createDataFrame([(90000, None, None, None, None), (90001, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.union(extra)
    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, sf).cache()
        kept[name] = {r.doc_id: r for r in state.collect()}
        if name != "byte_bpe":
            assert state.columns == COLUMNS
    assert set(kept["language_id"]) == set(texts)
    prints = [(i, simhash_dedup.fingerprint(t.encode())) for i, t in texts.items()]
    assert set(kept["simhash_dedup"]) == set(brute_components(prints).values())  # the least id of each component
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i in kept["simhash_dedup"] if any(x in texts[i] for x in items)}
    assert set(kept["decontamination"]) == set(kept["simhash_dedup"]) - leaks
    assert set(kept["secret_scan"]) == set(kept["decontamination"])
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in kept["byte_bpe"].items():
        text = kept["secret_scan"][i].text
        ids = np.array(encoding.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_rows_that_share_an_id_stay_if_their_texts_differ(spark):
    rows = spark.createDataFrame([(5, "one text about rivers and lakes"), (5, "quite another one, of cars"), (7, "one text about rivers and lakes"), (None, "quite another one, of cars"), (None, "nobody has this one")], "doc_id long, text string")
    got = simhash_dedup.deduplicated(rows).collect()
    assert sorted(map(tuple, got), key=str) == [(5, "one text about rivers and lakes"), (5, "quite another one, of cars"), (None, "nobody has this one")]
