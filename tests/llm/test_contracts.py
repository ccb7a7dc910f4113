"""Every registered query over the smallest tables: its columns, and its rows against SQL where there is some."""

import duckdb
import pytest

from wavemill.llm import bpe
from wavemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_language_id": "page_id bigint, lang string, probability double",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_pii": "doc_id bigint, text string, n_pseudonyms bigint",
    "op9_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op10_packing": "doc_id bigint, n_tokens bigint, bucket int, padded_to bigint, padding bigint, batch_id bigint, slot int",
}
SIZES = {"op2_chat_format": "(SELECT count(DISTINCT conv_id) + 1 FROM conversations)", "op5_language_id": "(SELECT count(*) FROM pages)", "op11_vector_codes": "(SELECT count(*) FROM embeddings)", "op12_url_filter": "(SELECT count(*) FROM pages)", "op7_topk": "(SELECT 5 * count(*) FILTER (vec_id % 50 = 0) FROM embeddings)"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name].split(", "):
        assert kinds[c.split()[0]] == c.split()[1]
    rows = [r.asDict() for r in df.collect()]
    assert name == "op13_source_divergence" or len(rows) == duck.sql(f"select {SIZES.get(name, '(SELECT count(*) FROM documents)')}").fetchall()[0][0]
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in rel.columns) for r in rows) == sorted(rel.fetchall())
    texts = {r[0]: r[1] or "" for r in duck.sql("select doc_id, text from documents").fetchall()}
    if name == "op6_toxicity":
        import zlib

        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name == "op4_byte_bpe" or name == "op10_packing":
        assert all(r["n_tokens"] == len(bpe.encoding().encode_ordinary(texts[r["doc_id"]])) for r in rows)
    if name == "op3_quality_rules":
        for r in rows:
            t = texts[r["doc_id"]]
            words, lines = t.encode().split(), [x for x in t.split("\n") if x.encode().split()]
            figures = len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == figures
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
