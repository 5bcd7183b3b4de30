"""Every query of the corpus operators on the smallest tables: names and types of its columns, and the rows of its SQL."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op7_audio": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op8_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op9_warc": "record_id bigint, kind string, canonical string, at bigint, status string, response_id bigint, headers_md5 string",
    "op10_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "pipeline": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        made.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, con, texts, name):
    made = contract.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in made.dtypes) == COLUMNS[name]
    rows = made.collect()
    if name in contract.oracle_sql():
        want = con.sql(contract.oracle_sql()[name])
        order = [want.columns.index(c) for c in made.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    elif name not in ("op3_packing", "pipeline"):
        assert sorted(r.doc_id for r in rows) == sorted(texts)


def test_tokens_of_the_queries(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for i, t in texts.items()}
    made = {r.doc_id: tuple(r)[1:] for r in contract.queries()["op4_bpe"](spark, SF).collect()}
    assert made == {i: (len(x), sha(x.tobytes()), sha(library.decode(x.tolist(), skip_special_tokens=False).encode())) for i, x in ids.items()}
    made = {r.doc_id: tuple(r)[1:] for r in contract.queries()["op6_token_counts"](spark, SF).collect()}
    assert made == {i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts.items()}
    held: dict = {}
    for r in contract.queries()["op3_packing"](spark, SF).collect():
        whole = np.append(ids[r.doc_id], np.uint32(0)).astype("<u4")
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_payloads_of_the_audio_query(spark, texts):
    for r in contract.queries()["op7_audio"](spark, SF).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
