"""The registered queries against the tokenizers library and the contract's own words, over the smallest tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tollhouse.llm import packing
from tollhouse.llm.registry import QUERIES


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def ids_of(path, texts, end=None):
    tok = Tokenizer.from_file(public_tokenizers.path(path))
    tok.no_truncation()
    tok.no_padding()
    return {i: tok.encode(t, add_special_tokens=False).ids + ([] if end is None else [end]) for i, t in texts.items()}, tok


def le(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_op1(spark, sf, texts):
    rows = QUERIES["op1_webp"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-32:])


def test_op3(spark, sf, texts):
    ids, _ = ids_of("byte_bpe_50k.json", texts, 0)
    rows = {r.doc_id: r for r in QUERIES["op3_sstable"](spark, sf).collect()}
    start = 0
    for i in sorted(texts):
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids[i]), zlib.crc32(le(ids[i])))
        start += len(ids[i])
    assert len(rows) == len(texts)


@pytest.mark.parametrize("together", [packing.TOGETHER, 50])
def test_op5(spark, sf, texts, monkeypatch, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    ids, _ = ids_of("word_bpe_49k.json", texts, 1)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op5_harmonic_pack"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(le(own[at : at + r.length]))
            at += r.length
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(map(len, ids.values())) / len(sequences) > 0.8 * 2048


def test_op8(spark, sf, texts):
    ids, tok = ids_of("byte_bpe_50k.json", texts)
    rows = QUERIES["op8_batched_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = ids[r.doc_id]
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(le(own)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(own, skip_special_tokens=False).encode()).hexdigest()
