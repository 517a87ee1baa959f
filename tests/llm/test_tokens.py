"""Token operators against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer, pre_tokenizers

from tracehound.llm import byte_bpe, token_count, token_store

TEXTS = [
    None, "", " ", "  two  spaces ", "plain words here", "tabs\tand\nlines\n\nmore \n x", "a<|endoftext|>b <|startoftext|> c", "don't we'll I'M 's",
    "naïve Éàü 漢字 \U0001f600 x́  nbsp  end", "1234567 8 $%^&*", "ſ ABC\r\nDEF\x0b\x0cg", "z" * 3000, "word " * 4000, "\x00 \x01\x02",
    "mixed " + "ab12-_" * 900 + "\n\n\n  tail", "plain words here",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (4, "plain words here", "src")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_dac_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 1 << 31, 900), [0, 255, 256, 65535, 65536]])
    r = token_store.DacReader(token_store.dac_encode(ids))
    assert len(r) == len(ids) and [r[i] for i in range(len(ids))] == ids.tolist() and (r.decode() == ids).all()
    for a, e in [(0, len(ids)), (5, 5), (700, 701), *rng.integers(0, len(ids), (60, 2)).tolist()]:
        assert (r.span(min(a, e), max(a, e)) == ids[min(a, e) : max(a, e)]).all()
    with pytest.raises(IndexError):
        r.span(3, len(ids) + 1)
    assert len(token_store.DacReader(token_store.dac_encode([]))) == 0
    with pytest.raises(ValueError):
        token_store.DacReader(b"something else")


def test_store_equals_library(docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_store.read_tokens(token_store.write_tokens(docs, P.path("byte_bpe_50k.json"), block_tokens=500)).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_by_its_number(spark, docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    blocks = token_store.write_tokens(docs, P.path("byte_bpe_50k.json"), block_tokens=500)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    flat = [i for _, t in rows for i in [*tok.encode(t or "", add_special_tokens=False).ids, 2]]
    asked = [0, 1, 1, 499, 500, 501, 2345, len(flat) - 1, len(flat), -1, None]
    got = token_store.tokens_at(blocks, spark.createDataFrame([(i,) for i in asked], "place long")).collect()
    key = lambda r: str(r[0])
    assert sorted(map(tuple, got), key=key) == sorted(((i, flat[i] if i is not None and 0 <= i < len(flat) else None) for i in asked), key=key)


def test_other_tokenizers(spark):
    """Files whose cuts aren't known are encoded whole."""
    assert token_store.cuts_at_spaces(P.path("byte_bpe_50k.json")) == (True, True) and token_store.cuts_at_spaces(P.path("word_bpe_49k.json")) == (True, False)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    for chunk in (60, 1 << 15):
        assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, P.path("byte_bpe_50k.json"), chunk=chunk).collect()} == want


def test_other_tokenizer_file(spark, tmp_path):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    tok.save(str(tmp_path / "t.json"))
    assert not token_store.cuts_at_spaces(str(tmp_path / "t.json"))[0]
    docs = spark.createDataFrame(list(enumerate(TEXTS[:11])), "doc_id long, text string")
    want = {i: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(TEXTS[:11])}
    assert {r.doc_id: r.ids_crc32 for r in token_store.read_tokens(token_store.write_tokens(docs, str(tmp_path / "t.json"))).collect()} == want


def test_other_pattern(docs):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    pattern = r"\p{L}+| |\s*[^\s\p{L}]+ ?|\s+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), pattern).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.doc_id == 4 or r.ids == enc.encode_ordinary(r.text or "")


def test_empty_tables(docs):
    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    assert byte_bpe.encode_documents(docs.limit(0), *args).count() == byte_bpe.encode_digests(docs.limit(0), *args).count() == 0
    assert token_count.count_tokens(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_store_empty(spark, docs):
    assert token_store.read_tokens(token_store.write_tokens(docs.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("chunk", [40, 1 << 15])
def test_counts_equal_library(docs, chunk):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_count.count_tokens(docs, P.path("word_bpe_49k.json"), chunk=chunk).collect()
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 2048))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_splice_widens():
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    enc = token_count.with_offsets(P.path("word_bpe_49k.json"))
    for text in ("x" * 500 + " " + "some words follow here " * 50, "no" * 300, "a b " * 300 + "c" * 700 + " d", "one <|endoftext|> two " * 40):
        assert token_count.spliced(enc, text, chunk=64, overlap=8) == tok.encode(text, add_special_tokens=False).ids


def test_byte_bpe_equals_tiktoken(docs):
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    args = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    texts = {(d, t or "") for d, t in docs.select("doc_id", "text").collect()}
    by_id = {d: enc.encode_ordinary(t) for d, t in texts}
    for r in byte_bpe.encode_documents(docs, *args).collect():
        assert r.ids == by_id[r.doc_id] and bytes(r.decoded) == enc.decode_bytes(r.ids) and r.n_tokens == len(r.ids)
    digest = {d: (hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(i)).hexdigest()) for d, i in by_id.items()}
    got = byte_bpe.encode_digests(docs, *args).collect()
    assert len(got) == len(TEXTS) + 2 and all((r.ids_sha256, r.decoded_sha256) == digest[r.doc_id] for r in got)
