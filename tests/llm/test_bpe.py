import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from tablelens.llm import bpe
from tablelens.llm.common import table
from tablelens.llm.queries import QUERIES, public_tokenizer

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*public_tokenizer())


def test_every_token_is_one_piece(codec):
    for i, token in enumerate(codec.tokens):
        assert codec.processor.encode(token.decode("latin-1").translate(codec.table)) == [i]


def test_characters_of_all_kinds(codec, library):
    for code in range(1, 0x11000, 3):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            text = f"a{c}b {c}1 {c}!{c}  {c} \n{c}\t x's"
            assert codec.encode(text).tolist() == library.encode_ordinary(text), hex(code)


def test_windows_and_forgetting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec, text = bpe.Codec(*public_tokenizer()), "One two  three\n\n four, five 67 eight nine ten é eleven " * 9
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_gap_in_ranks_or_missing_byte_is_an_error(tmp_path):
    gap = tmp_path / "gap"
    gap.write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(gap))
    with pytest.raises(ValueError):
        bpe.serialise([b"a"])


def test_odd_rows_round_trip(odd, library):
    made = bpe.encode_documents(odd, public_tokenizer(), decoded=True)
    assert made.columns == [*odd.columns, "ids", "decoded"]
    for r in made.collect():
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    again = bpe.decode_documents(made.drop("decoded"), public_tokenizer())
    assert again.filter("decoded != cast(coalesce(text, '') as binary)").count() == 0
    assert bpe.encode_documents(odd.limit(0), public_tokenizer()).count() == 0


def test_query_equals_library(spark, folder, library):
    found = {r["doc_id"]: r for r in QUERIES["op1_byte_bpe"](spark, folder).collect()}
    for r in table(spark, folder, "documents").collect():
        ids, row = library.encode_ordinary(r["text"]), found[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
