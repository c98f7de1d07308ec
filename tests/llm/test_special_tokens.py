"""Literals of special tokens in documents get the ids that the library gives them."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from tracewell.llm import packing

E, S = "<|endoftext|>", "<|startoftext|>"
TEXTS = [
    f"hello {E} world", f"{S} hello {E}", E, f"abc{E}def, {S}Xyz. x{E}", f"{E}{S}{E},", f"{E}abc, {S}def.", "<|EndOfText|> <|ENDOFTEXT|>a, x", f"é{E}Ünï, {S}\n{E}\t{E}", "<|endoftext <|startoftext|",
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_ids(k):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = [*Tokenizer.from_file(path).encode(TEXTS[k], add_special_tokens=False).ids, 0]
    assert np.frombuffer(packing.WordIds(path).encode([TEXTS[k]], 0)[0], "<u4").tolist() == want


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in enumerate(TEXTS)}
    got = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want


def test_batches_without_words():
    known = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert known.encode([], 0) == [] and known.ids(set()) == {}
    assert known.encode(["", "A, a."], 0) == [b"\0" * 4, known.encode(["a , a ."], 0)[0]]
