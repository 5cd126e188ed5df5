from __future__ import annotations

import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from echotide.llm import sentencepiece_bpe  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_equals_the_library(library):
    codec = sentencepiece_bpe.Codec(sentencepiece_bpe.read_model(MODEL), keep=50)
    rng = random.Random(5)
    cases = ["", " ", "a" * 500, "▁", "<s></s><unk><0x41>", "\u0000\n\t\r", "नमस्ते दुनिया", "\U0001f600‍"]
    alphabet = " ▁\n\tabcdetheings<>é漢あ.,'0123\U0001f600́"
    cases += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text in cases:
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)
        assert codec.both(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_table(docs, texts, no_docs, library):
    got = sentencepiece_bpe.encode_decode(docs, model_path=MODEL).collect()
    expected = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in texts]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == sorted(expected, key=str)
    assert sentencepiece_bpe.encode_decode(no_docs, model_path=MODEL).count() == 0
