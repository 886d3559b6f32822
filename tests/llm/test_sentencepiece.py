import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from obliqua.llm.queries import tokenizer_path
from obliqua.llm.sentencepiece_codec import PieceModel, decode, encode, round_trip

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY, MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH), PieceModel(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("  aeitsrnoThé漢😀0123\n\t.,<>▁")), max_size=40), max_size=5))
def test_ids_are_the_library_s(texts):
    got = MODEL.encode(texts)
    assert got == LIBRARY.encode(texts)
    assert [MODEL.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_documents(frame, odd_texts):
    rows = {r["doc_id"]: r["ids"] for r in encode(frame(odd_texts), PATH).collect()}
    assert [rows[i] for i in range(len(odd_texts))] == LIBRARY.encode([t or "" for t in odd_texts])
    back = {r["doc_id"]: r["text"] for r in decode(encode(frame(odd_texts), PATH), PATH).collect()}
    assert [back[i] for i in range(len(odd_texts))] == [t or "" for t in odd_texts]
    assert round_trip(frame([]), PATH).count() == 0
    assert round_trip(frame(["a", "a"], ids=[None, None]), PATH).count() == 2


def test_a_unigram_model_takes_the_largest_sum(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    r = random.Random(4)
    for piece in model.pieces:
        if piece.type == 1:
            piece.score = -r.random() * 10 - 1
    model.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    texts = ["the cat sat on the mat", "internationalisation of words", "a  b"]
    assert PieceModel(str(path)).encode(texts) == sentencepiece.SentencePieceProcessor(model_file=str(path)).encode(texts)


def test_foreign_ids_are_refused():
    with pytest.raises(ValueError):
        MODEL.decode([10**6])
