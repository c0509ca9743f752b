import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pagewright.llm.sentencepiece_fst import MARK, decode_ids, encode_texts, transducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", "a", "  two  spaces ", "line\nbreak\n\n", "ﬁ ① １ 日本 😀", "<s> </s> <0x41>", "e\u0301\u200b", "tab\tx", "x" * 500, "\x00\x01", "▁mark"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library(library):
    machine, rng = transducer(MODEL), random.Random(2)
    texts = HARD + ["".join(rng.choice("ab e▁ \n\ttheXYingé日本😀<>sß") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for text in texts:
        ids = np.frombuffer(machine.encode(text), "<i4")
        assert ids.tolist() == library.encode(text), text
        assert machine.decode(ids) == text.replace(MARK, " ") == library.decode(ids.tolist()), text


def test_every_neighbour_of_a_merged_word_is_stable(library):
    machine = transducer(MODEL)
    for word in ("▁internationalization", "▁Donaudampfschiff", "▁l'éphémère"):
        path, _ = machine.merges(word)
        assert machine.shortest(word) == path
        assert all(machine.neighbours(a, b) for a, b in zip(["", *path], path))


def test_tables(spark):
    schema = "doc_id bigint, text string, key int, ids string"
    rows = [(i, t, 1, "") for i, t in enumerate(HARD)] + [(None, None, 1, ""), (1, " ", 1, "")]
    encoded = encode_texts(spark.createDataFrame(rows, schema), MODEL)
    found = decode_ids(encoded, MODEL).collect()
    assert sorted((r.doc_id or -1, r.text) for r in found) == sorted((r[0] or -1, (r[1] or "").replace(MARK, " ")) for r in rows)
    assert decode_ids(encode_texts(spark.createDataFrame([], schema), MODEL), MODEL).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert [r.text for r in decode_ids(nothing, MODEL).collect()] == [None]


def write_unigram(path, pieces):
    """A unigram model file of (piece, score, kind)."""
    import struct

    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    body = b"".join(
        field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind])) for p, score, kind in pieces
    )
    path.write_bytes(body + field(2, bytes([0x18, 1])) + field(3, bytes([0x18, 1, 0x20, 0])))


def test_unigram_models_take_the_cheapest_path(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.2, 1), ("ba", -6.0, 1)]
    write_unigram(tmp_path / "m.model", pieces)
    machine = transducer(str(tmp_path / "m.model"))
    names = [p for p, _, _ in pieces]

    def best(text):
        if not text:
            return 0.0
        costs = [(-s + best(text[len(p) :])) for p, s, k in pieces if k == 1 and text.startswith(p)]
        return min(costs) if costs else float("inf")

    for text in ("ab", "aab", "abab", "baab ab"):
        ids = np.frombuffer(machine.encode(text), "<i4").tolist()
        told = MARK + text.replace(" ", MARK)
        assert "".join(names[i] for i in ids) == told
        assert abs(-sum(pieces[i][1] for i in ids) - best(told)) < 1e-5
    assert np.frombuffer(machine.encode("c"), "<i4").tolist() == [1, 0]
