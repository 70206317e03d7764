import hashlib
import random

import pytest

from larkspur.llm import pieces

sp = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
EDGE = ["", " ", "  ", "   a", "a  ", " \n ", "▁a ▁▁b", "<s> </s> <unk> <0x0A>", "日本語 テキスト ☃ \x00\x01 é", "x" * 3000, " " * 500, " " * 17 + "a", "a" * 100 + " " * 31 + "!!!!====", "\ttab\r\n", "a, b.c;d|e%%%"]


def random_texts():
    rng = random.Random(1)
    known = [p for p in pieces.load_pieces(MODEL)[0] if len(p) < 8]
    letters = "aeiou tthn  ▁.,!\"=-0129éß日\n\t()"
    return [["".join(rng.choice(src) for _ in range(rng.randint(0, 40))).replace("▁", " ") for _ in range(300)] for src in (known, letters)]


def test_same_as_library():
    table, lib = pieces.PrefixTable(*pieces.load_pieces(MODEL)), sp.SentencePieceProcessor(model_file=MODEL)
    for t in EDGE + sum(random_texts(), []):
        ids = lib.encode(t)
        assert table.encode(t) == ids, t
        assert table.decode(ids) == lib.decode(ids), t


def test_digest_and_columns(spark):
    lib = sp.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "mine") for i, t in enumerate([None, *EDGE, *EDGE])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for r in pieces.digest(df, MODEL).collect():
        ids = lib.encode(rows[r.doc_id][1] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = pieces.decode(pieces.encode(df, MODEL), MODEL)
    assert {"ids", "ids_in", "decoded", "doc_id", "text"} == set(back.columns)
    assert all(r.decoded == lib.decode(lib.encode(r.text or "")) and r.ids_in == "mine" for r in back.collect())
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_two_vocabularies_in_one_session(spark, tmp_path):
    """Workers are reused; each call is encoded with its own vocabulary."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    normal = [i for i, p in enumerate(proto.pieces) if p.type == 1]
    rows = [(proto.pieces[i].piece, proto.pieces[i].score) for i in normal]
    for i, (piece, score) in zip(normal, reversed(rows)):
        proto.pieces[i].piece, proto.pieces[i].score = piece, score
    other = str(tmp_path / "other.model")
    with open(other, "wb") as f:
        f.write(proto.SerializeToString())
    df = spark.createDataFrame([(i, f"some words number {i}") for i in range(8)], "doc_id long, text string")
    libs = {m: sp.SentencePieceProcessor(model_file=m) for m in (MODEL, other)}
    for m in [MODEL, other] * 4:
        assert all(list(r.ids) == libs[m].encode(r.text) for r in pieces.encode(df, m).collect())


def test_models_without_bytes_are_refused():
    known, scores, types = pieces.load_pieces(MODEL)

    class Rules:
        precompiled_charsmap, remove_extra_whitespaces, add_dummy_prefix, escape_whitespaces = "", False, True, True

    with pytest.raises(ValueError):
        pieces.check_model(2, Rules, known, scores, [1 if t == 6 else t for t in types])


def test_known_pieces_need_no_second_look(monkeypatch):
    """Ids of a chunk of normal pieces are looked up in one go; others go the long way, and both give the library's ids and text."""
    table, lib = pieces.PrefixTable(*pieces.load_pieces(MODEL)), sp.SentencePieceProcessor(model_file=MODEL)
    slow, token_ids = [], table.token_ids
    monkeypatch.setattr(table, "token_ids", lambda t: (slow.append(t), token_ids(t))[1])
    for text, long_way in (("the same words, the same ids", False), ("a \U0001f9ff\u0dfe b", True), ("", False)):
        slow.clear()
        ids = lib.encode(text)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert pieces._digests(table, text)[:3] == (len(ids), digest(",".join(map(str, ids))), digest(lib.decode(ids)))
        assert bool(slow) == long_way
