"""SentencePiece encoding held against the library, whole tables and hostile texts."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row

from rillwork.llm import queries, sentence_pieces

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return sentence_pieces.Encoder(sentence_pieces.read_vocabulary(MODEL))


ODD = ["", " ", "   ", "  a  b ", " a", "a  ", "a\nb\tc", "▁x ", "▁", "▁▁ ▁a▁b", "ﬁ①Ａ", "　x", "é", "\x00a", "<s>", "</s>x", "<0x0A>", "\r\n", "x" * 5000, " " * 1001, "ab " * 40, "aé日本" * 50, "der" * 3000]


def test_odd_texts(encoder, library):
    for t in ODD:
        ids = library.encode(t, add_eos=True)
        assert encoder.encode(t).tolist() == ids, t[:30]
        assert encoder.encode(t, end=False).tolist() == ids[:-1]
        assert encoder.decode(ids) == library.decode(ids)
    assert encoder.encode(None).tolist() == [2]


def test_random_texts_and_ids(encoder, library):
    r = random.Random(3)
    alphabet = "abcdet in er\n.,;▁ éß日1 2\r\t()_<>the"
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 50)))
        assert encoder.encode(t).tolist() == library.encode(t, add_eos=True), t
    for _ in range(4000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(32000), 0, 1, 2]) for _ in range(r.randint(0, 6))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_small_caches_and_slices_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "ENTRIES", 5)
    monkeypatch.setattr(sentence_pieces, "SLICE_CHARS", 40)
    small = sentence_pieces.Encoder(sentence_pieces.read_vocabulary(MODEL))
    r = random.Random(4)
    for _ in range(500):
        t = "".join(r.choice(["the ", "  ", "einen", "▁", "é", ".\n", " under"]) for _ in range(80))
        assert small.encode(t).tolist() == library.encode(t, add_eos=True), t


def test_a_vocabulary_whose_pieces_cross_spaces_is_not_cut_into_words(encoder):
    v = encoder.v
    crossing = sentence_pieces.Encoder(sentence_pieces.Vocabulary([*v.pieces, "a▁b"], [*v.scores, 5.0], [*v.plain, True], v.byte_ids, v.unknown, v.end))
    assert crossing.crosses
    assert len(v.pieces) in crossing.encode("xa bx").tolist()


def test_query(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_sentencepiece(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r, ids in zip(rows, library.encode([r["text"] or "" for r in rows], add_eos=True), strict=True):
        mine = got[r["doc_id"]]
        assert (mine["n_tokens"], mine["ids_sha256"], mine["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_odd_rows(spark, encoder):
    rows = [Row(doc_id=1, text=None, ids="x"), Row(doc_id=1, text="", ids="y"), Row(doc_id=None, text="a b", ids=None), Row(doc_id=2, text="a b", ids="z"), Row(doc_id=2, text="a b", ids="z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in sentence_pieces.encode(docs, encoder.v, ["doc_id"]).collect()]
    ab = encoder.encode("a b").tolist()
    assert sorted(got, key=repr) == sorted([(1, [2], ""), (1, [2], ""), (None, ab, "a b"), (2, ab, "a b"), (2, ab, "a b")], key=repr)
    assert sentence_pieces.encode(docs.limit(0), encoder.v, ["doc_id"]).count() == 0
