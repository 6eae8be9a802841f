"""Encoding against the SentencePiece library, and decoding as an exact round trip."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "    x     y ", "Hello  world\nfoo\t éa   b", "日本語テスト 🙂👍🏽", "a" * 300, " " * 200, "ab" * 5000, "▁x▁", "\x00\x7f", "<s> <unk> <0x41>", "ﬁ ½ İ ẞ", "thththththehehere" * 9, None]


@pytest.fixture(scope="module")
def unigram():
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = np.random.default_rng(5)
    m = pb.ModelProto.FromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = float(np.float32(-3 * len(p.piece) ** 0.6 - 4 * rng.random()))
    return m.SerializeToString()


def library(sp, text):
    return sp.encode(text) if text else []


def test_query(spark):
    d = "/root/testdata/sf0.01"
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    rows = lattice.op3_sentencepiece(spark, d).collect()
    assert len(rows) == len(text) and all(r.ids == sp.encode(text[r.doc_id]) and r.n_ids == len(r.ids) for r in rows)
    import zlib

    assert all((r.decoded_bytes, r.decoded_crc32) == (len(text[r.doc_id].encode()), zlib.crc32(text[r.doc_id].encode())) for r in rows)


def test_odd_texts_and_no_common_parts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(i % 13, t, 1) for i, t in enumerate(ODD + ODD[:4])], "doc_id long, text string, block int").repartition(3)
    for most, chars in ((1, 1 << 20), (1000, 100)):
        ids = lattice.encoded(df, lattice.load(PATH), most=most, chars=chars)
        want = sorted((i % 13, library(sp, t)) for i, t in enumerate(ODD + ODD[:4]))
        assert sorted(map(tuple, ids.collect())) == want
    back = sorted((r.doc_id, r.text) for r in lattice.decoded(ids, lattice.load(PATH)).collect())
    assert back == sorted((i % 13, (t or "").replace("▁", " ")) for i, t in enumerate(ODD + ODD[:4]))  # the space sign itself is lost, as in the library
    assert lattice.encoded(df.where("false"), lattice.load(PATH)).count() == 0


def test_parts_are_dealt_once(spark):
    """Blocks, and their parts, are each shuffled once, though each is read twice."""
    df = spark.createDataFrame([(i, f"some word{i} hereqz{i % 7}") for i in range(50)], "doc_id long, text string").repartition(3)
    ids = lattice.encoded(df, lattice.load(PATH), most=1)
    assert len(ids.collect()) == 50
    plan = ids._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    for what in ("part", "block"):
        dealt = [x for x in plan if f"Exchange hashpartitioning({what}#" in x and "REPARTITION" in x]
        assert len(dealt) == 2 and sum("ReusedExchange" in x for x in dealt) == 1, what


def test_unigram_by_viterbi(spark, unigram):
    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram)
    model = lattice.read_model(unigram)
    assert model.fold == "viterbi"
    texts = [*duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' limit 40").fetchall(), *[(t,) for t in ODD if t]]
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in lattice.encoded(df, model, most=50).collect()}
    for i, (t,) in enumerate(texts):
        assert sp.decode(got[i]) == t.replace("▁", " ")
        value = [sum(model.scores[k] if model.normal[k] else lattice.unknown_score(model) for k in ids) for ids in (got[i], sp.encode(t))]
        assert value[0] >= value[1] - 1e-2  # a best path; the library's sums are of single precision
    exact = sum(got[i] == sp.encode(t) for i, (t,) in enumerate(texts))
    assert exact >= 0.7 * len(texts)


def test_parts_of_any_length(spark, unigram):
    """Both folds on the same parts, and parts beyond one mask, as the library merges them or as a loop finds the best path."""
    rng = np.random.default_rng(3)
    parts = {"".join(rng.choice(list("thearonsi" + lattice.SPACE), n)) for n in rng.integers(1, 62, 300)} | {lattice.SPACE * n for n in range(1, 40)}
    model = lattice.load(PATH)
    known, own = lattice.known_pieces(model), lattice.layout(model)
    tardy = lattice.late(known)
    vocabulary = spark.createDataFrame([(p, own.code(min(int(-s), own.unknown - 1), len(p), p in tardy, i)) for p, (s, i) in known.items()], "piece string, code long")
    df = spark.createDataFrame([(p,) for p in parts], "part string")
    short, wide = ({r.part: [tuple(x) for x in r.path] for r in lattice.merged(df, vocabulary, own, 16, mask).collect()} for mask in (lattice.MASK, 0))
    assert short == wide and len(short) == len(parts)
    long_ = ["".join(rng.choice(list("thearonsi"), n)) for n in (63, 64, 65, 127, 130, 700, 3000)] + ["th" * 400, "a" * 1000, "the" * 100]
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = spark.createDataFrame([(i, p) for i, p in enumerate(long_)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in lattice.encoded(texts, lattice.load(PATH), most=1).collect()}
    assert got == {i: sp.encode(p) for i, p in enumerate(long_)}
    model = lattice.read_model(unigram)
    known, unknown = lattice.known_pieces(model), lattice.unknown_score(model)

    def best(part):
        score = [0.0]
        for j in range(1, len(part) + 1):
            score.append(max([score[i] + known[part[i:j]][0] for i in range(max(0, j - 16), j) if part[i:j] in known] + [score[j - 1] + unknown] * (part[j - 1] not in known)))
        return score[-1]

    for r in lattice.encoded_parts(spark.createDataFrame([(p,) for p in long_], "part string"), model).collect():
        assert abs(sum(model.scores[i] for i in r.ids) - best(r.part)) < 1e-6 and "".join(model.pieces[i] for i in r.ids) == r.part


def test_too_large_a_model_is_refused(monkeypatch):
    monkeypatch.setattr(lattice, "START", 40)
    with pytest.raises(ValueError, match="too large"):
        lattice.read_model(open(PATH, "rb").read())


def test_ties_repeats_and_clashing_names(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(1, "one two", "p", 9), (1, "one two", "p", 9), (1, "three", "q", 8), (None, "four", None, None)], "doc_id long, text string, part string, block int")
    got = sorted(((r.doc_id, r.ids) for r in lattice.encoded(df, lattice.load(PATH)).collect()), key=repr)
    assert got == sorted([(1, sp.encode("one two"))] * 2 + [(1, sp.encode("three")), (None, sp.encode("four"))], key=repr)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text("thearonsi ▁\né日", max_size=80), min_size=1, max_size=40))
def test_merges_equal_library(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in lattice.encoded(df, lattice.load(PATH), most=1).collect()} == {i: library(sp, t) for i, t in enumerate(texts)}
