import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerloom.llm import pieces, registry

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "hello world", "a▁b ▁ c", "\t\nx\r\n\n y", "naïve Ünïcode ﬁ Ⅷ", "日本語 テキスト 🙂👩‍👩‍👧", "\x00\x01", "x" * 3000, "ab" * 40 + " " * 50 + "<s></s><0x0A>", "é\u0301 \u00a0 \u3000z", "ᚠᛇᚻ ▁▁", "The end."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(open(PATH, "rb").read())


def random_texts(n=300):
    r = random.Random(5)
    alphabet = "abcdefgh  .,\n▁éß日🙂\u0301 \tXYZ019"
    return ["".join(r.choices(alphabet, k=r.randint(0, 120))) for _ in range(n)]


def test_same_ids_text_and_spans_as_the_library(model, library):
    for text in TEXTS + random_texts():
        ids, ends, start = model.encode(text)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces], text
        assert model.decode(ids.tolist()) == library.decode(ids.tolist()), text
        assert ends.tolist() == [p.end for p in proto.pieces], text
        if len(ids):
            assert start == proto.pieces[0].begin


def test_decode_of_arbitrary_ids(model, library):
    r = random.Random(7)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 260), r.randrange(32000), 1, 2]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_longest_prefix_normalisation_with_alignment(rule):
    from sentencepiece import sentencepiece_model_pb2

    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(norm.serialized_model_proto())
    m = pieces.PieceModel.__new__(pieces.PieceModel)
    m.charsmap = pieces.CharsMap(proto.normalizer_spec.precompiled_charsmap)
    m.dummy = m.squeeze = True
    for text in TEXTS + random_texts(100):
        got, align = m.normalize(text)
        want, offsets = norm.normalize(text, with_offsets=True)
        assert got == want, text
        starts = [0, *[len(got[:k].encode()) for k in range(1, len(got) + 1)]]
        at = [0, *[len(text[:k].encode()) for k in range(1, len(text) + 1)]]
        if got:  # of nothing the library reports no place
            assert [align[i] for i in starts] == [at[k] for k in offsets], text


def test_query_on_nulls_repeats_clashes_and_empty_tables(spark, library, tmp_path):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (3, "x y", "c"), (None, "z", None), (5, "word " * 30000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op1(spark, str(tmp_path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    df.filter(F.lit(False)).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert registry.op1(spark, f"{tmp_path}/empty").count() == 0


def test_words_merged_together_equal_single_merges(monkeypatch):
    """learn fills the memo so that no word of up to _SHORT characters is merged alone."""
    import random

    import numpy as np
    import public_tokenizers

    from ledgerloom.llm import pieces

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        blob = f.read()
    plain, learned = pieces.PieceModel(blob), pieces.PieceModel(blob)
    r = random.Random(3)
    texts = ["", " ", "  a", "x" * 30, "the  quick brown\n\tfox", "\u2581 mark", "日本語 テキスト", "\U0001f600\u0301 é\x00 \U000e0041z"]
    texts += ["".join(r.choices("abcdeinrst éñ日\U0001f600\u1234\n ", k=200)) for _ in range(200)]
    want = [plain.encode(t) for t in texts]
    learned.learn(texts)
    monkeypatch.setattr(learned, "_merge", lambda word: 1 / 0 if word in short else plain._merge(word))
    short = {w for t in texts if t and pieces.SPACE not in t for w in plain.split(pieces.SPACE + t.replace(" ", pieces.SPACE)) if len(w) <= pieces._SHORT}
    for t, (ids, ends, start) in zip(texts, want, strict=True):
        got = learned.encode(t)
        assert np.array_equal(got[0], ids) and np.array_equal(got[1], ends) and got[2] == start, t
