import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from llm_cases import none, odd  # noqa: F401
from opsmill.llm import arrays as A
from opsmill.llm import byte_bpe as B
from opsmill.llm.queries import rank_file

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HARD = ["", "don't 'tis 's  's\n's it''s we'RE we're're'll", "  a  b\n\n c\t\td  \n", "a \n b 12 ab12 !!'s x's'd'dd 'veve 'v 'r", "  x \x85y z",
        "日本語 テキスト٣٤ é ñ 🎉🎉 x", "x" * 1500, "ab " * 700 + "  ", "   ", "'", "'s", "' s", " '", " 's", "\n'll", "<|endoftext|>", "a" * 300 + "'re" * 200,
        "'" * 50 + "t", "12'3's", " 　'd", "\t \n \r\n's'", "Ⅷ½ x²"]


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(open(rank_file(), "rb").read())


@pytest.fixture(scope="module")
def token_bytes():
    return B.TokenBytes(open(rank_file(), "rb").read())


def texts():
    rng = random.Random(11)
    alphabet = list("abst 'revmld \n\t!?0159éüß日٣🎉  ") + ["'s", "'re", " the", "  "]
    return HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(300)]


def test_boundaries_equal_the_pattern():
    for group in (texts(), [t * 30 for t in texts()[:20]]):
        t = A.texts_of(pa.array(group, pa.string()))
        begin = B.starts(t)
        for i, text in enumerate(group):
            want = [m.group().encode() for m in regex.finditer(PATTERN, text)]
            own = begin[(begin >= t.at[i]) & (begin < t.at[i + 1])].tolist()
            got = [t.data[a:b].tobytes() for a, b in zip(own, [*own[1:], t.at[i + 1]], strict=False)]
            assert got == want, text[:80]


def test_ids_equal_tiktoken_and_round_trip(vocabulary, token_bytes):
    tiktoken = pytest.importorskip("tiktoken")
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    group = texts()
    t = A.texts_of(pa.array(group, pa.string()))
    ids, n, each, row = vocabulary.encode(t)
    at = A.sums(n)
    for i, text in enumerate(group):
        assert ids[at[i]:at[i + 1]].tolist() == reference.encode_ordinary(text), text[:80]
    data, size = token_bytes.decode(ids)
    assert data.tobytes() == t.data.tobytes() and int(size.sum()) == len(data)
    assert int(each.sum()) == len(ids) and np.array_equal(np.bincount(row, weights=each, minlength=len(group)).astype(int), n)


def test_cache_may_overflow(vocabulary, monkeypatch):
    t = A.texts_of(pa.array(texts(), pa.string()))
    want = vocabulary.encode(t)[0]
    monkeypatch.setattr(B, "CACHE_SLICES", 10)
    for _ in range(2):
        assert np.array_equal(vocabulary.encode(t)[0], want)


def test_spark_round_trip_with_odd_rows(spark, odd, none):
    path = rank_file()
    coded = B.encode(odd, path)
    rows = {(r["doc_id"], tuple(r["ids"])): r for r in coded.collect()}
    assert sum(1 for _ in coded.collect()) == odd.count()
    for r in rows.values():
        assert len(r["offsets"]) == 0 or (r["offsets"][0] == 0 and r["offsets"] == sorted(r["offsets"]) and r["offsets"][-1] < len(r["ids"]))
    back = sorted(hashlib.sha256(bytes(r["decoded"])).hexdigest() for r in B.decode(coded, path).collect())
    assert back == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd.collect())
    got = {r["doc_id"]: r for r in B.digest(odd, path).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == got[2]["decoded_sha256"]
    one = next(r for r in coded.collect() if r["doc_id"] == 5)
    assert got[5]["ids_sha256"] == hashlib.sha256(",".join(map(str, one["ids"])).encode()).hexdigest()
    assert B.digest(none, path).count() == 0


def test_slices_decode_by_their_offsets(spark, odd, token_bytes):
    path, v = rank_file(), token_bytes
    row = next(r for r in B.encode(odd, path).collect() if r["doc_id"] == 12)
    text = next(r["text"] for r in odd.collect() if r["doc_id"] == 12)
    ends = [*row["offsets"][1:], len(row["ids"])]
    pieces = [v.decode(np.array(row["ids"][a:b]))[0].tobytes().decode() for a, b in zip(row["offsets"], ends, strict=True)]
    assert pieces == [m.group() for m in regex.finditer(PATTERN, text)]


def test_null_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in B.decode(df, rank_file()).collect()] == [b"", b""]


def test_rank_file_is_complete(vocabulary):
    assert len(vocabulary.ranks) == 50_256 and base64.b64encode(b"a")
