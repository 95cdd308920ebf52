"""Ids against the public library, and exact round trips."""

import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
TWIN = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.Coder(RANKS, public_tokenizers.PATTERN)


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_every_token_is_what_its_bytes_merge_into():
    tokens = sorted(RANKS)
    for query in (bpe.SHORT, bpe.LONG):
        _, got = CODER.merge(tokens, query)
        assert got.tolist() == [RANKS[t] for t in tokens]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab \n'st.1é", max_size=60), max_size=6))
def test_any_text(texts):
    coded, decoded = CODER.code(texts)
    assert [ids(x) for x in coded] == [TWIN.encode_ordinary(t) for t in texts]
    assert decoded == [t.encode() for t in texts]


def test_long_words_and_small_caches(monkeypatch):
    rnd = random.Random(2)
    texts = ["a" * 20000, "ab" * 3000 + " x", "".join(rnd.choice("abcdefgh") for _ in range(6000)), "日本語テキスト" * 60, "x" * 65, "<|endoftext|>"]
    assert [ids(x) for x in CODER.code(texts)[0]] == [TWIN.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    for _ in range(3):
        some = [" ".join(rnd.choice("the of tion erth ung, Zu".split()) for _ in range(30)) for _ in range(5)]
        assert [ids(x) for x in CODER.code(some)[0]] == [TWIN.encode_ordinary(t) for t in some]


def test_more_new_words_than_memory_holds():
    rnd = random.Random(3)
    text = " ".join("".join(map(chr, rnd.choices(range(0x4E00, 0x9000), k=8))) for _ in range(260_000))
    (coded,), (decoded,) = bpe.Coder(RANKS, public_tokenizers.PATTERN).code([text])
    assert ids(coded) == TWIN.encode_ordinary(text)
    assert decoded == text.encode()


def test_a_word_of_any_length():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("etaoinshr", k=40_000)), "".join(map(chr, rnd.choices(range(0x4E00, 0x9000), k=9000))), "a" * 90_001, "abc" * 9001, "日本語テキスト" * 900, "=-" * 5001]
    coded, decoded = bpe.Coder(RANKS, public_tokenizers.PATTERN).code(texts)
    assert [ids(x) for x in coded] == [TWIN.encode_ordinary(t) for t in texts]
    assert decoded == [t.encode() for t in texts]


def test_parts_of_any_word(monkeypatch):
    monkeypatch.setattr(bpe, "PART", 12)
    monkeypatch.setattr(bpe, "OVERLAP", 6)
    rnd = random.Random(5)
    words = ["".join(rnd.choices(some, k=rnd.randrange(70, 200))) for some in ("ab", "aehnrt", "=-", "日本語é") for _ in range(30)]
    words += ["".join(rnd.choices("aehnrst", k=rnd.randrange(1, 9))) * 40 for _ in range(30)]
    for word in words:
        assert CODER.in_parts(word.encode()).tolist() == TWIN.encode_ordinary(word)


def test_runs_of_spaces_whatever_was_seen_before():
    ranks = {bytes([i]): i for i in range(256)} | {b"  ": 256}
    twin = tiktoken.Encoding("spaces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN)
    for text in ("a  b", "a   b", " c", "   c", "a b"):
        assert ids(coder.code([text])[0][0]) == twin.encode_ordinary(text)


def test_texts_out_of_known_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 3)
    texts = ["", "the end of it", "  é  x ", "", " ", "the end", "\n the\tend \n", ""]
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    for given in ([""], texts, texts[::-1]):
        # A slice of a longer column, as runs of a batch are.
        coded, decoded = coder.coded(pa.array(["before", *given, "after"]).slice(1, len(given)))
        assert [ids(x) for x in coded.bytes()] == [TWIN.encode_ordinary(t) for t in given]
        assert decoded.bytes() == [t.encode() for t in given]
        assert (coded.flat.dtype, decoded.flat.dtype) == ("int32", "uint8")


def test_pieces_can_be_forgotten():
    coder = bpe.Coder(RANKS, public_tokenizers.PATTERN)
    coder.code(["some words"])
    coder.forget()
    assert not coder.known.number and not coder.old.number and not len(coder.known.ids.flat)
    assert ids(coder.code(["some words"])[0][0]) == TWIN.encode_ordinary("some words")


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "two words", "c"), (None, "two words", "c")], "doc_id long, text string, ids string")
    got = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r["row"]["ids"], list(r["ids"]), bytes(r["decoded"])) for r in got) == [("a", [], b""), ("b", [], b"")] + [("c", TWIN.encode_ordinary("two words"), b"two words")] * 2
    assert bpe.encode_decode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
