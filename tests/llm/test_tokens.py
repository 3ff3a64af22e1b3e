import hashlib
import string
import struct
from random import Random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from quillon.llm import bpe, registry, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), bpe.WordBpe(bpe.load(PATH))
PIECES = tokencount.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
UNIGRAM = Tokenizer(models.Unigram(PIECES, unk_id=0, byte_fallback=True))
UNIGRAM.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
COUNTER = tokencount.Counter(PIECES)
TEXT = st.text(st.characters(codec="utf-8", categories=("Lu", "Ll", "Nd", "Po", "Zs", "Sm")) | st.sampled_from("aAbé '\n<|>ß"), max_size=60)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_same_ids_as_the_library(text):
    assert ids(OWN.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_and_special_texts():
    for text in ("", "ΑΣ ΟΔΟΣ", "x<|endoftext|>Y <|startoftext|>", "ab" * 4000, "it'll we've 1234 --!!", "日本語" * 300):
        found = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids(OWN.encode(text)) == found
        assert OWN.decode(found) == LIBRARY.decode(found, skip_special_tokens=False)
    for word in ("thequickbrown" * 20, "a" * 300):
        parts = [OWN.inner[b] for b in word.encode()[:-1]] + [OWN.last[word.encode()[-1]]]
        assert OWN._scan(parts[:]) == OWN._heap(parts[:])


def test_query_digests(spark, small, docs):
    got = {r["doc_id"]: r for r in registry.op1_bpe(spark, small).collect()}
    for r in docs.collect():
        e = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        x = got[r["doc_id"]]
        assert x["n_tokens"] == len(e) and x["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark, edge, empty):
    coder = bpe.Coder(spark, PATH)
    rows = bpe.round_trip(edge, coder).collect()
    assert len(rows) == 11 and {bytes(r["ids"]) for r in rows if not (r["text"] or "").strip()} == {b""}
    one = bpe.decode(bpe.encode(edge, coder), coder).where("doc_id = 8").select("ids", "decoded", bpe.unpack(bpe.F.col("ids")).alias("u")).first()
    assert one["u"] == LIBRARY.encode("same text here once more", add_special_tokens=False).ids == ids(one["ids"])
    assert bpe.round_trip(empty, coder).count() == 0


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_same_counts_as_the_library(text):
    assert COUNTER.text(text) == len(UNIGRAM.encode(text, add_special_tokens=False).ids)


def test_counts_of_documents(spark, small, docs, edge, empty):
    got = {r["doc_id"]: r["n_tokens"] for r in registry.op9_tokencount(spark, small).collect()}
    assert got == {r["doc_id"]: len(UNIGRAM.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = tokencount.count_tokens(edge, path).collect()
    assert all(r["n_tokens"] == len(UNIGRAM.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows) and len(rows) == 11
    assert tokencount.count_tokens(empty, path).count() == 0


def test_workers_remember_few_words(spark):
    """What a worker holds is bounded: words it met lately, and no parsed vocabulary file beside its tables."""
    own = bpe.WordBpe(bpe.load(PATH))
    for i in range(60_000):
        own.plain(f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")))
    assert len(own.known) + len(own.known.old) <= 50_000
    assert isinstance(bpe.Coder(spark, PATH).shared.value, bytes)


def test_new_words_are_scanned_side_by_side(monkeypatch):
    """A batch scans its different words at once, not one by one (F1), with the library's ids at every length and place of the tables' ends."""
    random = Random(5)
    letters = ["e", "t", "a", "th", "ing", "er", "s", "é", "ñ", "ß", "ж", "日", "\0", "\x1c", "'", "'s", ".", "7", "Σ", "İ"]
    texts = [" ".join("".join(random.choices(letters, k=random.randint(1, 24))) for _ in range(300)) for _ in range(40)]
    texts += [None, "", " ", "x<|endoftext|>Y thes<|startoftext|>", "ing" * 21 + " " + "ing" * 22, "a" * 64 + " " + "a" * 65, "é" * 32 + " " + "é" * 33, "th" * 300]
    alone, own = [], bpe.WordBpe(bpe.load(PATH))
    scan = own.word
    monkeypatch.setattr(own, "word", lambda word: alone.append(word) or scan(word))
    assert [ids(e) for e in own.encode_all(texts)] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len([w for w in alone if len(w.encode()) <= 64]) < 4 * bpe.FEW
    assert all(len(w) <= 64 for w in [*own.known.last, *own.known.old])
    again = own.encode_all(texts[::-1])
    assert again[::-1] == own.encode_all(texts)
    words = [random.choice(string.ascii_lowercase) * random.randint(1, 64) + "".join(random.choices(string.ascii_lowercase, k=4)) for _ in range(500)]
    raw = [w[-64:].encode() for w in words]
    assert [ids(e) for e in own._scan_all(raw, 64)] == [scan(r.decode()) for r in raw]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127)) | st.text("'strevmlld 1_\x1c\x1f\x7f"))
def test_same_words_in_ascii(text):
    assert OWN.ascii_words(text.lower()) == OWN.words(text.lower())
