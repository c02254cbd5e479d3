from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bins, packing, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = ["a b c  d", "it's  '  s\x1cx \x1f y", "x́ ́e <|endoftext|>q", "", "  ", "A\n\n\nb\t\rc\x0bd\x0ce", "É é ① ﬁ 你好 ΣΑΣ", "don 't <|startoftext|> end", "x  y z\u0085 q", "word,word; (Word)? 12,3"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(HARD), st.text(max_size=40)), min_size=1, max_size=5))
def test_word_ids_are_the_tokenizers(texts):
    encode, plain = tokens.word_tokenizer(WORDS), Tokenizer.from_file(WORDS)
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.sampled_from(HARD), st.text(max_size=60)))
def test_rank_ids_are_tiktokens(text):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = test_rank_ids_are_tiktokens.__dict__.setdefault("plain", tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    ids = np.frombuffer(tokens.rank_tokenizer(RANKS, public_tokenizers.PATTERN)([text])[0], "<u4").tolist()
    assert ids == plain.encode_ordinary(text) and plain.decode(ids) == text


def test_ids_of_sliced_texts(monkeypatch, texts):
    some = ["".join(f" {x}" for x in HARD), *list(texts.values())[:6]]
    words, ranks = tokens.word_tokenizer(WORDS), tokens.rank_tokenizer(RANKS, public_tokenizers.PATTERN)
    want = words(some), ranks(some)
    monkeypatch.setattr(tokens, "PART", 9)
    assert (words(some), ranks(some)) == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    packs = packing.shortest_pack_first(histogram, 64)
    held = Counter()
    for count, pattern in packs:
        assert sum(length * times for length, times in pattern) <= 64
        for length, times in pattern:
            held[length] += count * times
    assert held == Counter(histogram)
    total = sum(k * v for k, v in histogram.items())
    assert sum(c for c, _ in packs) * 64 <= 2 * total + 64


def check(rows, texts):
    """Pieces, ids and places of packed rows against the tokenizer itself."""
    plain = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WIDTH
    return sum(r["length"] for r in rows) / (len(by_sequence) * packing.WIDTH)


def test_packs_whole_documents(small, texts):
    assert check(packing.pack_documents(small, WORDS).collect(), texts) > 0.97


def test_pack_odd_rows(odd, none):
    rows = packing.pack_documents(odd, WORDS).collect()
    assert len({r["sequence_id"] for r in rows}) == max(r["sequence_id"] for r in rows) + 1
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    assert packing.pack_documents(none, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=120))
def test_best_fit_decreasing(lengths):
    got = bins.best_fit_decreasing(np.array(lengths), 32)
    rooms, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b, room in enumerate(rooms) if room >= lengths[i]]
        b = min(fits, key=lambda b: rooms[b]) if fits else len(rooms)
        if not fits:
            rooms.append(32)
        rooms[b] -= lengths[i]
        want[i] = b
    used = Counter()
    for i, b in enumerate(got):
        used[b] += lengths[i]
    assert max(used.values()) <= 32 and sorted(used.values()) == sorted(32 - r for r in rooms)


def test_matrices_round_trip(small, odd, none, texts):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = {}
    for r in bins.pack_matrices(small, RANKS, public_tokenizers.PATTERN).collect():
        ids, places = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert len(ids) == len(places) == bins.WIDTH and r["cu_seqlens"][0] == 0
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert (places[a:b] == np.arange(b - a)).all()
            parts.setdefault(doc, {})[start] = ids[a:b]
        assert (ids[r["cu_seqlens"][-1] :] == bins.PAD).all()
    for doc, text in texts.items():
        got = [i for _, p in sorted(parts.get(doc, {}).items()) for i in p.tolist()]
        assert plain.decode(got) == (text or "")
    rows = bins.pack_matrices(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sum(d == 1 for r in rows for d in r["doc_ids"]) == 2
    assert bins.pack_matrices(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_ids_come_along(small, odd):
    for kind in ("<u2", "<u4"):
        for r in packing.pack_documents(small.unionByName(odd.select(*small.columns)), WORDS, keep_ids=kind).collect():
            ids = np.frombuffer(r["ids"], kind).astype("<u4")
            assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_rank_tokenizer_keeps_no_words(monkeypatch):
    monkeypatch.setattr(tokens, "Kept", None)  # a look-up of each word costs more than to encode it
    encode = tokens.rank_tokenizer.__wrapped__(RANKS, public_tokenizers.PATTERN)
    assert [len(x) > 0 for x in encode(["", "a few words\n of text "])] == [False, True]


def test_stops_and_commas_beside_marks_and_words_kept_apart():
    encode, plain = tokens.word_tokenizer(WORDS), Tokenizer.from_file(WORDS)
    draw = random.Random(8)
    parts = ["the", "Éau", "x9", "12", ".", ",", "..", "...", ",.", "!", "-", "\\", "`", "~", " ", " ", "\n", "\t", "\r", "ß", "thendingle"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(400)] + ["", " . ", "a.. b", "a , b., c", "one, two. three.\nfour."]
    for text, raw in zip(texts, encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_a_word_before_a_stop_is_kept_once():
    encode, words = tokens.word_tokenizer.__wrapped__(WORDS), []
    learn = tokens.Kept.learn
    try:
        tokens.Kept.learn = lambda self, texts: (words.append(texts), learn(self, texts))[1]
        encode(["one, two. one two one"])
    finally:
        tokens.Kept.learn = learn
    assert {"one", "two", ",", "."} in words and not any("one," in w for w in words)
    assert not any(x and x <= {"one", "two"} for x in words)  # no second table of the same words
