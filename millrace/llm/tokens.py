"""Token ids of whole texts, at the speed that repeated words allow."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np

#: Characters that one library or the other takes for white space, beside blank, tab and line ends.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")
#: Western letters, then ASCII marks without apostrophe: the tokenizer parts the two, and keeps each apart from neighbours.
PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;=?@\[\]^_`{}~]*)")
#: What the tokenizer surely takes as one run: its last id, and no other, is one that ends words.
ONE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]+")
#: A text, in lower case, that consists of such runs and white space alone.
PURE = re.compile(r"[a-zß-öø-ÿ0-9 \t\n\r!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*")
#: Where a stop or comma may be one run with a mark before it; elsewhere it may be parted from its word, so that the two are not kept as one more word.
MARKS = re.compile(r"[!-/:-@\[-`{-~][.,]")
#: Bytes that a task keeps of words, of words of pure texts, and of runs, with their ids, about; beyond that it starts afresh. Longer texts are never kept.
KEPT_WORDS, KEPT_PURE, KEPT_RUNS, LONGEST = 16 << 20, 96 << 20, 40 << 20, 256
#: Bytes of an entry beside the text and its ids: two objects' heads and a place in the table.
HEAD = 190

#: Characters of a text that are split at once; longer texts are cut where white space begins.
PART = 1 << 20
CUT = re.compile(r"(?<=[^ \t\n\r])[ \t\n\r]")

Encode = Callable[[list[str]], list[bytes]]


def parts_of(text: str) -> list[str]:
    """``text`` in parts of some PART characters, each but the first beginning with white space after a word."""
    out, at = [], 0
    while at + PART < len(text):
        found = CUT.search(text, at + PART)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Kept(dict):
    """text -> its ids as little-endian uint32 bytes, bounded in bytes; new texts are encoded together.

    All texts of the last ``learn`` are there until the next, long ones too.
    """

    def __init__(self, encode: Encode, most: int):
        super().__init__()
        self.encode, self.most, self.bytes, self.long = encode, most, 0, []

    def learn(self, texts: set[str]) -> None:
        for t in self.long:
            self.bytes -= HEAD + len(t) + len(self.pop(t, b""))
        self.long = []
        if self.bytes > self.most:
            self.clear()
            self.bytes = 0
        new = list(texts.difference(self))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found = self.encode(part)
            self.update(zip(part, found))
            self.long += [t for t in part if len(t) > LONGEST]
            self.bytes += sum(map(len, part)) + sum(map(len, found)) + HEAD * len(part)

    def forget(self) -> None:
        """Gives its memory back, at the end of a task."""
        self.clear()
        self.bytes, self.long = 0, []


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> Encode:
    """Ids of whole texts by a ``tokenizers`` file that drops white space, without special tokens.

    Such a tokenizer never joins what ASCII white space parts, so a text's ids are those
    of its words one after the other; and it parts letters from marks, so
    "Word," has the ids of "word" and those of ",". Each of these is encoded once.
    A worker keeps the tokenizer; ``forget()`` of what is returned drops the words kept.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def one_by_one(words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pure_by_ends(words: list[str]) -> list[bytes]:
        """Words of pure texts are encoded as one text, and told apart by how many runs each has."""
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ends[ids]) + 1
        runs = list(accumulate([1 if w.isalpha() else len(ONE.findall(w)) for w in words]))
        if not words or runs[-1] != len(at):
            return one_by_one(words)
        raw, at = ids.tobytes(), (4 * at[np.asarray(runs) - 1]).tolist()
        return [raw[a:b] for a, b in pairwise([0, *at])]

    def by_ends(words: list[str]) -> list[bytes]:
        """Single runs are encoded as one text and told apart by the ids that end words; others one by one."""
        single = [w for w in words if ONE.fullmatch(w)]
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(single)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ends[ids]) + 1
        if len(at) != len(single):
            return one_by_one(words)
        raw, at = ids.tobytes(), (4 * at).tolist()
        found = dict(zip(single, [raw[a:b] for a, b in zip([0, *at], at)]))
        other = [w for w in words if w not in found]
        found.update(zip(other, one_by_one(other)))
        return [found[w] for w in words]

    runs = Kept(by_ends, KEPT_RUNS)

    def by_runs(words: list[str]) -> list[bytes]:
        found = list(map(PLAIN.fullmatch, words))
        heads = [w if m is None else m[1].lower() for w, m in zip(words, found)]
        tails = ["" if m is None else m[2] for m in found]
        runs.learn({*heads, *tails})
        return [runs[a] + runs[b] if b else runs[a] for a, b in zip(heads, tails)]

    known, pure_words = Kept(by_runs, KEPT_WORDS), Kept(pure_by_ends, KEPT_PURE)

    def encode(texts: list[str]) -> list[bytes]:
        if any(len(t) > PART for t in texts):
            return [b"".join(plainly([p])[0] for p in parts_of(t)) if len(t) > PART else plainly([t])[0] for t in texts]
        return plainly(texts)

    def plainly(texts: list[str]) -> list[bytes]:
        lower = [t.lower() for t in texts]
        pure = [(t if MARKS.search(t) else t.replace(". ", " . ").replace(".\n", " .\n").replace(", ", " , ")).split() if PURE.fullmatch(t) else None for t in lower]
        pure_words.learn(set().union(*[p for p in pure if p]))
        out = [b"".join(map(pure_words.__getitem__, p)) if p is not None else None for p in pure]
        rest = [i for i, p in enumerate(pure) if p is None]
        split = [texts[i].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for i in rest]
        known.learn(set().union(*split))
        for i, words in zip(rest, split):
            out[i] = b"".join(map(known.__getitem__, words))
        return out

    encode.forget = lambda: (runs.forget(), known.forget(), pure_words.forget())
    return encode


@lru_cache(maxsize=1)
def rank_tokenizer(path: str, pattern: str) -> Encode:
    """Ids of whole texts by a ``tiktoken`` rank file; decoding them gives the text again.

    Texts go to the tokenizer as they are: that costs less than to look up each word among those met before. The pattern never matches across the end of a
    word, so long texts are cut there; those with rarer white space are encoded whole. Nothing is kept; ``forget()`` is there for callers of either tokenizer.
    """
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    one = lambda text: np.asarray(encoding.encode_ordinary(text), "<u4").tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        return [one(t) if len(t) <= PART or ODD.search(t) else b"".join(map(one, parts_of(t))) for t in texts]

    encode.forget = lambda: None
    return encode
