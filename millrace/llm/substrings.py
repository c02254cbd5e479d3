"""Operator 6: exact substring dedup by longest previous factors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents

LENGTH = 50
#: Bytes of text that one group of documents, and one bucket of anchors, stands for, at least about.
GROUP, BUCKET = 3 << 20, 6 << 20
#: Bytes that are hashed at once.
SLICE = 1 << 19
#: Windows that are sorted at once, but for those of a single anchor.
WINDOWS = 100_000
#: Groups that share an anchor before its windows are dealt out one by one.
HOT = 1024
U = np.uint64
BASE, BASE2, MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9
PLACE = 28


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(MIX)
    x ^= x >> U(29)
    x *= U(BASE)
    return x ^ (x >> U(31))


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` codes from each place on; built by doubling."""
    out, had, now, width = None, 0, codes, 1
    while True:
        if size & width:
            if out is None:
                out = now
            else:
                n = len(now) - had
                out = out[:n] * U(pow(BASE, width, 1 << 64)) + now[had : had + n]
            had += width
        if had == size:
            return mixed(out)
        now = now[:-width] * U(pow(BASE, width, 1 << 64)) + now[width:]
        width *= 2


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on."""
    now, had = values, 1
    while 2 * had <= width:
        now, had = np.minimum(now[:-had], now[had:]), 2 * had
    return now if had == width else np.minimum(now[: len(values) - width + 1], now[width - had :])


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE2 and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE2), ("down", pow(BASE2, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * U(pow(base, len(out), 1 << 64))])
            _powers[name] = out
    return _powers["up"], _powers["down"]


@dataclass
class Runs:
    """Runs of windows that have the same anchor, of a group of documents.

    A window is ``length`` bytes; its anchor is the least hash of its grams of half that
    length, the leftmost of equals. So equal windows have equal anchors at equal offsets.
    """

    doc: np.ndarray  # index in the group
    at: np.ndarray  # first window, in the group's joined bytes
    many: np.ndarray  # windows
    offset: np.ndarray  # of the anchor, from the first window
    anchor: np.ndarray  # hash
    whole: np.ndarray  # hash of all bytes of the run's windows

    def take(self, which: np.ndarray) -> Runs:
        return Runs(*[getattr(self, f)[which] for f in ("doc", "at", "many", "offset", "anchor", "whole")])

    def windows(self) -> Runs:
        """Each window a run of its own, whose hash is its anchor as well."""
        which = np.repeat(np.arange(len(self.at)), self.many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(self.many) - self.many, self.many)
        return Runs(self.doc[which], self.at[which] + nth, np.ones(len(which), np.int64), self.offset[which] * 0, self.anchor[which], self.whole[which])


def hashes_of(joined: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each stretch; done in slices, which stretches may overhang."""
    out = np.empty(len(at), np.uint64)
    most = int(size.max()) if len(size) else 0
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(0, len(joined) + SLICE, SLICE))
    for i, (a, b) in enumerate(zip(edge, edge[1:])):
        if a < b:
            which = order[a:b]
            part = joined[i * SLICE : (i + 1) * SLICE + most].astype(np.uint64) + U(1)
            up, down = powers(len(part) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
            begin = at[which] - i * SLICE
            out[which] = (sums[begin + size[which]] - sums[begin]) * down[begin]
    return out


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, Runs]:
    """The joined bytes, each text's place in them, and all runs, in order of place."""
    gram = length // 2 + 1
    near = length - gram + 1
    joined = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    bases = np.cumsum(sizes) - sizes
    starts, ends = [], []
    for base, size in zip(bases.tolist(), sizes.tolist()):
        for s in range(0, size - length + 1, SLICE):
            starts.append(base + s)
            ends.append(base + min(size, s + SLICE + length - 1))
    found: list[tuple[np.ndarray, ...]] = []
    low = U((1 << PLACE) - 1)
    i = 0
    while i < len(starts):
        j, total = i, 0
        while j < len(starts) and total < SLICE:
            total += ends[j] - starts[j]
            j += 1
        lengths = np.array(ends[i:j]) - np.array(starts[i:j])
        codes = np.concatenate([joined[a:b] for a, b in zip(starts[i:j], ends[i:j])]).astype(np.uint64) + U(1)
        grams = gram_hashes(codes, gram)
        least = window_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), near) & low
        tops = np.cumsum(lengths)
        valid = np.ones(len(codes), bool)
        for e in tops.tolist():
            valid[e - length + 1 : e] = False
        places = np.flatnonzero(valid[: len(least)])
        anchors = least[places].astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1)])
        first, many = places[new], np.diff(np.r_[new, len(places)])
        segment = np.searchsorted(tops, first, "right")
        shift = np.array(starts[i:j]) - (tops - lengths)
        # least hashes are small ones: mixed once more, they fill the buckets evenly
        found.append((first + shift[segment], many, anchors[new] - first, mixed(grams[anchors[new]])))
        i = j
    at, many, offset, anchor = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (list(zip(*found)) or [[]] * 4)]
    at, many, offset, anchor = at.astype(np.int64), many.astype(np.int64), offset.astype(np.int64), anchor.astype(np.uint64)
    whole = mixed(hashes_of(joined, at, many + length - 1) ^ (many.astype(np.uint64) << U(40)) ^ (offset.astype(np.uint64) << U(50)))
    filled = np.flatnonzero(sizes)
    doc = filled[np.searchsorted(bases[filled], at, "right") - 1] if len(at) else at
    return joined, bases, Runs(doc, at, many, offset, anchor, whole)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; buckets are equal ranges of the hash."""
    limits = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(sorted_hashes, limits), len(sorted_hashes)]


def previous_factors(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of suffixes in suffix order: whether an earlier one matches in full length.

    ``order`` is each suffix's position (document), ``same`` whether it matches the suffix before it in full
    length. The longest previous factor of a suffix is its longer match with the nearest suffixes
    before and after it, in suffix order, that have a smaller position: both are found for all by
    jumping from candidate to candidate, and a jump never leaves the stretch of full matches,
    beyond which a factor is too short to count.
    """
    stretch = np.cumsum(~same)

    def smaller(position: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Nearest place before with a smaller position in the same stretch, or -1."""
        n = len(position)
        at = np.arange(n) - 1
        open_ = np.arange(n)
        while len(open_):
            c = at[open_]
            out = (c < 0) | (run[c] != run[open_])
            at[open_[out]] = -1
            open_, c = open_[~out], c[~out]
            more = position[c] >= position[open_]
            open_, c = open_[more], c[more]
            at[open_] = at[c]
        return at

    before = smaller(order, stretch) >= 0
    after = smaller(order[::-1], stretch[::-1])[::-1] >= 0
    return before | after


def flag_earlier(masks: np.ndarray, heads: np.ndarray, doc: np.ndarray, many: np.ndarray, content: np.ndarray, length: int) -> None:
    """Sets the bits of the windows of ``heads`` that have a longest previous factor of full length among them."""
    heads = heads[np.argsort(doc[heads], kind="stable")]
    which = np.repeat(heads, many[heads])
    nth = np.arange(len(which)) - np.repeat(np.cumsum(many[heads]) - many[heads], many[heads])
    rows = np.lib.stride_tricks.sliding_window_view(content, length, axis=1)[which, nth]
    by = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
    rows = rows[by]
    earlier = by[previous_factors(doc[which[by]], np.r_[False, (rows[1:] == rows[:-1]).all(1)])]
    np.bitwise_or.at(masks, which[earlier], np.uint32(1) << nth[earlier].astype(np.uint32))


def told_apart(whole: np.ndarray, anchor: np.ndarray, many: np.ndarray, content: np.ndarray) -> np.ndarray:
    """``whole``, unless unlike contents of one anchor have it alike: then their order among all contents takes its place."""
    order = np.lexsort((whole, anchor))
    a, b = order[:-1], order[1:]
    equal = np.flatnonzero((anchor[a] == anchor[b]) & (whole[a] == whole[b]))
    for at in range(0, len(equal), WINDOWS):
        x, y = a[equal[at : at + WINDOWS]], b[equal[at : at + WINDOWS]]
        if (many[x] != many[y]).any() or (content[x] != content[y]).any():
            rows = np.c_[many.astype(np.uint8), content]
            return np.unique(rows.view(f"S{rows.shape[1]}").ravel(), return_inverse=True)[1].astype(np.uint64)
    return whole


def earlier_windows(anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray, many: np.ndarray, content: np.ndarray, length: int) -> np.ndarray:
    """Per entry a bit for each of its windows that an entry of a smaller document has as well.

    Entries of equal content are settled at once: all but those of the first document are
    copies. The first of each content takes part in the suffix order of all windows of contents
    that share an anchor.
    """
    masks = np.zeros(len(anchor), np.uint32)
    if not len(anchor):
        return masks
    whole = told_apart(whole, anchor, many, content)  # by bytes, not by hash alone
    order = np.lexsort((doc, whole, anchor))
    a, w, d = anchor[order], whole[order], doc[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    full = (np.uint64(1) << many.astype(np.uint64)) - U(1)
    copies = d > d[lead]
    masks[order[copies]] = full[order[copies]].astype(np.uint32)
    heads = order[first]
    apart = anchor[heads]
    shared = np.r_[False, apart[1:] == apart[:-1]] | np.r_[apart[1:] == apart[:-1], False]
    heads = heads[shared]
    # some whole anchors at a time, so that the windows laid out at once are bounded
    ends = np.flatnonzero(np.r_[anchor[heads][1:] != anchor[heads][:-1], True]) + 1 if len(heads) else []
    begin, total = 0, np.cumsum(many[heads])
    for e in ends:
        if total[e - 1] - (total[begin - 1] if begin else 0) >= WINDOWS or e == len(heads):
            flag_earlier(masks, heads[begin:e], doc, many, content, length)
            begin = e
    # what the first of a content has from elsewhere, its equals of the same document have too
    masks[order] |= np.where(d == d[lead], masks[order[lead]], 0).astype(np.uint32)
    return masks


def squeezed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unsqueezed(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def squeezed_hashes(a: np.ndarray) -> bytes:
    """Sorted hashes, byte by byte: all first bytes, all second ones, and so on, of which the first are alike."""
    return squeezed(a.astype(">u8").view(np.uint8).reshape(-1, 8).T)


def unsqueezed_hashes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueezed(raw, "u1").reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def content_hashes(content: np.ndarray, many: np.ndarray, length: int) -> np.ndarray:
    """A hash of each row's first many + length - 1 bytes."""
    size, out = many + length - 1, np.zeros(len(content), np.uint64)
    for j in range(content.shape[1]):
        out += np.where(j < size, content[:, j].astype(np.uint64) + U(1), U(0)) * U(pow(BASE2, j, 1 << 64))
    return mixed(out ^ (many.astype(np.uint64) << U(40)))


@dataclass
class Group:
    """The documents of one group in order of doc_id (null last), and their runs."""

    ids: list[int | None]
    keys: np.ndarray
    texts: list[bytes]
    joined: np.ndarray
    bases: np.ndarray
    runs: Runs
    anchors: np.ndarray  # distinct, sorted

    @classmethod
    def of(cls, table: pa.Table, length: int) -> Group:
        last = (1 << 63) - 1
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: last if r[0] is None else r[0])
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
        joined, bases, runs = runs_of(texts, length)
        ids = [r[0] for r in rows]
        return cls(ids, np.array([last if i is None else i for i in ids], np.int64), texts, joined, bases, runs, np.unique(runs.anchor))

    def entries(self, bits: np.ndarray, hot: np.ndarray, length: int) -> tuple[Runs, np.ndarray, Runs]:
        """Runs whose anchor is shared, those of hot anchors as single windows, and the distinct entries they make.

        Returns the runs, each one's entry, and the entries, each with its first document.
        """
        place = np.searchsorted(self.anchors, self.runs.anchor)
        calm, busy = self.runs.take(bits[place] & ~hot[place]), self.runs.take(bits[place] & hot[place]).windows()
        busy.whole = mixed(hashes_of(self.joined, busy.at, busy.many + length - 1))
        busy.anchor = busy.whole
        runs = Runs(*[np.concatenate([getattr(calm, f), getattr(busy, f)]) for f in ("doc", "at", "many", "offset", "anchor", "whole")])
        order = np.lexsort((self.keys[runs.doc], runs.whole, runs.anchor))
        a, w = runs.anchor[order], runs.whole[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])] if len(order) else np.zeros(0, bool)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(first) - 1
        return runs, entry, runs.take(order[first])


def removed_spans(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP, bucket_bytes: int = BUCKET, hot: int = HOT, keep: bool = False) -> DataFrame:
    """What is left of each whole text of ``docs`` (doc_id, text) without strings that come from earlier documents.

    Texts are UTF-8 bytes. A byte is removed if a string of ``length`` bytes over it also starts in a document with a
    smaller doc_id; so the first copy stays. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin and
    end of each removed run by turns) and, with ``keep``, the bytes kept.

    Suffixes are sorted where they can match at all. Documents are dealt to groups, their windows
    to anchors. First, each anchor that more than one document has is found; then the texts around
    those meet by anchor, and there the suffix order of the windows tells which
    have an earlier full match. Whatever a group has alike goes as one, so that
    what very many documents share is small everywhere; an anchor that very many groups share
    is dealt out window by window. Three passes read the texts, dealt out by one shuffle.

    Null text is empty. Rows with the same doc_id never remove from each other. A null doc_id is later than all
    others. An empty table gives no rows; other columns are ignored. ``length`` is 4 to 60.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # both numbers grow with the root of the input, so that blobs between groups and buckets grow with the input
    side = max(1.0, math.sqrt(total / (64 << 30)))
    groups, buckets = int(total / (group_bytes * side)) + 1, int(total / (bucket_bytes * side)) + 1
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    width = length + length - (length // 2 + 1)

    def blobs(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)

    def anchors(table: pa.Table) -> pa.Table:
        group = Group.of(table, length)
        order = np.argsort(group.runs.anchor, kind="stable")
        keys = group.keys[group.runs.doc][order]
        at = np.searchsorted(group.runs.anchor[order], group.anchors)
        several = (np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at)) if len(at) else np.zeros(0, bool)
        edges, g = bucket_edges(group.anchors, buckets), table.column("g")[0].as_py()
        rows = [(b, g, squeezed_hashes(group.anchors[i:j]), np.packbits(several[i:j]).tobytes()) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
        return blobs(["b", "g", "hashes", "several"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], rows)

    def shared(table: pa.Table) -> pa.Table:
        """For each group of a bucket: which of its anchors another document has, and which are hot."""
        parts = [unsqueezed_hashes(x) for x in table.column("hashes").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table.column("several").to_pylist(), parts)]
        values, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = np.zeros(len(values), bool)
        several[inverse[np.concatenate(flags).astype(bool)]] = True
        bits, busy = (several | (count > 1))[inverse], (count >= hot)[inverse]
        ends = np.cumsum([len(p) for p in parts])
        rows = [(g, b, np.packbits(bits[e - len(p) : e]).tobytes(), np.packbits(busy[e - len(p) : e]).tobytes(), len(p)) for g, b, p, e in zip(table.column("g").to_pylist(), table.column("b").to_pylist(), parts, ends)]
        return blobs(["g", "b", "bits", "busy", "n"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()], rows)

    def told(reply: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray]:
        rows = sorted(reply.select(["b", "bits", "busy", "n"]).to_pylist(), key=lambda r: r["b"])
        rows = [r for r in rows if r["n"] is not None]
        each = [[np.unpackbits(np.frombuffer(r[k], np.uint8), count=r["n"]).astype(bool) for r in rows] for k in ("bits", "busy")]
        return rows, *[np.concatenate(e) if e else np.zeros(0, bool) for e in each]

    def contexts(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows or not reply.num_rows:
            return blobs(*context_schema, [])
        group = Group.of(table, length)
        rows, bits, busy = told(reply)
        _, _, entries = group.entries(bits, busy, length)
        edges, g = bucket_edges(entries.anchor, buckets), table.column("g")[0].as_py()
        said = {r["b"]: r for r in rows}
        padded, out = np.concatenate([group.joined, np.zeros(width, np.uint8)]), []
        for b, (i, j) in enumerate(zip(edges, edges[1:])):
            if b not in said and j == i:
                continue
            part = entries.take(np.arange(i, j))
            content = padded[part.at[:, None] + np.arange(width)]
            content[np.arange(width) >= (part.many + length - 1)[:, None]] = 0
            r = said.get(b, {"bits": b"", "busy": b"", "n": None})
            out.append((b, g, r["bits"], r["busy"], r["n"], squeezed_hashes(part.anchor), squeezed(group.keys[part.doc]), squeezed(part.many.astype(np.uint8)), squeezed(content)))
        return blobs(*context_schema, out)

    binary, long = pa.binary(), pa.int64()
    context_schema = (["b", "g", "bits", "busy", "n", "anchor", "doc", "many", "content"], [long, long, binary, binary, long] + [binary] * 4)

    def factors(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        anchor = [unsqueezed_hashes(r["anchor"]) for r in rows]
        parts = {k: np.concatenate([unsqueezed(r[k], kind) for r in rows]) for k, kind in (("doc", "<i8"), ("many", "u1"), ("content", "u1"))}
        many, content = parts["many"].astype(np.int64), parts["content"].reshape(-1, width)
        masks = earlier_windows(np.concatenate(anchor), content_hashes(content, many, length), parts["doc"], many, content, length)
        ends = np.cumsum([len(a) for a in anchor])
        out = [(r["g"], r["b"], r["bits"], r["busy"], r["n"], squeezed(masks[e - len(a) : e])) for r, a, e in zip(rows, anchor, ends)]
        return blobs(["g", "b", "bits", "busy", "n", "masks"], [long, long, binary, binary, long, binary], out)

    out_names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * keep
    out_kinds = [long, long, long, long, pa.string(), pa.list_(long)] + [binary] * keep

    def remaining(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return blobs(out_names, out_kinds, [])
        group = Group.of(table, length)
        covered = np.zeros(len(group.joined), bool)
        if reply.num_rows:
            _, bits, busy = told(reply)
            runs, entry, entries = group.entries(bits, busy, length)
            masks = [unsqueezed(r["masks"], "<u4") for r in sorted(reply.select(["b", "masks"]).to_pylist(), key=lambda r: r["b"])]
            mask = np.concatenate(masks)[entry] if len(entry) else np.zeros(0, np.uint32)
            # whoever has an entry after its first document here has it from there
            later = group.keys[runs.doc] > group.keys[entries.doc][entry] if len(entry) else np.zeros(0, bool)
            mask = np.where(later, np.uint32(0xFFFFFFFF), mask)
            steps = np.zeros(len(group.joined) + 1, np.int64)
            for nth in range(int(runs.many.max()) if len(runs.many) else 0):
                starts = runs.at[(runs.many > nth) & ((mask >> np.uint32(nth)) & np.uint32(1)).astype(bool)] + nth
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + length, -1)
            covered = np.cumsum(steps[:-1]) > 0
        out = []
        for doc, text_, base in zip(group.ids, group.texts, group.bases.tolist()):
            gone = covered[base : base + len(text_)]
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = np.frombuffer(text_, np.uint8)[~gone].tobytes() if len(turns) else text_
            row = (doc, len(text_), int(gone.sum()), len(turns) // 2, hashlib.sha256(kept).hexdigest(), turns)
            out.append((*row, kept) if keep else row)
        return blobs(out_names, out_kinds, out)

    sent = dealt.groupBy("g").applyInArrow(anchors, "b long, g long, hashes binary, several binary")
    replies = sent.groupBy("b").applyInArrow(shared, "g long, b long, bits binary, busy binary, n long")
    kind = "b long, g long, bits binary, busy binary, n long, anchor binary, doc binary, many binary, content binary"
    around = dealt.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(contexts, kind)
    answers = around.groupBy("b").applyInArrow(factors, "g long, b long, bits binary, busy binary, n long, masks binary")
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(remaining, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept binary" * keep)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each whole document without 50-byte strings that start in one with a smaller doc_id."""
    return removed_spans(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: DuckDB SQL for ``op6_substrings``, where no doc_id is null or repeated. Bytes are pairs of hex digits; places count from 1; long texts are cut in overlapping parts of 549 bytes.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, base, substr(h, 2 * base + 1, 1098) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS base FROM d)),
w AS (SELECT doc_id, base + pos AS pos, substr(c, 2 * pos - 1, 100) AS string FROM (SELECT *, unnest(range(1, length(c) // 2 - 48)) AS pos FROM c WHERE length(c) >= 100)),
s AS (SELECT string, min(doc_id) AS least FROM w GROUP BY string HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, pos, least FROM w JOIN s USING (string)),
hit AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM g WHERE least < doc_id),
part AS (SELECT doc_id, pos, sum(CASE WHEN pos <= prior + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hit),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM part GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM runs UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id),
left_ AS (SELECT doc_id, string_agg(substr(h, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
