"""Operator 8: line dedup by a log-template tree."""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import col, cut, discard, documents, numbered, shared_folder, slices, stored, unused
from millrace.llm.graph import components

#: Leading tokens that lead to a leaf, and share of the tokens after them that a template holds fixed at least.
DEPTH, SIMILAR = 3, 0.8
#: Bytes of a token's hash in a signature, which holds the tokens after the leading ones.
WIDE = 3
#: Documents in which a template recurs before it is dropped; those that suffice for lines of LONG tokens or more.
MIN_DOCS, LONG, MIN_LONG = 3, 50, 2
#: Lines that are held against each other in one place, and their signatures' bytes; more are dealt out first.
TOGETHER, TOGETHER_BYTES = 1024, 16 << 20
#: Lines of a larger group in one block.
BLOCK = 4096
FIELD = b"<*>"
#: Distinct lines whose signatures a task has given; beyond that it starts afresh.
GIVEN = 200_000
#: Bytes of tokens that are hashed at once; tokens above LONGEST bytes are hashed one by one.
STEP, LONGEST = 1 << 16, 64
#: White space that parts tokens: that of ``str.split``, by the bytes of UTF-8. A line feed parts lines.
BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
WIDE_BLANK = frozenset(c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace())
#: A number for each byte, and powers of an odd base: a token's hash is the sum of its bytes' numbers, each times its place's power.
NUMBERS = np.random.default_rng(2).integers(0, 1 << 64, 256, np.uint64)
POWERS = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))


def blanks(raw: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 ``raw`` is white space, or part of it."""
    out = BLANK[raw]
    for lead in {c[0] for c in WIDE_BLANK} if len(raw) and raw.max() >= 128 else ():
        some = [c for c in WIDE_BLANK if c[0] == lead]
        size = len(some[0])  # UTF-8 tells it by the first byte
        at = np.flatnonzero(raw[: max(0, len(raw) - size + 1)] == lead)
        code = sum(raw[at + i].astype(np.uint32) << np.uint32(8 * i) for i in range(size))
        at = at[np.isin(code, [int.from_bytes(c, "little") for c in some])]
        for i in range(size):
            out[at + i] = True
    return out


def token_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of hash for each token of ``raw``. Tokens of up to LONGEST bytes that differ in one byte never have the same."""
    from xxhash import xxh64_intdigest

    size, out = end - start, np.zeros(len(start), np.uint64)
    short = np.flatnonzero(size <= LONGEST)
    first = np.cumsum(size[short]) - size[short]  # where a token begins if the short ones are laid end to end
    for some in np.split(short, np.searchsorted(first, np.arange(STEP, int(size[short].sum()), STEP))):
        if len(some):
            many = size[some]
            begin = np.cumsum(many) - many
            place = np.arange(int(many.sum())) - np.repeat(begin, many)
            out[some] = np.add.reduceat(NUMBERS[raw[np.repeat(start[some], many) + place]] * POWERS[place], begin)
    for i in np.flatnonzero(size > LONGEST).tolist():
        out[i] = xxh64_intdigest(raw[start[i] : end[i]].tobytes(), 2)
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(31)


@lru_cache(maxsize=1)
def field_hash() -> np.uint64:
    return token_hashes(np.frombuffer(FIELD, np.uint8), np.array([0]), np.array([len(FIELD)]))[0]


def parsed(texts: pa.Array) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """(row, nth, first, hashes) of the lines of ``texts`` that are not blank, in order: whose they are, their places there, their first tokens' places in hashes.

    hashes has 64 bits for each token; all tokens with a digit are one variable field. first has one number more: where the last line's tokens end.
    Texts are read as bytes, all at once; none is decoded.
    """
    if not len(texts):
        return [], [], [0], np.empty(0, np.uint64)
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(raw) + 1, bool)
    np.logical_not(blanks(raw), out=inside[:-1])
    edge = inside.copy()  # where a token begins: inside, and blank or another text before
    edge[1:] &= ~inside[:-1]
    edge[offsets] = inside[offsets]
    stop = inside[:-1] & (edge[1:] | ~inside[1:])
    start, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
    if not len(start):
        return [], [], [0], np.empty(0, np.uint64)
    hashes = token_hashes(raw, start, end)
    digits = np.flatnonzero((raw >= 48) & (raw <= 57))
    hashes[np.searchsorted(digits, start) < np.searchsorted(digits, end)] = field_hash()
    feeds = np.flatnonzero(raw == 10)
    row = np.searchsorted(offsets, start, "right") - 1
    nth = np.searchsorted(feeds, start) - np.searchsorted(feeds, offsets)[row]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (nth[1:] != nth[:-1])]))
    return row[first].tolist(), nth[first].tolist(), [*first.tolist(), len(start)], hashes


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_key(raw: bytes) -> int:
    """What tells generalised lines apart: a hash of the hashes of their tokens."""
    from xxhash import xxh64_intdigest

    return signed(xxh64_intdigest(raw, 1))


def codes(signature: bytes) -> np.ndarray:
    """A number for each token of a signature."""
    parts = np.frombuffer(signature, np.uint8).reshape(-1, WIDE).astype(np.uint32)
    return parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16


def line_rows(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, line, nth, signature): a row for each different generalised line of each row; blank lines have none.

    A leaf is the token count and the first ``depth`` tokens; nth is the line's first place in its text. Of the rows of a line, one a task, or little more, has
    its signature, three bytes for each token after the leading ones; it is null in the others.
    """
    names = ["doc_id", "leaf", "line", "nth", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        given: set = set()
        for batch in batches:
            for part in slices(batch, 1):
                docs, out, own, last = part.column(0).to_pylist(), ([], [], [], [], []), set(), -1
                rows, places, first, hashes = parsed(part.column(1))
                raw, short = hashes.tobytes(), hashes.view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()
                for row, nth, begin, end in zip(rows, places, first, first[1:]):
                    if row != last:
                        own, last = set(), row
                    key = line_key(raw[8 * begin : 8 * end])
                    if key in own:
                        continue
                    own.add(key)
                    leaf = signed(xxh64_intdigest(raw[8 * begin : 8 * min(begin + depth, end)], 8 * (end - begin)))
                    rest = None
                    if key not in given:
                        if len(given) >= GIVEN:
                            given.clear()
                        given.add(key)
                        rest = short[WIDE * min(begin + depth, end) : WIDE * end]
                    out[0].append(docs[row]), out[1].append(leaf), out[2].append(key), out[3].append(nth), out[4].append(rest)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, leaf long, line long, nth long, signature binary")


def allowed(size: int, similar: float) -> int:
    """Tokens, of ``size`` after the leading ones, in which like lines may differ."""
    return size - math.ceil(similar * size - 1e-9)


def met(lines: list[dict], similar: float) -> list[tuple[int, int]]:
    """Links (a, b) that join what all like pairs of a few lines (line, signature) of one leaf join; a is the lesser."""
    rows = sorted(lines, key=lambda r: r["line"])
    size = len(rows[0]["signature"])
    found = np.array([codes(r["signature"]) if len(r["signature"]) == size else np.zeros(size // WIDE, np.uint32) for r in rows])
    root, least = list(range(len(rows))), size // WIDE - allowed(size // WIDE, similar)
    for i in range(len(rows) - 1):
        for j in (np.flatnonzero((found[i + 1 :] == found[i]).sum(1) >= least) + i + 1).tolist():
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
    return [(rows[root[i]]["line"], r["line"]) for i, r in enumerate(rows) if root[i] != i]


def links_of_few(few: DataFrame, similar: float) -> DataFrame:
    """(a, b) for groups (key, line, signature) of at most TOGETHER lines each, one row of lists a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for group in batch.column(0) for pair in met(group.as_py(), similar)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return few.groupBy("key").agg(F.collect_list(F.struct("line", "signature")).alias("lines")).select("lines").mapInArrow(run, "a long, b long")


def against_head(many: DataFrame, similar: float) -> DataFrame:
    """(key, line, n, signature, head, like, places) of larger groups: whether a line is like the group's most recurrent, and where it differs."""
    heads = cut(many.groupBy("key").agg(F.min(F.struct(-F.col("n"), "line", "signature")).alias("head")).select(F.col("key").alias("_key"), F.col("head.line").alias("head"), F.col("head.signature").alias("_top")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like, places = [], []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                at = np.flatnonzero(codes(x) != codes(y)) if len(x) == len(y) else np.arange(len(x) // WIDE)
                places.append(at.tolist())
                like.append(len(x) == len(y) and len(at) <= allowed(len(x) // WIDE, similar))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(like, pa.bool_()), pa.array(places, pa.list_(pa.int32()))], ["key", "line", "n", "signature", "head", "like", "places"])

    held = many.join(heads.hint("merge"), F.col("key") == F.col("_key")).select("key", "line", "n", "signature", "head", "_top")
    return held.mapInArrow(run, "key long, line long, n long, signature binary, head long, like boolean, places array<int>")


def against_rest(lines: DataFrame, rest: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between the ``rest`` (key, line, signature, parts) of a group and all its ``lines`` (key, line, signature, root, parts).

    The lines of a group come in ``parts`` blocks; a line of the rest is linked to each root, once a block, that a line like it has.
    """

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        rows, found = block.combine_chunks().to_pylist(), set()
        if rows:
            size = len(rows[0]["signature"])
            whole = [r for r in rows if len(r["signature"]) == size]
            own, roots = np.array([codes(r["signature"]) for r in whole]), np.array([r["root"] for r in whole], np.int64)
            least = size // WIDE - allowed(size // WIDE, similar)
            for line, signature in zip(asked.column("_line").to_pylist(), asked.column("_signature").to_pylist()):
                if len(signature) == size:
                    like = np.unique(roots[(own == codes(signature)).sum(1) >= least])
                    found |= {(min(line, r), max(line, r)) for r in like.tolist() if r != line}
        return pa.table([pa.array([f[i] for f in sorted(found)], pa.int64()) for i in (0, 1)], names=["a", "b"])

    part = F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")
    left = lines.select("key", "line", "signature", "root", part.alias("part"))
    right = rest.select(*[F.col(c).alias(f"_{c}") for c in ("key", "line", "signature")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))
    return left.groupBy("key", "part").cogroup(right.groupBy("_key", "_part")).applyInArrow(run, "a long, b long")


def dealt(open_: DataFrame, similar: float) -> DataFrame:
    """Groups (key, line, n, signature, root, varying) dealt out to smaller ones, in which all like lines still meet.

    ``varying`` are the places where lines of the group differ at all. Like lines differ in at most m of them, so of
    m + 1 blocks of those places one is equal; each block and its content is a new group. If there are
    no more than m such places, all lines are like their head, and nothing is left to find.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for i in range(batch.num_rows):
                key, signature, varying = (batch.column(c)[i].as_py() for c in (0, 3, 5))
                blocks = allowed(len(signature) // WIDE, similar) + 1
                places, own = np.array(sorted(varying), np.int64), codes(signature)
                if len(places) >= blocks:
                    parts = [signed(xxh64_intdigest(own[p].tobytes() + b"%d %d" % (key, n), 3)) for n, p in enumerate(np.array_split(places, blocks))]
                    same = batch.take(pa.array([i] * blocks))
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *same.columns[1:5]], ["key", "line", "n", "signature", "root"])

    return open_.select("key", "line", "n", "signature", "root", "varying").mapInArrow(run, "key long, line long, n long, signature binary, root long")


def links(lines: DataFrame, similar: float = SIMILAR, together: int = TOGETHER) -> DataFrame:
    """(a, b) that join what all like pairs of ``lines`` (leaf, line, n, signature) of one leaf join.

    Small groups are held pair by pair. In a larger group every line is held against the most recurrent. If that leaves few
    lines in other components, these are held against all, in blocks; if many, the lines are dealt out by blocks of the places where they differ, and the new groups, less those
    of a single component, taken likewise, until none is left. No pair is lost however large a leaf is, and no group's pairs are laid out.
    ``lines`` is read more than once: give a written table.
    """
    home = f"{shared_folder(lines.sparkSession)}/links-{uuid.uuid4().hex}"
    now, out, turn = lines.select(F.col("leaf").alias("key"), "line", "n", "signature", F.col("line").alias("root")), None, 0
    while True:
        if turn:
            now = stored(now, f"{home}/{turn}")
        turn += 1
        sizes = now.groupBy("key").agg(F.count("*").alias("_n"), F.sum(F.octet_length("signature")).alias("_bytes"), F.min("root").alias("_low"), F.max("root").alias("_high"))
        few = (F.col("_n") <= together) & (F.col("_bytes") <= TOGETHER_BYTES)
        sizes = cut(sizes.filter("_low != _high").select(F.col("key").alias("_key"), few.alias("_few")))
        sized = now.join(sizes.hint("merge"), F.col("key") == F.col("_key"))
        found = cut(links_of_few(sized.filter("_few").select("key", "line", "signature"), similar))
        out = found if out is None else out.unionAll(found)
        if sizes.filter("not _few").isEmpty():
            discard(lines.sparkSession, home)
            return out
        held = cut(against_head(sized.filter("not _few").select("key", "line", "n", "signature"), similar))
        discard(lines.sparkSession, home)
        out = out.unionAll(held.filter("like and line != head").select(F.least("head", "line").alias("a"), F.greatest("head", "line").alias("b")))
        roots = components(out)
        placed = cut(held.join(roots.hint("merge"), F.col("line") == F.col("node"), "left").select("key", "line", "n", "signature", "head", F.coalesce("root", "line").alias("root")))
        several = placed.groupBy("key").agg(F.count("*").alias("_n"), F.max(F.when(F.col("line") == F.col("head"), F.col("root"))).alias("_main"), F.min("root").alias("_low"), F.max("root").alias("_high"))
        several = cut(several.filter("_low != _high").select(F.col("key").alias("_key"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("parts"), "_main"))
        # lines outside the head's component: where they are few they meet all of the group, and nothing is left to find there
        rest = cut(placed.join(several.hint("merge"), F.col("key") == F.col("_key")).filter("root != _main").select("key", "line", "signature", "parts"))
        few = (F.count("*") <= together) & (F.sum(F.octet_length("signature")) <= TOGETHER_BYTES)
        kinds = cut(rest.groupBy("key").agg(few.alias("_few"), F.first("parts").alias("parts")).select(F.col("key").alias("_key"), "_few", "parts"))
        ready, wide = kinds.filter("_few").select("_key", "parts"), kinds.filter("not _few").select("_key")
        mine = placed.join(ready.hint("merge"), F.col("key") == F.col("_key"))
        asked = rest.join(ready.select("_key").hint("merge"), F.col("key") == F.col("_key"), "left_semi")
        out = out.unionAll(cut(against_rest(mine, asked, similar)))
        if wide.isEmpty():
            return out
        places = held.select("key", F.explode("places").alias("place")).distinct().groupBy("key").agg(F.collect_list("place").alias("varying"))
        wide = cut(wide.join(places.hint("merge"), F.col("_key") == F.col("key")).select("_key", "varying"))
        now = dealt(placed.join(wide.hint("merge"), F.col("key") == F.col("_key")), similar)


def needed(signature: Column, depth: int, min_docs: int, long: int, min_long: int) -> Column:
    """Documents in which a line must recur."""
    return F.when(F.octet_length(signature) >= WIDE * (long - depth), min_long).otherwise(min_docs)


#: What the lines of a component are ordered by: the most recurrent come first, then those that come first in the first document.
ORDER = ("n", "doc", "nth", "line")


def ordered(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (-r["n"], r["doc"] is None, r["doc"] or 0, r["nth"] or 0, r["line"]))


def grown(rows: list[dict], similar: float) -> list[tuple[dict, dict, np.ndarray | None]]:
    """(row, leader, fields) for the lines of a component, in order; fields, for leaders alone, say at which places their templates vary in the end.

    A line joins the first template in which no more tokens than allowed are fields, with those in which it differs from the leader; these become fields
    too. So fields never count as equal, and a template always holds its share of tokens fixed. A line that joins none leads a new one.
    """
    size = len(rows[0]["signature"])
    most, k, leaders = allowed(size // WIDE, similar), 0, []
    heads, fields = np.empty((len(rows), size // WIDE), np.uint32), np.zeros((len(rows), size // WIDE), bool)
    out = []
    for r in ordered(rows):
        if len(r["signature"]) != size:  # of another leaf of the same hash
            out.append((r, r, None))
            continue
        own = codes(r["signature"])
        vary = (heads[:k] != own) | fields[:k]
        at = np.flatnonzero(vary.sum(1) <= most)
        if len(at):
            fields[at[0]] = vary[at[0]]
            out.append((r, leaders[at[0]], None))
        else:
            heads[k], k = own, k + 1
            leaders.append(r)
            out.append((r, r, fields[k - 1]))
    return out


GROWN = "root long, line long, template long, seq long, signature binary, fields binary"


def growing(groups: DataFrame, similar: float) -> DataFrame:
    """GROWN rows for ``groups`` (root, lines), a component each: seq, signature and fields are those of leaders, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, group in zip(batch.column(0), batch.column(1)):
                found = grown(group.as_py(), similar)
                columns = [pa.array([root.as_py()] * len(found), pa.int64()), pa.array([r["line"] for r, _, _ in found], pa.int64()), pa.array([t["line"] for _, t, _ in found], pa.int64())]
                columns += [pa.array([None if f is None else i for i, (_, _, f) in enumerate(found)], pa.int64()), pa.array([None if f is None else r["signature"] for r, _, f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([None if f is None else f.tobytes() for _, _, f in found], pa.binary())], [c.split()[0] for c in GROWN.split(", ")])

    return groups.mapInArrow(run, GROWN)


def joining(rest: DataFrame, leaders: DataFrame, similar: float) -> DataFrame:
    """(line, template) of ``rest`` (root, line, signature, parts, ...), template null where no leader's template takes the line as it is."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        rows, known = block.to_pylist(), sorted(asked.to_pylist(), key=lambda r: r["_seq"])
        heads, fields = np.array([codes(r["_signature"]) for r in known]), np.array([np.frombuffer(r["_fields"], bool) for r in known])
        found = []
        for r in rows:
            own = codes(r["signature"])
            fits = known and len(own) == heads.shape[1]
            at = np.flatnonzero(((heads != own) | fields).sum(1) <= allowed(len(own), similar)) if fits else ()
            found.append(known[at[0]]["_template"] if len(at) else None)
        return pa.table([pa.array([r["line"] for r in rows], pa.int64()), pa.array(found, pa.int64())], names=["line", "template"])

    left = rest.select("root", F.pmod(F.xxhash64("line"), "parts").cast("int").alias("part"), "line", "signature")
    sizes = rest.select(F.col("root").alias("_of"), F.col("parts").alias("_parts")).distinct()
    right = leaders.join(sizes.hint("merge"), F.col("root") == F.col("_of")).select(F.col("root").alias("_root"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), *[F.col(c).alias(f"_{c}") for c in ("seq", "template", "signature", "fields")])
    return left.groupBy("root", "part").cogroup(right.groupBy("_root", "_part")).applyInArrow(run, "line long, template long")


def split(placed: DataFrame, similar: float, together: int) -> DataFrame:
    """(line, template) for ``placed`` (root, line, n, doc, nth, signature), the lines of components, by the templates that grow in each.

    Components of at most ``together`` lines grow theirs in one place. In a larger one the first ``together`` lines do; all others of it that one of these templates
    takes as it is join it, block by block, and those left go on alike, until none is left. Outcomes depend on no order of rows or partitions.
    """
    spark, home, turn = placed.sparkSession, f"{shared_folder(placed.sparkSession)}/split-{uuid.uuid4().hex}", 0
    line = F.struct("line", "n", "doc", "nth", "signature")
    sizes = cut(placed.groupBy("root").agg(F.count("*").alias("_n"), F.sum(F.octet_length("signature")).alias("_bytes")).select(F.col("root").alias("_root"), ((F.col("_n") <= together) & (F.col("_bytes") <= TOGETHER_BYTES)).alias("_few")))
    sized = placed.join(sizes.hint("merge"), F.col("root") == F.col("_root"))
    out = cut(growing(sized.filter("_few").groupBy("root").agg(F.collect_list(line).alias("lines")), similar)).select("line", "template")
    if sizes.filter("not _few").isEmpty():
        return out
    now = stored(sized.filter("not _few").select("root", "line", "n", "doc", "nth", "signature"), f"{home}/0")
    while not now.isEmpty():
        order = Window.partitionBy("root").orderBy(F.desc("n"), F.col("doc").asc_nulls_last(), F.col("nth").asc_nulls_first(), "line")
        most = F.least(F.lit(together), F.greatest(F.lit(1), F.lit(TOGETHER_BYTES) / F.greatest(F.octet_length("signature"), F.lit(1)))).cast("int")
        first = now.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= together).filter(F.col("_nth") <= most)
        made = stored(growing(first.groupBy("root").agg(F.collect_list(line).alias("lines")), similar), f"{home}/{turn}-made")
        out = out.unionAll(made.select("line", "template"))
        rest = now.join(made.select(F.col("line").alias("_line")).hint("merge"), F.col("line") == F.col("_line"), "left_anti")
        counts = stored(rest.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).withColumnRenamed("root", "_root"), f"{home}/{turn}-parts")
        rest = stored(rest.join(counts.hint("merge"), F.col("root") == F.col("_root")).drop("_root"), f"{home}/{turn}-rest")
        told = stored(joining(rest, made.filter("seq is not null"), similar), f"{home}/{turn}-told")
        out = out.unionAll(told.filter("template is not null"))
        left = told.filter("template is null").select(F.col("line").alias("_line"))
        turn += 1
        now = stored(rest.join(left.hint("merge"), F.col("line") == F.col("_line"), "left_semi").select("root", "line", "n", "doc", "nth", "signature"), f"{home}/{turn}")
    out = cut(out)
    discard(spark, home)
    return out


def templates(rows: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, long: int = LONG, min_long: int = MIN_LONG, together: int = TOGETHER) -> DataFrame:
    """(line, template, need) for the lines of ``rows`` whose template can recur in as many documents as it must.

    Lines of a leaf that can share a template at all are found first, as components of likeness; within these templates grow (``grown``). A template is
    named by its leader. Signatures hold 24 bits of each token's hash, so that two tokens that differ count as equal with odds of 1 in 17 million.
    """
    spark, home = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/templates-{uuid.uuid4().hex}"
    # the binary max() aggregates by sorting; it sees a line's signature once a task
    place = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "nth")))
    lines = stored(rows.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.max("signature").alias("signature"), place.alias("place")), f"{home}/lines")
    need = needed(F.col("signature"), depth, min_docs, long, min_long)
    busy = lines.groupBy("leaf").agg(F.sum("n").alias("_n"), F.count("*").alias("_lines"), F.min(need).alias("_need")).filter("_n >= _need")
    busy = cut(busy.select(F.col("leaf").alias("_leaf"), "_lines"))
    left = lines.join(busy.hint("merge"), F.col("leaf") == F.col("_leaf")).select("leaf", "line", "n", "signature", "place", need.alias("need"), "_lines")
    left = stored(left, f"{home}/left")
    discard(spark, f"{home}/lines")
    roots = components(links(left.filter("_lines > 1"), similar, together))
    held = left.join(roots.hint("merge"), F.col("line") == F.col("node"), "left")
    held = stored(held.select("line", "n", "need", F.when(F.col("root").isNotNull(), F.col("signature")).alias("signature"), F.col("place.doc_id").alias("doc"), F.col("place.nth").alias("nth"), "root"), f"{home}/held")
    discard(spark, f"{home}/left")
    # only components that recur as a whole can hold a template that does
    several = held.filter("root is not null").groupBy("root").agg(F.sum("n").alias("_n"), F.min("need").alias("_need")).filter("_n >= _need")
    several = stored(held.join(cut(several.select(F.col("root").alias("_root"))).hint("merge"), F.col("root") == F.col("_root"), "left_semi"), f"{home}/several")
    named = split(several, similar, together).select(F.col("line").alias("_line"), "template")
    placed = several.join(named.hint("merge"), F.col("line") == F.col("_line")).select("line", "n", "need", "template")
    placed = stored(placed.unionAll(held.filter("root is null").select("line", "n", "need", F.col("line").alias("template"))), f"{home}/placed")
    # written out, so that both sides of the join are plain shuffles, and a template of very many lines can be split
    often = cut(placed.groupBy("template").agg(F.sum("n").alias("_n"), F.min("need").alias("_need")).filter("_n >= _need").select(F.col("template").alias("_t")))
    out = cut(placed.join(often.hint("merge"), F.col("template") == F.col("_t"), "left_semi").select("line", "template", "need"))
    discard(spark, home)
    return out


def recurring(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, long: int = LONG, min_long: int = MIN_LONG, together: int = TOGETHER) -> DataFrame:
    """(doc_id, lines): the generalised lines to drop from each document.

    A template in at least ``min_docs`` different documents, or ``min_long`` if its lines have ``long`` tokens, is dropped
    from all but the one with the smallest doc_id, so its content is kept once.
    """
    spark, home = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    rows = stored(line_rows(docs, depth), home)
    names = templates(rows, depth, similar, min_docs, long, min_long, together).select(F.col("line").alias("_line"), "template", "need")
    seen = rows.filter("doc_id is not null").select("doc_id", "line")
    held = cut(seen.join(names.hint("merge"), F.col("line") == F.col("_line")).select("doc_id", "line", "template", "need"))
    discard(spark, home)
    over = held.select("template", "need", "doc_id").distinct().groupBy("template").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first"), F.min("need").alias("_need"))
    over = cut(over.filter("_n >= _need").select(F.col("template").alias("_t"), "_first"))
    gone = held.join(over.hint("merge"), (F.col("template") == F.col("_t")) & (F.col("doc_id") != F.col("_first")))
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def drop_recurring(docs: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, min_docs: int = MIN_DOCS, long: int = LONG, min_long: int = MIN_LONG, together: int = TOGETHER) -> DataFrame:
    """``docs`` (doc_id, text, ...) without lines of recurring templates, and n_lines and n_dropped.

    Texts are parted at line feeds; a text that loses nothing stays as it is, byte for byte. Blank lines
    are never dropped. Null texts stay null (no lines); rows with the same doc_id are one document and
    lose the same lines; rows with a null doc_id lose none; a text of any length is parsed line by line. Other columns come along under
    any name, but n_lines and n_dropped are replaced. An empty table gives no rows.
    """
    plain = docs.drop("n_lines", "n_dropped")
    kept, doc, gone_lines = plain.columns, unused("_doc", plain), unused("_lines", plain)
    gone = recurring(plain, depth, similar, min_docs, long, min_long, together).select(F.col("doc_id").alias(doc), F.col("lines").alias(gone_lines))
    at_text, names = kept.index("text"), [*(f"c{i}" for i in range(len(kept))), "n_lines", "n_dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at_text):
                texts, changed, lost = part.column(at_text), [], [0] * part.num_rows
                total = pc.fill_null(pc.add(pc.cast(pc.count_substring(texts, "\n"), pa.int64()), 1), 0)
                off = {i: set(lines) for i, lines in enumerate(part.column(len(kept)).to_pylist()) if lines and texts[i].is_valid}
                asked, gone = list(off), defaultdict(set)
                rows, places, first, hashes = parsed(texts.take(pa.array(asked, pa.int64())))
                raw = hashes.tobytes()
                for row, nth, begin, end in zip(rows, places, first, first[1:]):
                    if line_key(raw[8 * begin : 8 * end]) in off[asked[row]]:
                        gone[asked[row]].add(nth)
                for i, nths in gone.items():
                    lost[i] = len(nths)
                    changed.append((i, "\n".join([p for nth, p in enumerate(texts[i].as_py().split("\n")) if nth not in nths])))
                columns = list(part.columns[: len(kept)])
                if changed:  # all other texts pass as they are, never decoded
                    known = dict(changed)
                    columns[at_text] = pc.replace_with_mask(texts, pa.array([i in known for i in range(part.num_rows)]), pa.array(list(known.values()), texts.type))
                yield pa.RecordBatch.from_arrays([*columns, total, pa.array(lost, pa.int64())], names)

    joined = plain.join(gone.hint("merge"), F.col("doc_id") == F.col(doc), "left").select(*map(col, kept), gone_lines)
    safe = numbered(joined)
    fields = [*safe.schema.fields[: len(kept)], StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    return safe.mapInArrow(run, StructType(fields)).toDF(*kept, "n_lines", "n_dropped")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document's lines, how many of them belong to recurring templates and go, and the digest of what is left."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: DuckDB SQL for ``op8_lines``, where no doc_id is null or repeated: each leaf's lines, in order, are folded into its templates.
OP8_SQL = r"""
WITH parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents),
lines AS (SELECT doc_id, nth, part, list_transform(regexp_extract_all(part, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
  lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS line FROM parts),
kinds AS (SELECT line, len(line) AS size, line[1:3] AS start, line[4:] AS rest, count(DISTINCT doc_id) AS n, min(doc_id * 10000000 + nth) AS place FROM lines WHERE len(line) > 0 GROUP BY line),
leaves AS (SELECT list([{'rest': rest, 'fields': list_transform(rest, lambda t: false), 'members': [line]}] ORDER BY n DESC, place) AS held FROM kinds GROUP BY size, start),
grown AS (SELECT list_reduce(held, lambda known, own: CASE
  WHEN coalesce(list_position(list_transform(known, lambda e: len(list_filter(list_zip(e.rest, e.fields, own[1].rest), lambda z: z[2] OR z[1] <> z[3])) <= len(e.rest) - ceil(0.8 * len(e.rest) - 1e-9)), true), 0) = 0 THEN known || own
  ELSE list_transform(known, lambda e, k: CASE
    WHEN k = list_position(list_transform(known, lambda f: len(list_filter(list_zip(f.rest, f.fields, own[1].rest), lambda z: z[2] OR z[1] <> z[3])) <= len(f.rest) - ceil(0.8 * len(f.rest) - 1e-9)), true)
    THEN {'rest': e.rest, 'fields': list_transform(list_zip(e.rest, e.fields, own[1].rest), lambda z: z[2] OR z[1] <> z[3]), 'members': e.members || own[1].members} ELSE e END) END) AS made FROM leaves),
each AS (SELECT unnest(made) AS found FROM grown),
named AS (SELECT found.members[1] AS template, unnest(found.members) AS line FROM each),
often AS (SELECT template, min(doc_id) AS first_doc FROM lines JOIN named USING (line) GROUP BY template
  HAVING count(DISTINCT doc_id) >= CASE WHEN len(template) >= 50 THEN 2 ELSE 3 END),
gone AS (SELECT line, first_doc FROM named JOIN often USING (template)),
told AS (SELECT doc_id, nth, part, coalesce(doc_id <> first_doc, false) AS dropped FROM lines LEFT JOIN gone USING (line)),
left_ AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, string_agg(part, chr(10) ORDER BY nth) FILTER (NOT dropped) AS kept FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN left_ USING (doc_id)
"""
