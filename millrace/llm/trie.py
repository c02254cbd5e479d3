"""Operator 12: the trie of conversation prefixes, built as a burst trie."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, shared_folder, slices, stored

#: Turns, of different sequences, that one container may hold; larger ones burst.
CONTAINER = 20_000
#: Hex digits of a turn's id.
DIGITS = 32
#: Conversations of one hundred lend each other their first turns, 0 to 5 of them.
SPAN, LENT = 100, 6
#: Nodes in one batch.
BATCH = 10_000
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE_TYPE = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (id, size) of their role and text. Texts stay where they are."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn_id = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"), role.alias("role"), turn_id.alias("id"), F.length(text).cast("long").alias("size"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("turn"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): conversation c with its first h turns, h = crc32(c) % 6, replaced by those of conversation c - c % 100, if that is there."""
    own = cut(turn_lists(conversations))
    base = F.col("conv_id") - F.col("conv_id") % SPAN
    lent = own.filter(F.col("conv_id") % SPAN == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, LENT - 1).alias("_first"))
    first = F.coalesce(F.slice("_first", 1, F.col("h")), F.slice("turns", 1, 0))
    both = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % LENT).cast("int")).join(lent.hint("merge"), base == F.col("_base"), "left")
    return both.select("conv_id", F.concat(first, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def sequences(lists: DataFrame, home: str) -> DataFrame:
    """(conv_id, n, ends, ids, sizes): a row for each different sequence of turns: the smallest of its conversations, how many they are, and the digest of their ids.

    Equal sequences meet by a hash of theirs and in order of conv_id, so that one task reads their ids one by one, however many they are.
    """
    rows = lists.select("conv_id", F.array_join(F.transform("turns", lambda t: t["id"]), "").alias("ids"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = stored(rows, f"{home}/rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[str, int]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["conv_id", "n", "ends"])

        out: list[tuple] = []
        for _, group in groupby(each(), lambda x: x[0]):
            digest, first, n = hashlib.sha256(), None, 0
            for _, conv in group:
                digest.update(b"%d" % conv if first is None else b",%d" % conv)
                first, n = conv if first is None else first, n + 1
            out.append((first, n, digest.hexdigest()))
            if len(out) >= BATCH:
                yield done()
                out = []
        yield done()

    sorted_ = rows.select(F.md5("ids").alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    kept = stored(sorted_.mapInArrow(run, "conv_id long, n long, ends string").withColumnRenamed("conv_id", "_conv"), f"{home}/kept")
    return rows.join(kept.hint("merge"), F.col("conv_id") == F.col("_conv")).select("conv_id", "n", "ends", "ids", "sizes")


def common(lo: str, hi: str) -> int:
    """Turns with which two sequences of ids, and all between them, begin."""
    n, at = min(len(lo), len(hi)) // DIGITS, 0
    step = n
    while step:  # by halves: a long prefix is compared as a whole
        if lo[at * DIGITS : (at + step) * DIGITS] == hi[at * DIGITS : (at + step) * DIGITS]:
            at += step
            step = min(step, n - at)
        else:
            step //= 2
    return at


def burst(over: DataFrame) -> DataFrame:
    """(box, up, depth, size, parent, conv_id, n, common, chain): a row for each container that bursts.

    ``common`` turns follow its head in all its sequences, ``chain`` are their sizes: these are nodes of the same conversations, and below the last it branches by next turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["common"] = common(r["lo"]["ids"], r.pop("hi"))
                r["chain"] = r.pop("lo")["sizes"][: r["common"]]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string() if c in ("box", "up") else pa.list_(pa.int64()) if c == "chain" else pa.int64()) for c in ("box", "up", "depth", "size", "parent", "conv_id", "n", "common", "chain")]))

    found = over.groupBy("box").agg(
        *[F.first(c).alias(c) for c in ("up", "depth", "size", "parent")], F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi")
    )
    return found.mapInArrow(run, "box string, up string, depth long, size long, parent long, conv_id long, n long, common long, chain array<long>")


def swept(ready: DataFrame) -> DataFrame:
    """Nodes, with box and up, of containers that need not burst: each is sorted, and its sequences are swept in order. Heads are marked."""

    def nodes(rows: list[dict]) -> dict[str, list]:
        top, depth = rows[0], rows[0]["depth"]
        conv, n, parent, deep, size, ends = [top["conv_id"]], [0], [-1], [depth], [top["size"]], [NOBODY]
        path, before = [0], ""
        for r in rows:
            same = common(before, r["ids"])
            del path[same + 1 :]
            for k in range(same, len(r["sizes"])):
                parent.append(path[-1]), deep.append(depth + k + 1), size.append(r["sizes"][k])
                conv.append(r["conv_id"]), n.append(0), ends.append(NOBODY)
                path.append(len(parent) - 1)
            for at in path:
                n[at] += r["n"]
                conv[at] = min(conv[at], r["conv_id"])
            ends[path[-1]], before = r["ends"], r["ids"]
        children, leaves, saved = [0] * len(n), [0] * len(n), [(x - 1) * y for x, y in zip(n, size)]
        for at in range(len(n) - 1, -1, -1):  # a node comes after its parent
            leaves[at] = leaves[at] or 1
            if at:
                children[parent[at]] += 1
                leaves[parent[at]] += leaves[at]
                saved[parent[at]] += saved[at]
        above = [top["parent"], *(conv[p] for p in parent[1:])]
        return dict(zip(NODE, (conv, deep, above, n, children, leaves, saved, ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for batch in batches for part in slices(batch, at_ids) for r in part.to_pylist())
        for box, group in groupby(each, lambda r: r["box"]):
            rows = list(group)
            found = nodes(rows)
            for at in range(0, len(found["n_convs"]), BATCH):
                part = {c: x[at : at + BATCH] for c, x in found.items()}
                many = len(part["n_convs"])
                columns = [pa.array(part[c], pa.string() if c == "ends_sha256" else pa.int64()) for c in NODE]
                boxes = [pa.array([x] * many, pa.string()) for x in (box, rows[0]["up"])]
                yield pa.RecordBatch.from_arrays([*boxes, pa.array([not at and not i for i in range(many)]), *columns], ["box", "up", "head", *NODE])

    at_ids = ready.columns.index("ids")
    dealt = ready.repartition("box").sortWithinPartitions("box", "ids")
    return dealt.mapInArrow(run, f"box string, up string, head boolean, {NODE_TYPE}")


def chains(met: DataFrame) -> DataFrame:
    """Nodes of containers that burst (those of ``burst``, with ended, kids, leaves, saved): the head, and a node for each common turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array([r["size"], *r["chain"]], np.int64)
                saved = np.cumsum(((r["n"] - 1) * sizes)[::-1])[::-1] + r["saved"]
                many = len(sizes)
                columns = [
                    pa.array(np.full(many, r["conv_id"])), pa.array(r["depth"] + np.arange(many)), pa.array([r["parent"], *[r["conv_id"]] * (many - 1)], pa.int64()), pa.array(np.full(many, r["n"])),
                    pa.array([*[1] * (many - 1), r["kids"]], pa.int64()), pa.array(np.full(many, r["leaves"])), pa.array(saved), pa.array([*[NOBODY] * (many - 1), r["ended"] or NOBODY]),
                ]
                boxes = [pa.array([x] * many, pa.string()) for x in (r["box"], r["up"])]
                yield pa.RecordBatch.from_arrays([*boxes, pa.array([not i for i in range(many)]), *columns], ["box", "up", "head", *NODE])

    return met.mapInArrow(run, f"box string, up string, head boolean, {NODE_TYPE}")


def prefix_trie(lists: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of ``lists`` (conv_id, turns (id, size)), conv_id unique: a row for each different sequence of first turns.

    conv_id is the node's smallest member, n_convs counts them, n_leaves and saved_tokens are sums over the subtree, and ends_sha256 is the digest of
    the members that end there. All sequences start in one container under the root. A container of more than ``container`` turns bursts: what all its sequences
    have in common becomes nodes, and below these the sequences go to containers by their next turn. Rounds thus go by branchings, not by turns. The others
    are sorted by Spark and swept in streams of whole containers; then the nodes of burst containers, last round first, sum up what lies below them.

    Equal sequences are one from the start. A sequence is a row: some tens of millions of turns at most. Sequences without turns end at the root. An empty table gives no rows.
    """
    spark, home = lists.sparkSession, f"{shared_folder(lists.sparkSession)}/trie-{uuid.uuid4().hex}"
    top = {"box": F.lit("root"), "up": F.lit(None).cast("string"), "depth": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")}
    now, ready, bursts = stored(sequences(lists, home).withColumns(top), f"{home}/open-0"), [], []
    while True:
        turn = len(bursts)
        large = now.groupBy("box").agg(F.count("*").alias("_rows"), F.sum(F.size("sizes") + 1).alias("_turns")).filter((F.col("_rows") > 1) & (F.col("_turns") > container))
        large = stored(large.select(F.col("box").alias("_box")), f"{home}/large-{turn}")
        if large.isEmpty():
            ready.append(now)
            break
        on = F.col("box") == F.col("_box")
        ready.append(now.join(large.hint("merge"), on, "left_anti"))
        over = now.join(large.hint("merge"), on, "left_semi")
        bursts.append(stored(burst(over), f"{home}/burst-{turn}"))
        below = bursts[-1].select(F.col("box").alias("_box"), F.col("conv_id").alias("_conv"), F.col("common").cast("int").alias("_common"))
        met = over.join(below.hint("merge"), on)
        ended = met.filter(F.size("sizes") == F.col("_common")).select("box", "ends")
        bursts[-1] = stored(bursts[-1].join(ended.withColumnsRenamed({"box": "_box", "ends": "ended"}).hint("merge"), on, "left").drop("_box"), f"{home}/burst-{turn}-ended")
        past = F.col("_common") + 1
        after = met.filter(F.size("sizes") > F.col("_common")).select(
            "conv_id", "n", "ends", F.expr(f"substring(ids, {DIGITS} * (_common + 1) + 1)").alias("ids"), F.expr("slice(sizes, _common + 2, size(sizes))").alias("sizes"),
            F.md5(F.concat("box", F.expr(f"substring(ids, 1, {DIGITS} * (_common + 1))"))).alias("box"), F.col("box").alias("up"), (F.col("depth") + past).alias("depth"), F.col("sizes")[F.col("_common")].alias("size"), F.col("_conv").alias("parent"),
        )
        now = stored(after, f"{home}/open-{turn + 1}")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    found = [stored(swept(rows), f"{home}/swept")]
    for turn in range(len(bursts) - 1, -1, -1):
        heads = found[0] if len(found) == 1 else found[0].unionByName(found[-1])  # containers below are swept, or burst one round later
        below = heads.filter("head and up is not null").groupBy("up").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        below = stored(below, f"{home}/below-{turn}")
        found.append(stored(chains(bursts[turn].join(below.hint("merge"), F.col("box") == below["up"]).select(bursts[turn]["*"], "kids", "leaves", "saved")), f"{home}/chains-{turn}"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*NODE)


def conversation_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The prefix trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns go by turn, null first; those of one turn by role and a hash of the text, repeated rows all count. A null role or text is an empty one, a
    null conv_id belongs to no conversation. Turns are told apart by 128 bits of hash; a text of any length counts by its code points. Other columns are ignored.
    """
    return prefix_trie(rebuilt(conversations), container)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB SQL for ``op12_trie``, where no two rows have one conv_id and turn: all prefixes laid out.
OP12_SQL = r"""
WITH RECURSIVE steps AS (SELECT range AS n, range AS v, 0 AS k FROM range(256) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE k = 8),
own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lent AS (SELECT own.*, xor(4294967295, list_reduce(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 6 AS h FROM own, crc),
made AS (SELECT x.conv_id, list_concat(coalesce(y.turns, [])[1:x.h], x.turns[x.h + 1:]) AS turns FROM lent x LEFT JOIN own y ON y.conv_id = x.conv_id - x.conv_id % 100),
paths AS (SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM made)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
held AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
under AS (SELECT path[1:k] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n - 1) * size)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM held) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM held x JOIN under USING (path) LEFT JOIN nodes p ON x.d > 0 AND p.d = x.d - 1 AND p.path = x.path[1:x.d - 1]
"""
