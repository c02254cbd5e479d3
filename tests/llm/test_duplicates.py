from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import graph, lines, minhash, queries, simhash, substrings
from tests_llm_help import shingles  # noqa: E402  (beside this file)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op9


def simhash_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    made = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(m.encode(), 42) for m in made]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_of(prints, bits=3):
    ids, root = list(prints), {}
    for i in ids:
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, sf, texts):
    prints = {i: simhash_of(t) for i, t in texts.items()}
    want = components_of(prints)
    rows = simhash.op9_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 13
    of = defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert of[1] == of[2] and of[3] == of[4] == of[5] == {(0, 3)}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_of_sliced_texts(monkeypatch, texts):
    some = [*list(texts.values())[:12], "a", "a b", " a  b c ", "", "A\tB c\x0bd"]
    monkeypatch.setattr(simhash, "STEP", 7)
    assert [simhash.fingerprint(t) for t in some] == [simhash_of(t) for t in some]


def test_every_link_within_three_bits(spark):
    draw = random.Random(4)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in draw.sample(range(64), draw.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    prints |= {0, 1, 3, (1 << 64) - 1, (1 << 64) - 8, 1 << 63}
    want = {(a, b) for a in prints for b in prints if simhash.signed(a) < simhash.signed(b) and (a ^ b).bit_count() <= 3}
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for zeros in (2, 3, 4):
        got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.linked(frame, zeros=zeros).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    grid = [simhash.zero_groups(10**n) for n in range(12)]
    assert grid == sorted(grid) and grid[0] == grid[5] == 2 and grid[9] > 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(200, 260)}, 7: 7, 900: 900, 901: 900}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op5


def test_minhash_matches_brute_force(spark, sf, texts):
    rows = {r["doc_id"]: r for r in minhash.op5_minhash(spark, sf).collect()}
    ids, prints, errors = sorted(texts, reverse=True), {}, []
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, i in enumerate(ids):
        text, after = texts[i], texts[ids[(n + 1) % len(ids)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        errors += [r["near_edited"] - likeness(shingles(text, 5), shingles(edited, 5)), r["near_next"] - likeness(shingles(text, 5), shingles(after, 5))]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04 and np.abs(errors).max() < 0.2


def test_minhash_ranges_do_not_matter(small):
    want = sorted(map(tuple, minhash.fingerprint_edits(small).collect()))
    assert sorted(map(tuple, minhash.fingerprint_edits(small, size=2000).collect())) == want


def test_minhash_of_odd_rows(spark, odd, none):
    rows = minhash.fingerprint_edits(odd, size=500).collect()
    of = defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    assert len(rows) == 13 and of[3][0]["n_chars"] == 0 and of[1][0]["fingerprint"] == of[2][0]["fingerprint"]
    assert of[4][0]["near_next"] == 1.0 and of[2][0]["near_next"] == 1.0
    assert abs(of[7][0]["near_next"] - 6 / 7) < 0.1  # six shingles again and again, and one more
    assert minhash.fingerprint_edits(none).count() == 0
    one = minhash.fingerprint_edits(odd.filter("doc_id = 9")).collect()
    assert one[0]["near_next"] == 1.0


# --- op6


def remaining_of(rows, length):
    """Bytes removed, runs and digest of (doc_id, text) rows, by holding every string against all."""
    last, first = 1 << 63, {}
    raw = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(first.get(t[p : p + length], last), i)
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((None if i == last else i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got_of(frame):
    return sorted((tuple(r)[:5] for r in frame.collect()), key=repr)


def test_substrings_match_brute_force(spark, sf, texts):
    want = remaining_of(texts.items(), 50)
    assert sum(w[2] for w in want) > 0
    assert got_of(substrings.op6_substrings(spark, sf)) == want


def test_substrings_in_many_groups_hot_or_not(spark):
    draw = random.Random(2)
    parts = ["".join(draw.choices("ab", k=draw.randint(3, 40))) for _ in range(12)] + ["ab" * 30, "x" * 70, "é" * 20]
    rows = [(draw.randint(0, 40), "".join(draw.choices(parts, k=draw.randint(0, 9)))) for _ in range(60)] + [(None, parts[0] + parts[1]), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (12, 50):
        want = remaining_of(rows, length)
        assert got_of(substrings.removed_spans(frame, length, group_bytes=300, bucket_bytes=500)) == want
        assert got_of(substrings.removed_spans(frame, length, group_bytes=300, bucket_bytes=500, hot=2)) == want


def test_substrings_of_sliced_texts(monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choices("abc", k=900)).encode() + b"z" * 200
    _, _, whole = substrings.runs_of([text, b"", b"short", text[100:400]], 20)
    monkeypatch.setattr(substrings, "SLICE", 64)
    _, _, sliced = substrings.runs_of([text, b"", b"short", text[100:400]], 20)
    spread = lambda r: sorted(zip((w := r.windows()).at.tolist(), w.doc.tolist(), w.anchor.tolist()))
    assert spread(whole) == spread(sliced) and len(spread(whole)) == 1081 + 281


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), max_size=30))
def test_previous_factors(rows):
    order, same = np.array([r[0] for r in rows], np.int64), np.array([r[1] and i > 0 for i, r in enumerate(rows)], bool)
    stretch = np.cumsum(~same)
    want = [any(stretch[j] == stretch[i] and order[j] < order[i] for j in range(len(rows))) for i in range(len(rows))]
    assert substrings.previous_factors(order, same).tolist() == want


def test_substrings_of_odd_rows(spark, odd, none):
    rows = substrings.removed_spans(odd, keep=True).collect()
    of = {r["doc_id"]: r for r in rows}
    assert len(rows) == 13 and of[1]["n_removed"] == 0 and of[2]["n_removed"] == 0  # 44 bytes: shorter than a match
    assert of[6]["n_removed"] == 0 and of[7]["n_spans"] == 1 and of[7]["kept"].endswith(b"end") and of[10]["n_removed"] == 0
    assert substrings.removed_spans(none).count() == 0


# --- op8


def templates_of(rows, min_docs=3, together=1024):
    """Lines kept of (doc_id, text) rows: components of likeness by all pairs of a leaf, then templates grown line by line."""
    tokens = lambda line: tuple("<*>" if re.search("[0-9]", t) else t for t in line.split())
    solid = lambda line: bool(line) and not line.isspace()
    most = lambda t: len(t[3:]) - math.ceil(0.8 * len(t[3:]) - 1e-9)
    leaves, root, n, place = defaultdict(list), {}, defaultdict(int), {}
    for doc, text in rows:
        held = {}
        for nth, x in enumerate((text or "").split("\n")):
            if solid(x):
                held.setdefault(tokens(x), nth)
        for t, nth in held.items():
            if t not in root:
                leaves[len(t), t[:3]].append(t)
                root[t] = t
            n[t] += 1
            if doc is not None:
                place[t] = min(place.get(t, (doc, nth)), (doc, nth))

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for found in leaves.values():
        for i, t in enumerate(found):
            for s in found[:i]:
                if sum(a != b for a, b in zip(s, t)) <= most(t):
                    root[find(t)] = find(s)
    groups, template = defaultdict(list), {}
    for t in root:
        groups[find(t)].append(t)
    for group in groups.values():
        left = sorted(group, key=lambda t: (-n[t], t not in place, place.get(t)))
        grown = []  # [leader, places that vary]
        while left:
            batch, left = left[:together], left[together:]
            for t in batch:
                for g in grown:
                    vary = g[1] | {i for i, (a, b) in enumerate(zip(g[0], t)) if a != b}
                    if len(vary) <= most(t):
                        g[1], template[t] = vary, g[0]
                        break
                else:
                    grown.append([t, set()])
                    template[t] = t
            rest = []
            for t in left:
                fits = [g[0] for g in grown if len(g[1] | {i for i, (a, b) in enumerate(zip(g[0], t)) if a != b}) <= most(t)]
                if fits:
                    template[t] = fits[0]
                else:
                    rest.append(t)
            left, grown = rest, []  # all others have been held against these
    seen = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if solid(x) and doc is not None:
                seen[template[tokens(x)]].add(doc)

    def drop(doc, x):
        if not solid(x) or doc is None:
            return False
        docs = seen[template[tokens(x)]]
        return len(docs) >= (2 if len(x.split()) >= 50 else min_docs) and min(docs) != doc

    return sorted(((d, None if t is None else "\n".join(x for x in t.split("\n") if not drop(d, x))) for d, t in rows), key=repr)


def test_lines_match_brute_force(spark, small, texts):
    rows = list(texts.items()) + [(1000 + i, f"Page {i} of 90\nwas posted in {'abc'[i % 3]} under general news by our staff today\nown line {'xyz'[i]} stays here") for i in range(3)]
    got = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"))
    want = templates_of(rows)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == want
    kept = dict(want)
    assert "Page" in kept[1000] and "Page" not in kept[1001] and "posted" not in kept[1002]


def test_lines_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lines.drop_recurring(odd)
    assert got.columns == [c for c in odd.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == templates_of(rows)
    assert lines.drop_recurring(none).count() == 0


@pytest.mark.parametrize("name", ["op6_substrings", "op8_lines"])
def test_matches_duckdb(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
