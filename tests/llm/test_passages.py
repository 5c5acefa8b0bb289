"""Substring removal, near duplicates and benchmark passages against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from furrow.llm import decontaminate, near_dedup, substring_dedup
from furrow.llm.substring_dedup import WIDTH


def removed(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_substrings_as_by_brute_force(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for width in (WIDTH, 5):
        got = [tuple(r) for r in substring_dedup.deduplicate(odd_docs, width).collect()]
        want = removed(rows, width)
        key = lambda r: (str(r[0]), *r[1:3], hashlib.md5(r[3].encode()).hexdigest())
        assert sorted(map(key, got)) == sorted(map(key, want))
    assert sum(r[2] > 0 for r in want) > 10
    assert substring_dedup.deduplicate(no_docs).count() == 0


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_classes_as_by_brute_force(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    sets = {t: shingle_set(t) for _, t in rows}
    parent = {t: t for t in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(t for t in sets if t.split()), 2):
        same = len(sets[a] & sets[b])
        if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
            parent[find(a)] = find(b)
    members = collections.defaultdict(list)
    for i, t in rows:
        members[find(t)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    want = sorted(str((i, least[find(t)], len(members[find(t)]))) for i, t in rows)
    got = sorted(str((r["doc_id"], r["class_id"], r["class_size"])) for r in near_dedup.report(odd_docs).collect())
    assert got == want
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(find(r["text"] or "")) for r in kept.collect()) == sorted(map(str, members))
    assert near_dedup.report(no_docs).count() == 0 and near_dedup.keep_one(no_docs).count() == 0


def test_copies_alike_only_to_their_original_are_one_class(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    rows = [" ".join(base)]
    for c in range(300):
        w = list(base)
        for k in rng.sample(range(300), 5):
            w[k] = f"c{c}x{k}"
        rows.append(" ".join(w))
    sets = [shingle_set(t) for t in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert all(alike(sets[0], s) for s in sets) and not all(alike(a, b) for a, b in itertools.combinations(sets[1:40], 2))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = lambda: {(r["class_id"], r["class_size"]) for r in near_dedup.report(docs).collect()}
    assert found() == {(0, 301)}
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    assert found() == {(0, 301)}


def test_signatures_bound_what_differs():
    values = near_dedup.mix(np.arange(1, 1001, dtype=np.uint64))
    a, b, c = near_dedup.signatures([values[:900], values[50:950], values[:0]])
    assert 90 <= int(np.bitwise_count(a ^ b).sum()) <= 100 and int(np.bitwise_count(a ^ c).sum()) <= 900


def test_chains_become_one_component(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([101]))]
    found = near_dedup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    assert {(bytes(r["key"])[0], bytes(r["root"])[0]) for r in found} == {*((i, 0) for i in range(1, 41)), (101, 100)}


def test_benchmark_passages(spark, odd_docs, no_docs, passages):
    long = passages[61].split("\n")[1]
    items = [(1, long), (2, "never seen words here at all today or ever"), (3, None), (4, ""), (5, passages[9]), (6, "  \n"), (7, passages[3])]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    want = set()
    for (i, text), (item, wanted) in itertools.product(rows, items):
        w, q = decontaminate.words_of(text), decontaminate.words_of(wanted or "")
        if not q or len(w) < len(q):
            continue
        width = min(5, len(q))
        grams = lambda x: collections.Counter(tuple(x[k : k + width]) for k in range(len(x) - width + 1))
        b = grams(q)
        for s in range(len(w) - len(q) + 1):
            if w[s : s + 1] == [] or not set(w[s : s + len(q)]) & set(q):
                continue
            a = grams(w[s : s + len(q)])
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                want.add((i, item))
                break
    got = decontaminate.matches(odd_docs, table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 5
    clean = decontaminate.keep_clean(odd_docs, table)
    assert clean.columns == odd_docs.columns
    hit = collections.Counter(str(i) for i, t in rows if any((i, k) in want for k, _ in items))
    assert collections.Counter(str(r["doc_id"]) for r in clean.collect()) <= collections.Counter(str(i) for i, _ in rows) - hit + collections.Counter({"None": 2, "904": 2})
    assert decontaminate.matches(no_docs, table).count() == 0
    assert decontaminate.matches(odd_docs, table.where("false")).count() == 0
    assert decontaminate.keep_clean(odd_docs, table.where("false")).count() == len(rows)


def test_documents_that_are_shortened_items(spark):
    item = [f"w{k}" for k in range(60)]
    cut = [item[:-1], item[4:], item[:30] + item[31:], item[:49], item[:40], item[:4], item[:1]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(cut)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    alike = [len(grams(w) & grams(item)) / len(grams(w) | grams(item)) for w in cut]
    want = {(i, 7, 0, len(w), round(s, 9)) for i, (w, s) in enumerate(zip(cut, alike)) if s >= 0.8}
    assert {(*r[:4], round(r[4], 9)) for r in decontaminate.matches(docs, items).collect()} == want and len(want) == 4
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()} == {4, 5, 6}


def test_passages_with_a_filler_are_found(spark):
    rng = random.Random(8)
    docs, items, alike = [], [], {}
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        at = (0, 91, 182)[k % 3]
        changed = words[:at] + ["na"] * (22 if at != 91 else 18) + words[at + (22 if at != 91 else 18) :]
        grams = [collections.Counter(tuple(w[i : i + 5]) for i in range(200)) for w in (words, changed)]
        alike[k] = sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values())
        items.append((k, " ".join(words)))
        docs.append((k, "before " + " ".join(changed) + " after"))
    assert 0.8 <= min(alike.values()) < 0.82
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for kind in ("smallint", "decimal(9,0)", "string"):
        table = spark.createDataFrame(items, "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
        found = decontaminate.matches(docs, table)
        assert found.schema["item_id"].dataType.simpleString() == kind
        assert {(r["doc_id"], int(r["item_id"])) for r in found.collect()} == {(k, k) for k in range(60)}


def test_repeats_are_labelled():
    rows = np.array([[5, 7, 5, 5, 9], [1, 2, 3, 4, 5]], np.uint64)
    got = decontaminate.labelled(rows)
    assert got[1].tolist() == rows[1].tolist() and len(set(got[0].tolist())) == 5 and got[0, [0, 1, 4]].tolist() == [5, 7, 9]
    assert decontaminate.last_before(rows[0]).tolist() == [-1, -1, 0, 2, -1]


def test_items_in_blocks_give_the_same(spark, odd_docs, passages, monkeypatch):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(passages[:30])], "item_id long, text string")
    one = sorted(map(str, decontaminate.matches(odd_docs, table).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 9)
    assert sorted(map(str, decontaminate.matches(odd_docs, table).collect())) == one
