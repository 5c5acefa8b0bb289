"""Repeated byte strings against brute force, and the suffix array against sorted suffixes."""

import collections
import random

import numpy as np

from furrow.llm import suffix_dedup


def removed(rows, width):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[k : k + width] for r in raw for k in range(len(r) - width + 1))
    out = []
    for (i, _), r in zip(rows, raw):
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), runs, bytes(x for x, g in zip(r, gone) if not g)))
    return sorted(map(repr, out))


def small(text):
    """The long texts of the fixture are too long for brute force."""
    return text if text is None or len(text) < 20_000 else text[:9000]


def test_removed_bytes_as_by_brute_force(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r["doc_id"], small(r["text"])) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(5000, "é" * 300), (5001, "日本語" * 100 + "x"), (5002, "y" + "日本語" * 100), (5003, "\x00" * 500)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(3)
    got = lambda width: sorted(repr(tuple(r)) for r in suffix_dedup.deduplicate(docs, width).collect())
    for width in (400, 31):
        want = removed(rows, width)
        plain = lambda found: [x.replace("bytearray(", "").replace("'))", "')").replace('"))', '")') for x in found]
        assert plain(got(width)) == want
        monkeypatch.setattr(suffix_dedup, "KINDS", 1)  # all levels
        assert plain(got(width)) == want
        monkeypatch.setattr(suffix_dedup, "KINDS", 256)
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", 500)  # long texts in parts
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3000)
        assert plain(got(width)) == want
        monkeypatch.undo()
    digests = suffix_dedup.deduplicate(docs, 400, digest=True)
    assert digests.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and digests.count() == len(rows)
    assert suffix_dedup.deduplicate(no_docs).count() == 0


def test_suffix_array_as_by_sorting():
    rng = random.Random(4)
    cases = [b"banana", b"a" * 50, b"", b"\xff", b"abc" * 20 + b"\xff" + b"abc" * 20 + b"\xff", b"aab" * 9, b"mississippi\xffmiss\xff", b"\x00" * 9 + b"\x01"]
    cases += [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for letters in (b"ab", b"ab\xff", bytes(range(256)), b"\x00\x01") for _ in range(12)]
    for raw in cases:
        data = np.frombuffer(raw, np.uint8)
        order = suffix_dedup.suffix_array(data, len(raw) + 1)
        want = sorted(range(len(raw)), key=lambda k: raw[k:])
        assert order.tolist() == want
        # To a bounded depth the order is right by so many bytes at least.
        near = suffix_dedup.suffix_array(data, 16)
        assert [raw[k : k + 16] for k in near] == [raw[k : k + 16] for k in want]
        prefixes = suffix_dedup.common_prefixes(order, suffix_dedup.words_at(data), 30)
        for x, y, n in zip(want, want[1:], prefixes.tolist()):
            same = next((k for k, (p, q) in enumerate(zip(raw[x:], raw[y:])) if p != q), min(len(raw) - x, len(raw) - y))
            # Behind the end there are zeros, which only zeros equal.
            assert n >= min(same, 30) and (n == min(same, 30) or raw[max(x, y) + same :].strip(b"\0") == b"")


def test_repeats_count_times():
    texts = [b"abcdefgh", b"xbcdefgy", b"zzzzzz"]
    found = suffix_dedup.repeats(texts, np.array([5, 5, 3]), np.array([1, 1, 1]), 4)
    assert sorted(zip(*(x.tolist() for x in found))) == [(0, 1, 4), (1, 1, 4), (2, 0, 3)]
    found = suffix_dedup.repeats(texts[:1], np.array([5]), np.array([2]), 4)
    assert [x.tolist() for x in found] == [[0], [0], [5]]
    assert all(len(x) == 0 for x in suffix_dedup.repeats(texts[:1], np.array([5]), np.array([1]), 4))
