"""Fill-in-the-middle and the alignment of two tokenizers against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa

from furrow.llm import align, fill_middle
from furrow.llm.queries import tokenizer


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def filled(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(text) + 1) for x in h[:2])
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, text, text)
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(text), "spm" if spm else "psm", low, high - low, out, text)


def test_fill_middle_as_by_slices_of_strings(spark, odd_docs, no_docs, monkeypatch):
    more = ["a<P>b", "<M>", "<", "<P", "é😀ñ" * 50, "\x00a\x00", "S><P" * 9, "日本語テキスト"] + [f"text number {k} <" for k in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more, 2000)), "doc_id long, text string"))
    want = sorted(map(repr, (filled(*r) for r in docs.collect())))
    assert sorted(repr(tuple(r)) for r in fill_middle.transform(docs).collect()) == want
    assert {"plain", "psm", "spm"} == {r["form"] for r in fill_middle.transform(docs).collect()}
    assert fill_middle.transform(no_docs).count() == 0
    texts = [r["text"] or "" for r in docs.collect()]
    whole = fill_middle.cut(pa.array(["".join(texts)]), np.array([70]), np.array([99_000]))
    monkeypatch.setattr(fill_middle, "PART_BYTES", 5000)
    assert fill_middle.cut(pa.array(["".join(texts)]), np.array([70]), np.array([99_000])) == whole


def test_units_of_a_slice_are_its_own():
    texts = pa.array(["ab", None, "", "é😀", "z"])
    assert fill_middle.units(texts.slice(2, 2)).to_pylist() == [[], ["é", "😀"]]


PATHS = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def aligned(texts):
    """Groups and link counts of each text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {c: i for i, c in enumerate(align.byte_letters())}
    out = []
    for text in texts:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in y]).tolist() for y in (ba, bb)]
                common = set(ends[0]) & set(ends[1])
                sides = []
                for ids, es in zip((ia, ib), ends):
                    sides.append([[]])
                    for i, e in zip(ids, es):
                        sides[-1][-1].append(i)
                        if e in common:
                            sides[-1].append([])
                groups = [g for g in zip(*sides) if g[0]]
        out.append(groups)
    return out


def reported(rows):
    groups = aligned([t for _, t in rows])
    links = [collections.Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    counts = collections.Counter(p for one in links for p in one)
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, one in zip(rows, groups, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(one.values()),
            sum(n for (x, y), n in one.items() if counts[x, y] == most[x]), sum(n * counts[p] for p, n in one.items()),
            sha(text) if text else "",
        ))
    return sorted(map(repr, out))


ODD = [
    "hello  world <s> <|endoftext|> it's 12345", "▁ x", "é😀 ñ — “quoted”", "日本語テキスト", "\x00\x01 a\tb\n\n  c ", " lead", "x", "don't  stop   ",
    "supercalifragilisticexpialidocious antidisestablishmentarianism", "aaaa" * 100, "́ é", "<0x41> <unk> </s>",
]


def test_alignment_as_by_tokens(spark, odd_docs, no_docs, monkeypatch):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD, 3000)), "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want = reported(rows)

    def got(**options):
        found = align.report(docs, *PATHS, **options)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return sorted(repr(tuple(r)) for r in found.collect())

    assert got() == want
    assert got(held=300) == want  # counts in several parts
    assert align.report(no_docs, *PATHS).count() == 0
    by_row = align.align(docs, *PATHS)
    table = align.link_table(by_row).groupBy("row").sum("links").collect()
    assert {r[0]: r[1] for r in table} == {r["row"]: r["n_links"] for r in by_row.collect() if r["n_links"]}


def test_lanes_and_wide_groups_change_nothing(monkeypatch):
    rng = random.Random(1)

    def row(cuts):
        ends = np.array([e + base for base, c in cuts for e in c], np.int64)
        return align.Tokens(np.array([rng.randrange(5) for _ in ends]), ends, np.concatenate([[0], np.cumsum([len(c) for _, c in cuts])]))

    lengths = [0, 1, 7, 300, 0, 40, 1000]
    bases = np.cumsum([0, *lengths[:-1]]).tolist()
    for share in (0.05, 0.3, 0.9):
        cuts = [[(base, [e for e in range(1, n) if rng.random() < share] + [n] * (n > 0)) for base, n in zip(bases, lengths)] for _ in range(2)]
        a, b = map(row, cuts)
        found = []
        for lane in (1, 3, 50, 10_000):
            for wide in (1, 10, 1 << 20):
                monkeypatch.setattr(align, "WIDE", wide)
                merged = align.merge(a, b, lane)
                found.append((merged.cuts.tolist(), [x.tolist() for x in align.linked(merged, a, b)], align.groups_text(merged, a, b, 5).to_pylist()))
        assert all(f == found[0] for f in found)
        common = sorted(set(a.ends) & set(b.ends))
        assert [int(a.ends[x - 1]) for _, x, _ in found[0][0]] == common
        size = sum((x1 - x0) * (y1 - y0) for (_, x0, y0), (_, x1, y1) in zip([(0, 0, 0), *found[0][0]], found[0][0]))
        assert size == sum(found[0][1][2])


def test_chunks_of_a_text_have_the_tokens_of_the_whole(monkeypatch):
    a, b = align.tokenizers(*PATHS)
    rng = random.Random(2)
    odd = [" ", "  ", "word", "é", "12", "\n", "'s", "x y", ".", "日", "\xa0", "\x1c", "\u3000", "-- ", "l" * 70, "\t "]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(80))) for _ in range(300)] + ODD
    texts = [t for t in texts if "▁" not in t]
    assert all(" ".join(align.chunks(t)) == t for t in texts) and max(len(align.chunks(t)) for t in texts) > 5
    monkeypatch.setattr(align, "REMEMBERED", 40)
    encoder = align.Encoder(a, b)
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        for side, kind, space in zip(encoder.tokens(some), (a, b), (" ", "")):
            whole = kind.encode([space + t for t in some if t])
            got = [side.ids[x:y].tolist() for x, y in zip(side.starts, side.starts[1:])]
            assert [g for g, t in zip(got, some) if t] == whole
