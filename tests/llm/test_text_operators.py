"""Suffix dedup, near-dedup, fingerprints, encoding and packing against brute force, with their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tracklake.llm import bpe, neardup, packing, shingles, suffixes, syncmers

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeéñü", k=rng.randint(1, 8))) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, periodic texts, nulls, empties, repeated rows, a very long text."""
    shared, base = prose(1, 30), prose(2, 120)
    rows = [(i, prose(100 + i, 20 + i)) for i in range(20)]
    rows += [(20, prose(3, 40) + shared + prose(4, 10)), (21, shared), (22, prose(5, 9) + " " + shared[7:] + prose(6, 40)), (23, base), (24, base), (25, base.replace(" ", "  ", 1)), (26, base + " tail words here"), (27, "ab" * 200), (28, "ab" * 90 + "c" + "ba" * 90)]
    rows += [(29, None), (30, ""), (31, " \n\t "), (32, "word"), (33, "two words"), (34, "x" * 49), (35, "x" * 50), (36, "x" * 51), (37, prose(7, 20_000)), (37, prose(8, 30)), (38, "Two\twords"), (None, base), (None, None)]
    rows += [(40 + i, base[: 300 + 40 * i]) for i in range(12)]
    return rows


def brute_spans(rows, span=50):
    seen, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - span + 1):
                w = b[i : i + span]
                seen[w] = min(seen.get(w, d), d)
    for d, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - span + 1):
            if d is not None and seen[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def test_suffixes(documents):
    rows = corpus()
    got = [tuple(r) for r in suffixes.repeated_spans(documents(rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_spans(rows), key=key)


@pytest.mark.parametrize("hot, block, ranges", [(0, 2000, 2), (3, 5000, 3), (40, 1 << 22, 4096)])
def test_suffixes_of_hot_anchors_in_many_buckets(documents, monkeypatch, hot, block, ranges):
    """Phrases with many surroundings go by windows, small ranges are cut by hash, many small blocks: the same spans."""
    for name, value in (("HOT", hot), ("BLOCK_BYTES", block), ("RANGES", ranges), ("SUFFIX_BUCKET_BYTES", 20_000), ("HASH_BUCKET_BYTES", 20_000), ("CHUNK", 64)):
        monkeypatch.setattr(suffixes, name, value)
    phrase = prose(50, 8)
    rows = [*corpus(), *((100 + i, f"{prose(300 + i % 30, 6)} {phrase} {prose(400 + i % 20, 6)}") for i in range(80)), (500, "z" * 3000), (501, "z" * 700)]
    got = [tuple(r) for r in suffixes.repeated_spans(documents(rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_spans(rows), key=key)


def test_suffixes_keep_columns_and_whole_characters(documents):
    rows = [(1, "é" * 40 + prose(9, 30)), (2, "ü" + "é" * 40 + "ü"), (3, None)]
    df = documents(rows)
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns
    found = {r.doc_id: r for r in out.collect()}
    # The last character's first byte still belongs to the repeated run, so that character goes as well.
    assert found[1].text == rows[0][1] and found[2].text == "ü" and found[2].n_chars == 1 and found[3].text == ""


def test_multikey_sort():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, group = suffixes.multikey_sort(words)
    assert [tuple(w) for w in words[order]] == sorted(tuple(w) for w in words.tolist())
    assert group[-1] + 1 == len({tuple(w) for w in words.tolist()})


def brute_components(rows, least=75):
    sets = {}
    for d, t in rows:
        if d is not None:
            words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
            s = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
            sets.setdefault(d, []).append(s)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(s and t and 100 * len(s & t) >= least * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: ([len(s) for s in sets[d]], find(d)) for d in sets}


def test_near_duplicates(documents):
    rows = corpus()
    want = brute_components(rows)
    got = neardup.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_in_blocks(documents):
    """Buckets and groups that are dealt into pairs of blocks give the same components."""
    base = prose(11, 60).split(" ")
    rows = [(i, " ".join(base[: 45 + i % 14])) for i in range(60)] + [(100 + i, prose(200 + i, 30)) for i in range(10)]
    one, many = ({r.doc_id: r.component_id for r in neardup.near_duplicates(documents(rows), block=b).collect()} for b in (2048, 5))
    assert one == many == {d: c for d, (_, c) in brute_components(rows).items()}


def test_near_duplicates_keep_one(documents):
    rows = [*corpus(), (23, corpus()[23][1])]
    out = neardup.keep_one(documents(rows))
    ids = [r.doc_id for r in out.collect()]
    want = brute_components(rows)
    assert sorted(i for i in ids if i is not None) == sorted(d for d, (_, c) in want.items() if d == c) and ids.count(None) == 2


def test_packed_bits():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 32, (2, 128)).astype(np.uint64)
    b[:90] = a[:90]
    words = neardup.as_words([neardup.pack_bits(a), neardup.pack_bits(b)])
    same = np.mean((a & np.uint64(15)) == (b & np.uint64(15)))
    assert abs(neardup.similarities(words[:1], words[1:])[0, 0] - (same - 1 / 16) / (15 / 16)) < 1e-9
    assert list(shingles.shingle_set("A b C")) == list(shingles.shingle_set("a\nB\tc"))


def brute_anchors(b, k=syncmers.K, s=syncmers.S):
    if len(b) < k:
        return [xxhash.xxh64_intdigest(b, seed=42) & 0xFFFFFFFF] if b else []
    h = [(x - (1 << 64) if x >> 63 else x) for x in (xxhash.xxh64_intdigest(b[i : i + s], seed=42) for i in range(len(b) - s + 1))]
    return [xxhash.xxh64_intdigest(b[i : i + k], seed=42) & 0xFFFFFFFF for i in range(len(b) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


def test_fingerprints(documents):
    rows = [r for r in corpus() if r[0] not in (None, 37)] + [(37, prose(7, 3000)), (5000, prose(12, 8)), (9000, "short"), (9001, "é")]
    got = {r.doc_id: r for r in syncmers.fingerprints(documents(rows), block=16).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    shown = lambda v: "".join(f"{x:08x}" for x in v)
    sketch = lambda t: sorted(set(brute_anchors(t.encode())))[: syncmers.KEPT]

    def dice(a, b):
        u = sorted(set(a) | set(b))[: syncmers.KEPT]
        both = len(set(u) & set(a) & set(b))
        return 1.0 if not a and not b else 2 * both / (len(u) + both)

    for i, (d, t) in enumerate(order):
        t, other = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == shown(sketch(t)) and r.near_next == pytest.approx(dice(sketch(t), sketch(other)))
        assert r.edited_fingerprint == shown(sketch(edited)) and r.near_edited == pytest.approx(dice(sketch(t), sketch(edited)))


def test_fingerprints_hold_all_anchors_with_places(documents):
    """An edit of a long text shows in its fingerprint, and a passage shared with the next text is found at its places."""
    words = prose(20, 4000).split(" ")
    changed, shared = [*words[:2000], "entirely", "new", *words[2002:]], prose(21, 100)
    rows = [(3, " ".join(words)), (2, " ".join(changed)), (1, prose(22, 900) + shared), (0, shared + prose(23, 900))]
    out = syncmers.fingerprints(documents(rows))
    got = {r.doc_id: r for r in out.collect()}
    for d, t in rows:
        b, places = t.encode(), got[d].fingerprint_places
        hashes = [int(got[d].fingerprint[i : i + 8], 16) for i in range(0, len(got[d].fingerprint), 8)]
        assert hashes == sorted(set(brute_anchors(b))) and hashes == [xxhash.xxh64_intdigest(b[p - 1 : p - 1 + syncmers.K], seed=42) & 0xFFFFFFFF for p in places]
        assert all(b.find(b[p - 1 : p - 1 + syncmers.K]) == p - 1 for p in places)
    assert got[3].fingerprint != got[2].fingerprint and 0.98 < got[3].near_next < 1 and got[1].near_next > 0.05
    pair = out.filter("doc_id < 2").selectExpr("doc_id", "fingerprint_places AS places", "transform(sequence(0, length(fingerprint) div 8 - 1), i -> cast(conv(substring(fingerprint, i * 8 + 1, 8), 16, 10) AS bigint)) AS values").selectExpr("doc_id", "struct(values, places) AS f")
    a, b = (pair.filter(f"doc_id = {d}").selectExpr(f"f AS f{d}") for d in (1, 0))
    at = a.crossJoin(b).select(syncmers.matched(a["f1"], b["f0"]).alias("m")).first().m
    shift = len(rows[2][1].encode()) - len(shared.encode())
    assert len(at) > 50 and sum(p.a - p.b == shift for p in at) > 0.9 * len(at)


def test_fingerprints_of_null_ids(documents):
    rows = [(None, "a" * 40), (-5, "b" * 40), (3, None)]
    got = {r.doc_id: r for r in syncmers.fingerprints(documents(rows)).collect()}
    assert got[None].edited_sha256 == hashlib.sha256(("a" * 20).encode()).hexdigest()
    assert got[-5].edited_sha256 == hashlib.sha256(("b" * 20 + "a" * 20).encode()).hexdigest()


ODD = ["ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ", "a\x1cb\x85c d", "<|startoftext|>Hi<|endoftext|> x <|endoftext", "don't we'll 's ''s 'S", "日本語テキスト 👩‍👩‍👧 é é", "½²³ 123", "ab​cd\x00e", "ab" * 3000 + "!!!???" * 100]


def test_bpe(documents):
    library = Tokenizer.from_file(WORD)
    rng = random.Random(4)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), *range(0x4E00, 0x4E20), 0x2028, 0x3000, 0x1F600, 0x300, 0x345]]
    rows = [*corpus(), *enumerate(ODD, 1000), *((2000 + i, "".join(rng.choices(alphabet, k=50))) for i in range(300))]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in bpe.round_trips(documents(rows), WORD).collect()), key=key) == sorted(want, key=key)
    sample = bpe.encoded(documents([(1, "Hello, world")]), WORD).first()
    assert sample.ids == library.encode("Hello, world").ids and sample.decoded == library.decode(sample.ids)


def test_packing(documents):
    library = Tokenizer.from_file(BYTE)
    rows = [*corpus(), *enumerate(ODD, 1000), (1, "again")]
    got = packing.pack_documents(documents(rows), BYTE).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    want = {}
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(bytes(4 * len(ids)), 1024)):
            want.setdefault(d, []).append((k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
            assert n <= 1024 and (k == 0 or n == 1024)
    assert {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for d, v in pieces.items()} == {d: sorted(v) for d, v in want.items()}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= 1.1 * total / 1024 + 2


def test_genetic_packing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1024, 600)
    start = packing.evolve(sizes, 1, [], generations=0)
    best = packing.evolve(sizes, 1, [start], generations=6)
    assert packing.fitness(best, sizes, 1024) >= packing.fitness(start, sizes, 1024)
    fill = np.bincount(best, weights=sizes)
    assert fill.max() <= 1024 and fill.sum() == sizes.sum() and (best >= 0).all()


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying all packings."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) < best[0] and i == len(sizes):
            best[0] = len(bins)
        if len(bins) >= best[0]:
            return
        for k in {f: k for k, f in enumerate(bins) if f + sizes[i] <= capacity}.values():
            go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_packing_of_small_sets_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(150):
        sizes = rng.integers(1, 41, rng.integers(1, 10))
        want = fewest_bins(sorted(sizes.tolist(), reverse=True), 40)
        assert packing.fewest(sizes, 40) <= want == -packing.fitness(packing.evolve(sizes, 1, [], 40), sizes, 40)[0]


@pytest.mark.parametrize("n", [20, 100, 1000])
def test_genetic_packing_beats_best_fit(n):
    """Three items fill each bin of the best packing; best fit decreasing pairs the large ones and needs a tenth more."""
    rng = np.random.default_rng(n)
    first = rng.integers(342, 500, n)
    second = rng.integers(260, 342, n)
    sizes = np.concatenate([first, second, 1024 - first - second])
    plain = np.full(len(sizes), -1)
    packing.best_fit(plain, [], packing.descending(sizes, 0.0, rng), sizes.tolist(), 1024)
    best = packing.evolve(sizes, 1, [])
    fill = np.bincount(best, weights=sizes)
    bins, without = -packing.fitness(best, sizes, 1024)[0], -packing.fitness(plain, sizes, 1024)[0]
    assert fill.max() <= 1024 and fill.sum() == sizes.sum() and n == packing.fewest(sizes, 1024)
    assert bins < without and bins <= 1.08 * n + 1


def test_tightening_keeps_items():
    rng = np.random.default_rng(6)
    sizes = rng.integers(100, 500, 200)
    bins = np.full(len(sizes), -1)
    packing.best_fit(bins, [], rng.permutation(len(sizes)).tolist(), sizes.tolist(), 1024)
    after = packing.tighten(bins, sizes, 1024)
    fill = np.bincount(after, weights=sizes)
    assert fill.max() <= 1024 and fill.sum() == sizes.sum() and packing.fitness(after, sizes, 1024) > packing.fitness(bins, sizes, 1024)


@pytest.mark.parametrize("run", [suffixes.repeated_spans, suffixes.without_repeats, neardup.near_duplicates, neardup.keep_one, syncmers.fingerprints, lambda d: bpe.round_trips(d, WORD), lambda d: packing.pack_documents(d, BYTE)])
def test_empty_table(documents, run):
    assert run(documents([(1, "x")]).filter("doc_id > 1")).count() == 0
