"""The operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontam, exact_dedup, langid, mixing, quality, queries, sharding, simhash, token_counts, token_ids, warc

DIR = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text_of(i, 3 + i % 40), ["en", "fr"][i % 2], f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, text_of(7, 30), "en", "s0") for i in range(25)]  # copies
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \t\n ", "fr", None), (None, "no id here", "en", "s1"), (None, None, None, None)]
    rows += [(5, text_of(5, 8), "en", "s2")] * 3  # repeated rows
    rows += [(300, text_of(9, 30_000), "en", "s1")]  # a long text
    extra = [(*r, k, "x", True) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, score string, kept boolean"
    return spark.createDataFrame(extra, schema).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pdf(df):
    return df.toPandas()


def test_sharding(docs, empty):
    out = pdf(sharding.digest(sharding.shard_rows(docs, shards=8)))
    rows = docs.collect()
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == Counter(
        (None if i != i else int(i), s, c) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32)
    )
    counts = out.shard.value_counts()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.shard_rows(empty).count() == 0
    whole = sharding.shard_rows(docs, shards=3)
    assert {"text", "score", "n_chars"} <= set(whole.columns)


def test_sharding_permutation_is_seeded_and_mixed(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    a, b = (pdf(sharding.shard_rows(df, shards=2, seed=s)).sort_values(["shard", "slot"]).doc_id.tolist() for s in (1, 1))
    assert a == b and a != pdf(sharding.shard_rows(df, shards=2, seed=2)).sort_values(["shard", "slot"]).doc_id.tolist()
    assert abs(np.corrcoef(a, np.arange(2000))[0, 1]) < 0.1


def test_exact_dedup(docs, empty):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and "score" in out.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(norm(r.text).encode()).hexdigest()].append(r.doc_id)
    least = lambda ids: None if None in ids else min(ids)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.keep_id == least(groups[r.text_sha256]) and r.group_size == len(groups[r.text_sha256])
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == dict.fromkeys(groups, 1)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_is_right_when_the_filter_is_full_or_joined(spark, docs):
    """One bit a row, so that most unique rows look repeated; and bitmaps that are joined, not broadcast."""
    many = spark.range(70_000).select(F.col("id").alias("doc_id"), (F.col("id") % 60_000).cast("string").alias("text"))
    for df in (docs, many):
        out = [sorted(map(str, exact_dedup.exact_dedup(df, carry=[], bits_per_row=n, max_maps=m).drop("kept").collect())) for n, m in ((16, 1 << 14), (1, 1 << 14), (16, 0), (1, 0))]
        assert all(x == out[0] for x in out)
    assert exact_dedup.exact_dedup(many, carry=[], bits_per_row=1).where("kept").count() == 60_000


def brute_components(fps: list[int], most: int) -> dict[int, int]:
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if bin(a ^ b).count("1") <= most:
            roots[find(a)] = find(b)
    return {f: find(f) for f in fps}


def slow_fingerprint(text: str | None) -> int:
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def check_components(rows, fps, ids):
    comp = brute_components(list(fps), 4)
    least = {}
    for f, i in zip(fps, ids):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = Counter((i, f"{f:016x}", least.get(comp[f])) for f, i in zip(fps, ids))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want


def test_simhash(docs, empty):
    src = docs.collect()
    out = simhash.near_duplicates(docs).collect()
    check_components(out, [slow_fingerprint(r.text) for r in src], [r.doc_id for r in src])
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_on_data(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    src = d.collect()
    check_components(simhash.near_duplicates(d).collect(), [slow_fingerprint(r.text) for r in src], [r.doc_id for r in src])


def test_simhash_links_dense_chains_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 40)
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in fps[:6]:  # chains whose ends are far apart, and dense balls
        x = base
        for _ in range(25):
            for b in rng.choice(64, 4, replace=False):
                x ^= 1 << int(b)
            fps.append(x)
        fps += [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in set(fps)]
    want = brute_components(fps, 4)
    groups = defaultdict(set)
    for f, r in want.items():
        groups[r].add(f)
    for n in (None, 8, 10):
        got = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), groups=n)).collect()
        root = {r.node % (1 << 64): r.root for r in got}
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(f for f in root if root[f] == r) for r in set(root.values())}


def test_links_in_cell_connect_all_that_links_connect():
    """Also two points whose only link is between them, while others reached each of them before."""
    ends = [0x3FF00000, 0x3FF0000F, 0x3C003F00000, 0x3C003F0000F]
    rng, sets = np.random.default_rng(3), [[x ^ y for x in ends for y in (0, 1 << 60)]]
    for _ in range(60):
        flips = [[1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 7))] for _ in range(120)]
        bases = [int(x) for x in rng.integers(0, 1 << 63, 8)]
        sets.append([bases[k % 8] ^ reduce(xor, f, 0) for k, f in enumerate(flips)])
    for points in sets:
        points = sorted(set(points))
        a, b = simhash.links_in_cell(np.array(points, np.uint64), 4)
        assert all(bin(int(x) ^ int(y)).count("1") <= 4 for x, y in zip(a, b))
        want = len(set(brute_components(points, 4).values()))
        assert len(points) - len(a) == want  # a forest with as many trees as there are components


def test_popcount_distance_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    ca, cb = simhash.segment_counts(a), simhash.segment_counts(b)
    lanes = lambda c: np.stack([(c >> np.uint64(2 * k)) & np.uint64(3) for k in range(32)]).astype(int)
    assert (np.abs(lanes(ca) - lanes(cb)).sum(0) <= np.bitwise_count(a ^ b)).all()
    assert all(sum(simhash.group_masks(g)) == (1 << 64) - 1 for g in simhash.GROUPS.values())


def slow_targets(sizes: dict, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        s = min(over, key=lambda s: sizes[s] / w[s])
        target[s] = most * sizes[s]
        free.discard(s)


def test_mixing(docs, empty):
    out = mixing.mix(docs)
    assert {"text", "lang", "score"} <= set(out.columns)
    rows = mixing.digest(out).join(docs.limit(0).select(F.col("doc_id").alias("z")), F.lit(False), "left").collect()
    assert len(rows) == docs.count()
    sizes, taken, target, per = defaultdict(int), defaultdict(int), {}, []
    for r in out.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r["size"] == n and 0 <= r.times <= 3
        sizes[r.source] += n
        taken[r.source] += n * r.times
        target[r.source] = r.target
        per.append(r)
    want = slow_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        # As near as any choice of whole documents comes.
        reach, copies = {0}, int(target[s] // sizes[s]) if sizes[s] else 0
        for r in per:
            if r.source == s:
                reach |= {x + r["size"] for x in reach}
        budget = round(target[s] - copies * sizes[s])
        assert abs(taken[s] - copies * sizes[s] - budget) == min(abs(x - budget) for x in reach)
    key = lambda r: (str(r.doc_id), str(r.text)[:50], r.times)
    assert sorted(map(key, per)) == sorted(map(key, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_fits_the_budget(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.digest(mixing.mix(d, carry=[])).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    for r in got.collect():
        assert abs(r.t - r.g) <= 1


def test_knapsack():
    rng = np.random.default_rng(4)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = mixing.fit(lengths, counts, budget)
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {x + k * n for x in reach for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all()
        assert abs((take * lengths).sum() - budget) == min(abs(x - budget) for x in reach)
    lengths = np.arange(2, 20_002, 2)
    counts = rng.integers(0, 50, len(lengths))
    for part in (0.1, 0.5, 0.99):
        budget = int((lengths * counts).sum() * part)
        assert abs((mixing.fit(lengths, counts, budget) * lengths).sum() - budget) == budget % 2


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(queries.tokenizer(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


ODD = ["a<|endoftext|>b <|endoftext|> c", "  two  spaces \n\n line\t\ttab ", "Ünïcödé Straße İstanbul ΑΣ. ٣٤ 漢字 👍🏽", "x\x1cy\x85z w  ", "é İ don't I'LL 'S", ".,.,, a. B, ..", "<|startoftext|>q", "́ x"]


def test_token_counts(spark, docs, library):
    counter = token_counts.WholeTokens(queries.tokenizer("byte_bpe_50k.json"))
    texts = ODD + [r.text for r in docs.collect()] + [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    for t in texts:
        assert counter.count(t) == len(library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids), repr(t)[:80]
    with pytest.raises(ValueError):
        token_counts.WholeTokens(queries.tokenizer("word_bpe_49k.json"))
    counted = docs.select("text", token_counts.token_count(F.col("text"), queries.tokenizer("byte_bpe_50k.json")).alias("n")).collect()
    assert len(counted) == docs.count()
    assert all(r.n == len(library["byte_bpe_50k.json"].encode(r.text or "", add_special_tokens=False).ids) for r in counted)
    out = queries.op5_token_counts(spark, DIR).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(out) == len(text)
    for r in out:
        n = len(library["byte_bpe_50k.json"].encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)


def test_token_counts_remember_within_bounds(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counter, lib = token_counts.WholeTokens(queries.tokenizer("byte_bpe_50k.json")), library["byte_bpe_50k.json"]
    for t in ODD + [text_of(3, 200), "q" * 5000 + " " + "zx" * 3000]:
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids)
    assert len(counter.pieces) <= 5 and len(counter.rest) <= 5 and max(map(len, counter.pieces)) <= token_counts.REMEMBERED_LENGTH


def test_token_ids(spark, docs, empty, library):
    odd = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    got = token_ids.encode_table(table, queries.tokenizer("word_bpe_49k.json"), 1).orderBy("start").collect()
    lib = library["word_bpe_49k.json"]
    want = Counter()
    for r in table.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, last = 0, -1
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    assert token_ids.encode_table(empty, queries.tokenizer("word_bpe_49k.json"), 1).count() == 0


def test_special_strings_in_any_case(library, monkeypatch):
    """As the library: special strings count only as they are written, alone and glued to words; others are plain text."""
    parts = ["<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|STARToftext|>", "<|", "|>", "a", "B", "É", "\n", ".", ",", "é", "ab", "'S", "x1", "漢", "İ", " ", " "]
    rng, lib, words = np.random.default_rng(5), library["word_bpe_49k.json"], token_ids.Words(queries.tokenizer("word_bpe_49k.json"), 1)
    monkeypatch.setattr(token_ids, "REMEMBERED", 300)  # words are forgotten, too
    for _ in range(1250):
        texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(8)]
        ids, counts = words.encode(pa.array(texts))
        at = np.concatenate(([0], np.cumsum(counts)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*e.ids, 1] for e in lib.encode_batch(texts, add_special_tokens=False)]
    long = ["z" * 9000 + " y", "q" * 200 + " q " * 50]
    for _ in range(3):
        ids, _ = words.encode(pa.array(long))
        assert ids.tolist() == [i for e in lib.encode_batch(long, add_special_tokens=False) for i in [*e.ids, 1]]


def test_token_ids_of_repeated_ids_in_small_parts(spark, library, tmp_path):
    """Rows of one id, and rows without one, are dealt over parts; blocks and files of one document."""
    rows = [(None, f"null {k}") for k in range(40)] + [(7, f"same {k}") for k in range(60)] + [(k, text_of(k, 9)) for k in range(20)]
    df, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/ids"
    token_ids.write_ids(df, queries.tokenizer("word_bpe_49k.json"), 1, path, part_bytes=100, block_bytes=1)
    got = token_ids.read_ids(spark, path).orderBy("start").collect()
    lib, want = library["word_bpe_49k.json"], Counter()
    for i, t in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len({x for x in (tmp_path / "ids" / "ids").iterdir() if x.is_dir()}) > 20


def test_variable_length_coding():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 100)
    ranks = (2 ** (rng.random(counts.sum()) * 32)).astype(np.uint32)
    control, data, _, ends = token_ids.pack(ranks, counts)
    assert (token_ids.unpack(control, data, counts) == ranks).all() and ends[-1] == len(data)
    assert token_ids.unpack(control[:0], data[:0], counts[:0]).size == 0


def test_warc(spark):
    big, mid = "é<p>\r\n\r\nWARC/1.1\r\n" * 4000, "m" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", mid), (3, None, mid), (9, "u", mid), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", mid), (9, "u", mid), (7, "u", "")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archive_pages(pages, segment=2000).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((t or "").encode()), sha(t)) for i, _, t in rows)
    mids = [r for r in got if r.payload_digest == sha(mid)]
    assert Counter(r.record_type for r in mids) == {"response": 1, "revisit": 4}
    assert {r.refers_to for r in mids if r.record_type == "revisit"} == {9} and [r.page_id for r in mids if r.record_type == "response"] == [9]
    assert all(r.record_type == "response" and r.refers_to is None for r in got if r.payload_digest != sha(mid))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_segments_are_verified():
    block = b"0123456789" * 10
    parts = list(warc.parse(b"".join(r + b"\r\n\r\n" for r in warc.records("response", "urn:x", [], block, 30))))
    assert [p[0].get("warc-segment-number") for p in parts] == ["1", "2", "3", "4"]
    segs = [(int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, b) for f, b in parts]
    assert warc.joined(segs[::-1]) == block
    for bad in (segs[:-1], segs[1:], [segs[0], *segs[2:]], [*segs[:-1], (4, 99, segs[-1][2])]):
        with pytest.raises(ValueError):
            warc.joined(bad)
    assert warc.dechunked(warc.chunked(block, 7)) == block and warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for bad in (b"3\r\nabcd\r\n0\r\n\r\n", b"zz", b"5\r\nab"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_warc_archives(spark, tmp_path):
    """Each record is a gzip member; ids of any type come back; a changed payload or a missing response is an error."""
    rows = [("a:b/ü %", "m" * 1500), ("z", "m" * 1500), ("", "m" * 1500), (None, "m" * 1500), ("z", "x" * 30_000)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id string, url string, html string")
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    assert got == {("a:b/ü %", 1500): ("revisit", "z"), ("z", 1500): ("response", None), ("", 1500): ("revisit", "z"), (None, 1500): ("revisit", "z"), ("z", 30_000): ("response", None)}
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    files = [f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*"))]
    made = [m for f in files for m in warc.members(f)]
    assert b"".join(made) == b"".join(map(gzip.decompress, files)) and all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") for m in made)
    assert all(len(list(warc.parse(m))) == 1 for m in made)
    with pytest.raises(ValueError):
        list(warc.members(files[0][:-1]))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0").write_bytes(warc.member(next(m for m in made if b"chunked" in m and b"mmm" in m).replace(b"mmm", b"mmn", 1)))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark, f"file://{tmp_path}/bad").collect()


def slow_tiles(item, doc, length):
    """Greedy string tiling by its definition."""
    mi, md = [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not mi[i + n] and not md[d + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < length:
            return sum(mi)
        mi[i : i + n] = [True] * n
        md[d : d + n] = [True] * n


def test_tiling_against_its_definition():
    rng = np.random.default_rng(6)
    for k in range(150):
        signs, n = k % 5 + 1, k % 3 + 1
        item = rng.integers(0, signs + 1, int(rng.integers(3, 28)))
        doc = np.concatenate([rng.integers(0, signs + 1, 10), item[12:], rng.integers(0, signs + 1, 5), item[:12]])
        assert decontam.tile(item, doc, n) == slow_tiles(item.tolist(), doc.tolist(), n)


def test_tiling_of_long_repetitive_texts_is_bounded():
    """Memory follows the tokens of both, not the places at which they agree."""
    index, text = decontam.Index([(1, " ".join(["x"] * 3000))]), " ".join(["x"] * 20_000)
    tracemalloc.start()
    assert index.matches([text]) == [[(1.0, 1)]]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6


def test_tokens():
    assert decontam.tokens("Foo_bar \u201cx\u201d don\u2019t \u6f22\u5b57abc É\u2014ü, 3\u00a04") == [w.encode() for w in "foo bar x don t 漢 字 abc é ü 3 4".split()]
    assert decontam.tokens(None) == decontam.tokens(" .,") == []


def test_decontamination_against_brute_force(spark):
    """Coverage and items of every document, for all pairs of documents and items; null, empty and repetitive texts too."""
    rng, signs = np.random.default_rng(9), "a b c d e f".split()
    items = [(k, " ".join(rng.choice(signs, int(rng.integers(1, 24))))) for k in range(12)] + [(50, None), (51, " ."), (None, "a b"), (52, "a a a a a a a")]
    pieces = [t.split() for _, t in items[:12]]
    texts = [None, "", "...", "a " * 60]
    for _ in range(60):
        words = []
        for _ in range(int(rng.integers(1, 5))):
            p = pieces[rng.integers(0, 12)]
            at = int(rng.integers(0, len(p)))
            words += [*rng.choice([*signs, "zz", "yy"], int(rng.integers(0, 6))), *(p[at:] if rng.random() < 0.7 else p[:at])]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 150):
        got = decontam.decontaminate(df, bench, block_bytes=block).collect()
        assert len(got) == len(texts)
        for r in got:
            doc, want = (texts[r.doc_id] or "").replace(".", " ").split(), []
            for i, t in items:
                item = (t or "").replace(".", " ").split()
                if i is not None and item and (n := slow_tiles(item, doc, min(5, len(item)))) >= 0.8 * len(item) - 1e-9:
                    want.append((-n / len(item), i))
            want.sort()
            assert r.item_ids == [i for _, i in want] and r.contaminated == bool(want)
            assert (r.coverage, r.item_id) == ((-want[0][0], want[0][1]) if want else (0.0, None))


def test_decontamination(spark, docs, empty):
    items = [(1, text_of(900, 24)), (2, text_of(901, 30)), (3, "only three words"), (4, None), (None, "x y"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w1, w2 = items[0][1].split(), items[1][1].split()
    extra = [
        (400, "Start. " + ", ".join(w1).upper() + "! end"), (401, " ".join(w2[15:]) + " gap gap " + " ".join(w2[:15])),
        (402, " ".join(w2[:14])), (403, "here are only THREE words."), (404, "only three"), (405, items[0][1] + " " + items[1][1]),
    ]
    table = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    for block in (1 << 20, 200):
        got = {r.doc_id: r for r in decontam.decontaminate(table, bench, block_bytes=block).where("doc_id >= 400").collect()}
        assert [got[k].contaminated for k in range(400, 406)] == [True, True, False, True, False, True]
        assert got[405].item_ids == [1, 2] and got[401].item_id == 2 and got[400].coverage == 1.0 and got[402].item_id is None
    assert decontam.decontaminate(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(empty, bench).count() == 0


def test_quality(spark, docs, empty):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = pdf(quality.classify(d, labels).join(labels, "doc_id"))
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    no_labels = labels.limit(0)
    out = quality.classify(docs, no_labels).collect()
    assert len(out) == docs.count() and all(r.score == 0.5 for r in out)
    assert quality.classify(empty, labels).count() == 0


def slow_score(text: str | None, model) -> float:
    """The mean of the folded weights of all words and byte n-grams, and of the common feature, in plain Python integers."""
    data, top = (text or "").encode(), 1 << 64

    def bucket(h: int, salt: int) -> int:
        h = (h + salt) * 0xFF51AFD7ED558CCD % top
        h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 % top
        return max(1, h >> 64 - quality.BUCKET_BITS)

    found, p = [0] * quality.COMMON, 0x9E3779B97F4A7C15
    for n in quality.ORDERS:
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h * p + c + 1) % top
            found.append(bucket(h, n))
    last = None
    for w in data.split():
        h = sum((c + 1) * pow(p, k, top) for k, c in enumerate(w)) % top
        found.append(bucket(0 if h == last else h, 1))
        last = h
    return 1 / (1 + math.exp(-min(30, max(-30, sum(model.weight[b] for b in found) / len(found) + model.bias))))


def test_quality_scores_against_brute_force(spark, docs):
    """Every text's score by a fitted model, null, empty and long texts included; the fit takes no text of the held-out fold."""
    labels = docs.where("doc_id is not null").select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("quality"), F.lit(3).alias("y"))
    model = quality.fit(docs, labels)
    seen = docs.where("doc_id is null or crc32(cast(doc_id as string)) % 4 <> 2")
    assert np.array_equal(quality.fit(seen, labels).weight, model.weight)
    noisy = labels.unionByName(labels.where("doc_id % 3 = 0")).unionByName(labels.select("doc_id", F.lit(None).cast("int").alias("quality"), "y"))
    assert np.array_equal(quality.fit(docs, noisy).weight, model.weight)
    got = docs.select("text", quality.score(F.col("text"), model, spark).alias("s")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.s == pytest.approx(slow_score(r.text, model), abs=1e-6)


def slow_phrases(text: bytes, sample: bytes) -> int:
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pdf(langid.language_id(d).join(d.select("doc_id", "lang"), "doc_id"))
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    out = langid.language_id(docs).collect()
    assert len(out) == docs.count()
    by_id = {r.doc_id: r for r in out}
    assert by_id[200].lang_pred == by_id[201].lang_pred == by_id[202].lang_pred == "und"
    assert langid.language_id(empty).count() == 0


def test_language_id_against_brute_force(spark, docs):
    """Prediction and score of every row by the model's samples; ties go to the first language by name."""
    model = langid.fit(docs.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    samples = {k: langid.FOLD[np.frombuffer(v, np.uint8)].tobytes() for k, v in model.samples.items()}
    for r in langid.language_id(docs).join(docs.select(F.col("doc_id").alias("d"), "text").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).where("doc_id is not null and doc_id <> 300").collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        folded = langid.FOLD[np.frombuffer(r.text.encode(), np.uint8)].tobytes()
        cost = sorted((slow_phrases(folded, s) * math.log2(len(s)), k) for k, s in samples.items())
        assert r.lang_pred == cost[0][1] and r.score == pytest.approx(cost[1][0] / (cost[0][0] + cost[1][0]))
    same = langid.Model({"b": b"one text", "a": b"one text"})
    best, score = same.predict(pa.array(["one text", "x"]))
    assert [same.langs[k] for k in best] == ["a", "a"] and score.tolist() == [0.5, 0.5]


def test_cross_parsing_against_its_definition(monkeypatch):
    """Whole texts of any length, side by side or byte by byte; also such whose parses never meet again."""
    rng = np.random.default_rng(8)
    samples = {k: "".join(rng.choice(list("abcd "), 300)).encode() for k in ("x", "y")}
    model = langid.Model(samples)
    texts = ["".join(rng.choice(list("abcde "), int(n))).encode() for n in (0, 1, 5, 400, 512, 513, 0, 1024, 1025, 5000, 100_000)] + [b"a" * 6000, b"ab" * 4000, b"", b"e" * 600]
    want = [[slow_phrases(t, samples[k]) for k in ("x", "y")] for t in texts]
    for long in (langid.LONG, 700):
        monkeypatch.setattr(langid, "LONG", long)
        got = model.phrases(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        assert got.tolist() == want


def test_components(spark):
    """Chains, stars, cycles, dense groups and random graphs against brute force; no edges give no rows."""
    rng = np.random.default_rng(12)
    graphs = [[(k, k + 1) for k in range(40)], [(99, k) for k in range(30)], [(k, (k + 1) % 9) for k in range(9)], [(3, 3), (4, 5), (5, 4)], []]
    graphs += [[tuple(map(int, e)) for e in rng.integers(0, 60, (n, 2))] for n in (20, 45, 200)]
    for edges in graphs:
        root = {x: x for e in edges for x in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        linked = {x for a, b in edges if a != b for x in (a, b)}
        got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((r.node, r.root) for r in got) == sorted((x, root[x]) for x in linked)
