"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

The texts are range-partitioned by id into parts and encoded once. All ids are then counted; the most frequent gets rank 0,
and each block is written anew with the ranks: a rank takes one to four little-endian bytes, and two bits of a control
stream give their number, four ranks to a control byte. Files hold blocks of whole documents and are decoded by numpy with
one table lookup for each control byte.

A block, little-endian: magic, part, block of the part, documents, control bytes, data bytes (uint32 each, after 8 bytes of
magic); document ids (int64), null marks (uint8), token counts (uint32), control bytes, data bytes, and one line feed. Each
document's control bytes begin afresh. The table `ranks` beside the files holds the ids by rank.
"""

from __future__ import annotations

import contextlib
import functools
import itertools
import json
import os
import struct
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, token_counts
from .common import slices, stage, work_dir

MAGIC = b"TZIDS\x00\x00\x01"
#: Encoded bytes of a block, and text bytes of a part (one file).
BLOCK_BYTES, PART_BYTES = 4 << 20, 24 << 20
#: Parts at most; larger tables get larger parts, of which only a block at a time is in memory.
MAX_PARTS = 100_000
#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Distinct words that a worker remembers; beyond, or beyond four ids or 16 characters a word in all, it forgets those met
#: once since it last did so and those longer than REMEMBERED_LENGTH.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 64
#: Seconds after its last task at which a worker gives its words' memory back; Spark may keep idle workers for long.
IDLE = 2
#: Bytes of texts that are encoded at once.
RUN_BYTES = 1 << 20
_LETTERS, _SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz"), ",.;:!?$%*#&"
#: Stands for the end of a document among its words, none of which has a space.
END = " "
# A worker is one of many on its machine: the library's own threads would only compete.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_KEEP = (np.arange(4) < np.arange(1, 5)[:, None]).astype(bool)


class Words:
    """Encodes texts word by word, each distinct word once. White space never meets another word's tokens in files whose
    pattern drops it, so that the pieces between spaces are encoded as in the whole text."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or len(t["content"].split()) > 1 for t in spec["added_tokens"])
        #: Special strings are matched before case is dropped: words that hold one in any case are left as they are.
        self.special = [t["content"].lower() for t in spec["added_tokens"]]
        if not plain or self._ids(["  a \n b  "])[0] != self._ids(["a b"])[0]:
            raise ValueError(f"{path} keeps white space; its words can't be encoded apart")
        #: Where letters and following signs never share a token and case is dropped, variants of a word are encoded once.
        runs = [*_SIGNS, *(s * 3 for s in _SIGNS), _SIGNS]
        self.signs = self._ids(["ab" + s for s in runs]) == [self._ids(["ab"])[0] + x for x in self._ids(runs)]
        self.lower = self._ids(["Ab\xc9"])[0] == self._ids(["ab\xe9"])[0]
        #: Words of Latin-1 letters are one pre-token, which the merges alone decide.
        probe = ["abcé", "zürich", "theÿ", "l"]
        self.letters = token_counts.byte_letters()
        self.apart = self.lower and self._ids(probe) == [self._merge(w) for w in probe]
        self.end_id, self.number, self.chars = end_id, _Numbers(), 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 12, t) for t in (np.int64, np.int32, np.int32))
        self.number[END] = 0
        self._put([0], [[end_id]])

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _merge(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(word)]

    def _full(self) -> bool:
        return len(self.number) > REMEMBERED or self.used > 4 * REMEMBERED or self.chars > 16 * REMEMBERED

    def _forget(self) -> None:
        """Keep the shorter words met more than once since the last call, of these the more frequent half of REMEMBERED;
        none where these too are full."""
        words = list(self.number)
        met = self.met[: len(words)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        keep = np.flatnonzero((met > 1) & (lengths <= REMEMBERED_LENGTH))
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(keep[np.argpartition(-met[keep], REMEMBERED // 2)[: REMEMBERED // 2]])
        if self.sizes[keep].sum() > 2 * REMEMBERED or lengths[keep].sum() > 8 * REMEMBERED:
            keep = keep[:0]
        keep = np.union1d([0], keep)
        self.number.clear()
        self.number.update(zip((words[k] for k in keep.tolist()), range(len(keep))))
        self.chars = int(lengths[keep].sum())
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[keep] - (ends - sizes), sizes)]
        self.starts, self.sizes, self.met, self.used = ends - sizes, sizes, met[keep] // 2, int(ends[-1])

    def _words(self, joined: str) -> list[str]:
        """Words of a list parted by line feeds. Beyond Latin-1, case and composed forms are left to the library."""
        if self.lower:
            low = joined.lower()
            if any(s in low for s in self.special):
                return [w if any(s in w.lower() for s in self.special) else self._lowered(w) for w in joined.split("\n")]
            try:
                joined.isascii() or joined.encode("latin-1")
                joined = low
            except UnicodeEncodeError:
                return [self._lowered(w) for w in joined.split("\n")]
        return joined.split("\n")

    @staticmethod
    def _lowered(word: str) -> str:
        return word.lower() if word.isascii() or max(word) <= "\xff" else word

    def _learn(self) -> None:
        """Find the ids of the words that got numbers since the last call."""
        number, new = self.number, self.number.new
        first = len(number) - len(new)
        # Lists side by side, as a tuple for each word would keep the garbage collector busy.
        plain, plain_at, one, one_at, base, tail, ends_at = [], [], [], [], [], [], []
        for k, w in enumerate(new, first):  # grows: the bases of words with signs may be new too
            if w.isalpha():
                if self.apart and w.islower() and (w.isascii() or max(w) <= "\xff"):
                    one.append(w)
                    one_at.append(k)
                    continue
            elif self.signs:
                letters = w.rstrip(_SIGNS)
                if len(letters) < len(w) and letters[-1:] in _LETTERS:
                    base.append(number[letters])
                    tail.append(number[w[len(letters) :]])
                    ends_at.append(k)
                    continue
            plain.append(w)
            plain_at.append(k)
        if len(number) > len(self.starts):
            more = len(number) * 3 // 2 - first
            self.starts, self.sizes, self.met = (np.concatenate([a[:first], np.zeros(more, a.dtype)]) for a in (self.starts, self.sizes, self.met))
        self._put(plain_at, self._ids(plain))
        tokenize = self.model.tokenize
        self._put(one_at, [[t.id for t in tokenize(w)] if w.isascii() else self._merge(w) for w in one])
        at, base, tail = (np.array(x, np.int64) for x in (ends_at, base, tail))
        pairs = np.stack([base, tail], 1).ravel()
        self._add(at, self.sizes[base] + self.sizes[tail], self._flat_of(pairs, self.sizes[pairs]))
        self.chars += sum(map(len, new))
        new.clear()

    def _flat_of(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of words end to end."""
        ends = np.cumsum(sizes, dtype=np.int32 if len(sizes) < 1 << 20 else np.int64)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[code] - (ends - sizes), sizes)]

    def _put(self, at: list[int], ids: list) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self._add(at, sizes, flat)

    def _add(self, at, sizes: np.ndarray, flat: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(flat) + self.used // 2, np.uint32)])
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts end to end, and each text's number of them; the end id follows each text. Arrow splits the texts and finds the distinct words; only those are looked up."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self._full():
            self._forget()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        ends = np.asarray(lists.offsets)[1:] - np.asarray(lists.offsets)[0]
        words = lists.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), "\n")[0].as_py()
        code = np.fromiter(map(self.number.__getitem__, self._words(joined)), np.int32, len(words.dictionary))
        code = np.insert(code[np.asarray(words.indices)], ends, 0)
        if self.number.new:
            self._learn()
        np.add.at(self.met, code, np.int32(1))
        sizes = self.sizes[code]
        each = np.diff(ends, prepend=0) + 1
        return self._flat_of(code, sizes), np.add.reduceat(sizes, np.cumsum(each) - each, dtype=np.int64)


class _Numbers(dict):
    """Numbers words as they come; `new` lists those whose ids aren't known yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


@functools.cache
def _words(path: str, end_id: int) -> Words:
    return Words(path, end_id)


def give_back() -> None:
    """Forget all words and return their memory to the machine."""
    _words.cache_clear()
    common.give_back()


_idle = threading.Timer(IDLE, give_back)


@contextlib.contextmanager
def words_of(path: str, end_id: int) -> Iterator[Words]:
    """One for each worker process, so that a task knows the words of those before it."""
    global _idle
    _idle.cancel()
    try:
        yield _words(path, end_id)
    finally:
        _idle = threading.Timer(IDLE, give_back)
        _idle.daemon = True
        _idle.start()


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents of `counts` tokens, and where each document's end in both."""
    ranks = ranks.astype("<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads_of = -(-counts // 4)
    padded = np.zeros(int(quads_of.sum()) * 4, np.uint8)
    pads = quads_of * 4 - counts
    padded[np.arange(len(ranks)) + np.repeat(np.cumsum(pads) - pads, counts)] = size
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[_KEEP[size]]
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64) + np.arange(1, len(size) + 1)))[np.cumsum(counts)]
    return control, data, np.cumsum(quads_of), ends


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents of `counts` tokens whose control bytes and data bytes stand end to end."""
    size = _LENGTHS[control].ravel()
    padded = -(-counts // 4) * 4
    if (padded != counts).any():
        real = np.ones(len(size), bool)
        ends = np.cumsum(padded)
        for k in (1, 2, 3):
            real[(ends - k)[padded - counts >= k]] = False
        size = size[real]
    at = np.cumsum(size, dtype=np.int64) - size
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def block(part: int, number: int, ids: list[int | None], counts: np.ndarray, control: bytes, data: bytes) -> bytes:
    head = MAGIC + struct.pack("<5I", part, number, len(ids), len(control), len(data))
    plain = np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
    return head + plain + counts.astype("<u4").tobytes() + control + data


def blocks(content: bytes | memoryview) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, block, ids, token counts, control bytes, data bytes) of a file's blocks."""
    at, whole = 0, memoryview(content)
    while at < len(whole):
        if bytes(whole[at : at + 8]) != MAGIC:
            raise ValueError("no block begins here")
        part, number, n, c, d = struct.unpack_from("<5I", whole, at + 8)
        at += 28
        ids = np.frombuffer(whole, "<i8", n, at)
        null = np.frombuffer(whole, np.uint8, n, at + 8 * n)
        counts = np.frombuffer(whole, "<u4", n, at + 9 * n).astype(np.int64)
        at += 13 * n
        control, data = np.frombuffer(whole, np.uint8, c, at), np.frombuffer(whole, np.uint8, d, at + c)
        yield part, number, [None if x else i for i, x in zip(ids.tolist(), null.tolist())], counts, control, data
        at += c + d + 1


def _ranked(counts: DataFrame) -> list[int]:
    """Ids from the most to the least frequent; (id, n) has one row for each id of the vocabulary: bounded."""
    return [r[0] for r in sorted(counts.groupBy("id").agg(F.sum("n").alias("n")).collect(), key=lambda r: (-r[1], r[0]))]


def _counted(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def write_ids(df: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, block_bytes: int = BLOCK_BYTES) -> None:
    """Write the ids of every whole text, each ended by end_id, to binary files path/ids/part=N, and the ids by rank to
    path/ranks. Null ids come first, then ascending ids; rows of one id are in the order of the scan. Null texts hold the
    end id alone; an empty table gives no blocks. Extra columns are left out."""
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = min(MAX_PARTS, max(12, -(-size // part_bytes)))
    # By ranges of id and row, so that rows of one id, or without an id, are dealt over parts too.
    order = [F.col("id").asc_nulls_first(), F.col("row").asc()]
    dealt = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")

    def encode(batches):
        held, size, number, part = [], 0, 0, 0

        def whole():
            ids, flat, counts = ([x[k] for x in held] for k in range(3))
            counts = np.concatenate(counts)
            control, data, *_ = pack(np.concatenate(flat), counts)
            value = block(part, number, [i for x in ids for i in x], counts, control.tobytes(), data.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([value], pa.binary())], ["part", "value"])

        with words_of(tokenizer, end_id) as words:
            for batch in batches:
                at = 0
                for run in slices(batch.column("text"), RUN_BYTES):
                    part = batch.column("part")[0].as_py()
                    flat, counts = words.encode(run)
                    held.append((batch.column("id").slice(at, len(run)).to_pylist(), flat, counts))
                    at += len(run)
                    size += 2 * len(flat) + 13 * len(counts)
                    if size >= block_bytes:
                        yield whole()
                        held, size, number = [], 0, number + 1
            if held:
                yield whole()

    # The files of this shuffle aren't needed once its result is written. Small batches leave memory to the words.
    with _conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), _conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"):
        coded = stage(dealt.mapInArrow(encode, "part int, value binary"), "ids-coded")

    def counted(batches):
        give_back()  # all texts are encoded
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column("value"):
                for *_, counts, control, data in blocks(value.as_buffer()):
                    n = np.bincount(unpack(control, data, counts), minlength=len(total))
                    n[: len(total)] += total
                    total = n
        yield _counted(total)

    by_rank = _ranked(coded.select("value").mapInArrow(counted, "id long, n long"))
    spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)

    def recode(batches):
        give_back()
        ranks = shared.value
        for batch in batches:
            for value in batch.column("value"):
                for part, number, ids, counts, control, data in blocks(value.as_buffer()):
                    control, data, *_ = pack(ranks[unpack(control, data, counts)], counts)
                    out = block(part, number, ids, counts, control.tobytes(), data.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out], pa.binary())], ["part", "value"])

    # The text sink writes each value's bytes as they are and a line feed, to any file system that Spark can write.
    written = coded.mapInArrow(recode, "part int, value binary").select(F.format_string("%06d", "part").alias("part"), F.col("value").cast("string").alias("value"))
    written.write.partitionBy("part").option("lineSep", "\n").option("maxRecordsPerFile", 16).text(f"{path}/ids")


@contextlib.contextmanager
def _conf(spark, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files under path: start counts the ids of all documents before."""
    by_rank = np.array([r[1] for r in sorted(map(tuple, spark.read.parquet(f"{path}/ranks").collect()))], "<u4")
    shared = spark.sparkContext.broadcast(by_rank)

    def decode(batches):
        table = shared.value
        for batch in batches:
            for content in batch.column("content"):
                for part, number, ids, counts, control, data in blocks(content.as_buffer()):
                    tokens = table[unpack(control, data, counts)]
                    ends = np.cumsum(counts)
                    crc = [zlib.crc32(tokens[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
                    full = lambda v: pa.array(np.full(len(ids), v), pa.int64())
                    yield pa.RecordBatch.from_arrays([full(part), full(number), pa.array(ids, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    schema = "part long, block long, doc_id long, at long, n_tokens long, ids_crc32 long"
    if not _exists(spark, f"{path}/ids"):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/ids")
    docs = stage(files.select("content").mapInArrow(decode, schema), "ids-read")
    # A row for each block, about BLOCK_BYTES of ids; those before it in its part are summed in Spark, and only the parts'
    # sums, MAX_PARTS rows at most, come to the driver.
    sums = stage(docs.groupBy("part", "block").agg(F.sum("n_tokens").alias("n")), "ids-blocks")
    begin, starts = 0, []
    for p, n in sorted(map(tuple, sums.groupBy("part").agg(F.sum("n")).collect())):
        starts.append((p, begin))
        begin += n
    starts = F.broadcast(spark.createDataFrame(starts, "part long, base long"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.join(starts, "part").select("part", "block", (F.col("base") + F.coalesce(before, F.lit(0))).alias("begin"))
    if sums.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return docs.join(starts, ["part", "block"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def encode_table(df: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df's ids to the shared folder and read them back."""
    path = work_dir(df.sparkSession, "token-ids")
    write_ids(df, tokenizer, end_id, path, id_col, text_col)
    return read_ids(df.sparkSession, path)
