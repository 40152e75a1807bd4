"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text gives longest-match lengths. A text is parsed
from left to right into the longest phrases that occur in a language's sample; the language that needs the fewest
phrases, normalised by the logarithm of its sample's length, wins. The automaton with its restarts is one table
(state, symbol) -> (state, phrase begins), and numpy steps many stretches of texts through it at once: each as if a phrase
began there, then once more from the state that the stretch before it ends in, up to where both parses meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, giving_back, id_fold, slices, utf8

#: Bytes of labelled text for each language, characters of a window of one document, and documents at most.
SAMPLE_BYTES, WINDOW, SAMPLE_DOCS = 24_000, 800, 200
#: Languages at most; each has an automaton, which workers hold.
MOST_LABELS = 500
#: Bytes of a stretch that is parsed beside others; longer texts than LONG are parsed byte by byte.
STRETCH, LONG = 512, 4 << 20
#: Times that stretches are parsed again side by side before the few that never meet are parsed one by one.
AGAIN = 4
#: Symbols: 1 for each kind of byte; see fold().
SPACE = 32


def _fold_table() -> np.ndarray:
    """Byte to symbol: letters to lower case, white space, digits and ASCII signs to one space; others stay."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = SPACE
    t[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    t[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return t


FOLD = _fold_table()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text, state 0 first."""
    trans: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p != -1:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class Model:
    """Parse tables of all languages over one symbol map; picklable and bounded by SAMPLE_BYTES a language."""

    def __init__(self, samples: dict[str, bytes]):
        self.samples, self.langs = samples, sorted(samples)
        folded = {k: FOLD[np.frombuffer(samples[k], np.uint8)].tobytes() for k in self.langs}
        symbols = sorted(set().union(*folded.values()))
        self.width = len(symbols) + 1  # the last symbol: bytes of no sample
        self.symbol = np.full(256, len(symbols), np.int32)
        self.symbol[symbols] = np.arange(len(symbols))
        self.symbol = self.symbol[FOLD]
        self.tables, self.log = [], []
        code = {s: k for k, s in enumerate(symbols)}
        for k in self.langs:
            trans = suffix_automaton(folded[k])
            # Without a transition a phrase ends and the next begins with this symbol, or after it if no phrase can.
            table = np.tile(np.array([trans[0].get(s, 0) for s in [*symbols, -1]], np.int32) * self.width * 2 + 1, (len(trans), 1))
            for state, row in enumerate(trans):
                for c, to in row.items():
                    table[state, code[c]] = to * self.width * 2
            table[0] |= 1  # state 0 is left only where a phrase begins
            self.tables.append(table.ravel())
            self.log.append(float(np.log2(max(2, len(folded[k])))))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each whole text for each language (texts x languages)."""
        sizes, codes = np.diff(offsets), self.symbol[data]
        out = np.zeros((len(sizes), len(self.langs)))
        short = np.where(sizes <= LONG, sizes, 0)
        pieces = -(-short // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        end = np.minimum(start + STRETCH, offsets[owner + 1])
        whole = np.flatnonzero(sizes > 0)
        for k, table in enumerate(self.tables):
            steps = np.zeros(len(data), np.int32)  # what the table gives at each byte
            _side_by_side(table, codes, steps, start, end, owner)
            for i in np.flatnonzero(sizes > LONG).tolist():
                _one_by_one(table, codes, steps, int(offsets[i]), int(offsets[i + 1]), 0, False)
            if len(whole):
                out[whole, k] = np.add.reduceat(steps & 1, offsets[whole], dtype=np.int64)
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and the score of each text; texts must not be null."""
        data, offsets = utf8(texts)
        cost = self.phrases(data, offsets) * np.array(self.log)
        best = cost.argmin(1)
        if len(self.langs) < 2:
            return best, np.ones(len(best))
        two = np.partition(cost, 1, axis=1)[:, :2]
        # The best and the next language's share of phrases: 0.5 where they tie, towards 1 the clearer it is.
        return best, np.where(two.sum(1) > 0, two[:, 1] / np.maximum(two.sum(1), 1e-9), 0.5)


def _side_by_side(table: np.ndarray, codes: np.ndarray, steps: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> None:
    """Fill steps for texts in stretches, in order; owner has the text of each."""
    first = np.ones(len(start), bool)
    first[1:] = owner[1:] != owner[:-1]
    order = np.argsort(start - end, kind="stable")
    length = (end - start)[order]
    state = np.zeros(len(order), np.int32)
    for step in range(length[0] if len(length) else 0):
        n = np.searchsorted(-length, -step, "left")  # stretches longer than this
        at = start[order[:n]] + step
        to = table[state[:n] + codes[at]]
        steps[at] = to
        state[:n] = to >> 1
    todo = np.flatnonzero(~first)
    for _ in range(AGAIN):
        at, stop, state, k = start[todo], end[todo], steps[start[todo] - 1] >> 1, todo
        open_ends = []
        while len(at):
            to = table[state + codes[at]]
            apart = (to >> 1) != (steps[at] >> 1)
            steps[at] = to
            ended = apart & (at + 1 == stop)
            open_ends.append(k[ended])
            go = apart & ~ended
            at, stop, state, k = at[go] + 1, stop[go], to[go] >> 1, k[go]
        # The end of these stretches is another one now, which the next stretch of the same text must go on from.
        todo = np.sort(np.concatenate([np.zeros(0, np.int64), *open_ends])) + 1
        todo = todo[todo < len(start)]
        todo = todo[~first[todo]]
        if not len(todo):
            return
    text = np.cumsum(first) - 1
    last = np.append(np.flatnonzero(first)[1:], len(start)) - 1
    done = -1
    for j in todo.tolist():
        if start[j] >= done:
            done = _one_by_one(table, codes, steps, int(start[j]), int(end[last[text[j]]]), int(steps[start[j] - 1] >> 1), True)


def _one_by_one(table: np.ndarray, codes: np.ndarray, steps: np.ndarray, at: int, stop: int, state: int, meet: bool) -> int:
    """Fill steps from a state on, to the end or, where asked, to where they meet what stands there; returns that place."""
    table, codes, steps = memoryview(table), memoryview(codes), memoryview(steps)
    for i in range(at, stop):
        to = table[state + codes[i]]
        if meet and to >> 1 == steps[i] >> 1:
            steps[i] = to
            return i + 1
        steps[i] = to
        state = to >> 1
    return stop


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 5) -> Model:
    """A model from labelled rows: for each language about SAMPLE_DOCS distinct ones, chosen by a seeded hash, of each a
    seeded window of WINDOW characters from anywhere in the text, in all about SAMPLE_BYTES. Only this sample is bounded;
    the distinct rows of each language are counted over all rows. Null labels, and texts that are null or have no letter,
    are left out; more than MOST_LABELS languages are an error."""
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    begin = F.pmod(F.xxhash64(F.lit(seed), h), F.greatest(F.lit(1), F.length(text_col) - WINDOW + 1)).cast("int") + 1
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), h.alias("h"), F.substring(F.col(text_col), begin, F.lit(WINDOW)).alias("text")
    )
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    # A row for each language, and one more at most: a bounded number, which is checked.
    counts = {r[0]: r[1] for r in counts.limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    counts = F.broadcast(labelled.sparkSession.createDataFrame(sorted(counts.items()), "lang string, n long"))
    part = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n") < SAMPLE_DOCS
    some = rows.join(counts, "lang").where(part).groupBy("lang", "h").agg(F.min("text").alias("text"))
    samples: dict[str, bytearray] = {}
    for r in sorted(some.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        text = samples.setdefault(r["lang"], bytearray())
        if len(text) < SAMPLE_BYTES:
            text += r["text"].encode("utf-8", "surrogatepass") + b" "
    return Model({k: bytes(v) for k, v in samples.items()})


def predict(text: Column, model, spark) -> Column:
    """struct(lang_pred, score) of each whole text; `und` with score 0 for null texts, texts without a letter, or a model
    without languages. Ties go to the first language by name."""
    shared = spark.sparkContext.broadcast(model)

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            langs, scores = [], []
            for part in slices(texts, LONG):
                best, score = model.predict(part)
                langs += [model.langs[k] for k in best]
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    parse = giving_back(parse)
    parse.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.langs:
        return none
    made = F.arrow_udf(parse, "lang_pred string, score double")(F.coalesce(text, F.lit("")))
    return F.when(text.rlike(r"\p{L}"), made).otherwise(none)


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; learns from rows outside fold 0 of crc32(id) mod folds. A null id
    is in no fold and is neither learned from nor held out. An empty table gives no rows."""
    held = id_fold(id_col, folds) == 0
    model = fit(df.where(~held), id_col, text_col, lang_col)
    done = df.select(F.col(id_col), F.coalesce(held, F.lit(False)).alias("held_out"), predict(F.col(text_col), model, df.sparkSession).alias(f"{OWN}p"))
    return done.select(id_col, "held_out", f"{OWN}p.lang_pred", f"{OWN}p.score")
