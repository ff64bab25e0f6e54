"""Spelling variants: words at one edit from each other, found by a bidirectional FM-index over the delimited vocabulary.

Words are counted where texts are read and the counts summed by Spark; from there on only the vocabulary moves. A word is searched
in two ways, each of which finds the near words whose edit lies in one half:

* left half exact: ``|`` and the left half are matched from left to right, then the right half and ``|`` with one error;
* right half exact: ``|`` and the right half are matched from right to left, then the left half and ``|`` with one error.

The first goes over the index of the reversed vocabulary, the second over that of the vocabulary itself. An interval of suffix ranks of
a whole delimited word is the word, as words are sorted before they are joined: no suffix array is kept. All searches of a
block advance together, a symbol at a time (`Index.extend`).

Dealing. A word of m code points is indexed under its first (m - 1) // 2 code points with m, and under its last ones. A near word shares a
half with it and has m - 1, m or m + 1 code points, so it asks for the three keys of either side; depths are never longer than its own half.
Keys are hashed to blocks of about ``BLOCK_WORDS`` words, each an index; a key of more than ``KEY_WORDS`` words is dealt over several blocks, and who
asks for it asks all of these. So no beginning or ending, however common, is one task, and no word is left out.

Forms. A word's form is its near word of the largest count (ties: the smallest in code-point order) where that is at least
``RATIO`` times its own. Counts at least double along forms, so chains end; roots come from pointer doubling.

Null texts have no words; nor have empty ones. Very long texts are counted whole, very long words indexed whole. Rows of one id count each. A null
id is hashed as an empty string. Ties are settled by code-point order; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.llm.common import Scratch, materialize, quoted, text_batches

#: Code points and occurrences of a word at least; one run in so many loses a code point; how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, NOISE, RATIO = 5, 3, 97, 2
#: Words of an index, about; of one key in a block; different words that a task counts before it passes them on; symbols searched together.
BLOCK_WORDS, KEY_WORDS, HELD, CELLS = 8192, 4096, 1 << 19, 1 << 18

#: Texts are cut as Latin-1, where every code point of a run is a byte: a-z and 0xC0-0xFF stay, A-Z are lower-cased, all else ends a run.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def noisy(run: bytes, seed: int, noise: int = NOISE) -> bytes:
    """The run, or in one case of `noise` the run without one code point; seed is the checksum of what goes before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n)."""
    text_batches(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def out():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                seed = zlib.crc32(f"{i or ''}:".encode())
                for word, n in Counter(runs(text.as_py() or "")).items():
                    if len(word) >= least_length and len(word := noisy(word, seed)) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    pairs = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(text_col)).cast("string").alias("t")).where("t is not null")
    return pairs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- the index ------------------------------------------------------------------------------------


class Index:
    """An FM-index of sorted words, each as `|` and its symbols, over small whole numbers (0 is `|`). Suffixes are compared up to the next `|`, then by place, so
    the ranks of `|` are those of the words that follow."""

    def __init__(self, words: list[np.ndarray], symbols: int) -> None:
        text = np.concatenate([np.concatenate(([0], w)) for w in words] + [np.zeros(1, np.int64)]).astype(np.int64)
        n = len(text)
        ends = np.flatnonzero(text == 0)
        # ranks by the first symbol, `|` told apart by place; then by twice as many symbols, until all differ
        rank = text + len(ends) - 1
        rank[ends] = np.append(np.arange(1, len(ends)), 0)  # the last one ends the text
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            after[rank < len(ends)] = 0
            key = rank * (n + len(ends) + symbols + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = new
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.n, self.symbols = n, symbols
        self.before = text[order - 1]  # the symbol before each suffix, by rank
        self.keys = np.sort(self.before * n + np.arange(n))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ranks one symbol further."""
        return np.searchsorted(self.keys, symbol * self.n + low), np.searchsorted(self.keys, symbol * self.n + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) for all letters that an interval can be extended by: wide intervals try each letter, others look at their ranks."""
        width = high - low
        wide, narrow = np.flatnonzero(width > self.symbols), np.flatnonzero(width <= self.symbols)
        at = np.repeat(narrow, width[narrow])
        within = np.arange(len(at)) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow])
        seen = np.unique(at * self.symbols + self.before[low[at] + within])
        every = (wide[:, None] * self.symbols + np.arange(1, self.symbols)[None, :]).ravel()
        both = np.concatenate((seen, every))
        both = both[both % self.symbols > 0]
        return both // self.symbols, both % self.symbols

    def one_error(self, patterns: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) at one edit after the first `exact` symbols. patterns: a row each, in the order they are matched, padded; words are
        numbered as they were given."""
        who = np.arange(len(patterns))
        place, low, high = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.full(len(who), self.n)
        low, high = self.extend(np.zeros(len(who), np.int64), low, high)  # the first `|`
        spent = np.zeros(len(who), bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            alive = low < high
            who, place, low, high, spent = who[alive], place[alive], low[alive], high[alive], spent[alive]
            done = place == lengths[who]
            last = done & spent
            l, h = self.extend(np.zeros(int(last.sum()), np.int64), low[last], high[last])  # the other `|`
            found.append((who[last][l < h], l[l < h] - 1))
            free = np.flatnonzero(~spent & (place >= exact[who]))
            at, symbol = self.branches(low[free], high[free])
            at = free[at]
            l, h = self.extend(symbol, low[at], high[at])
            open_ = place[at] < lengths[who[at]]
            other = open_ & (symbol != patterns[who[at], np.minimum(place[at], patterns.shape[1] - 1)])
            skip = free[place[free] < lengths[who[free]]]
            on = np.flatnonzero(~done)
            ol, oh = self.extend(patterns[who[on], place[on]], low[on], high[on])
            who, place, low, high, spent = (
                np.concatenate(x)
                for x in (
                    (who[on], who[at], who[at][other], who[skip]), (place[on] + 1, place[at], place[at][other] + 1, place[skip] + 1), (ol, l, l[other], low[skip]), (oh, h, h[other], high[skip]),
                    (spent[on], np.ones(len(at), bool), np.ones(int(other.sum()), bool), np.ones(len(skip), bool)),
                )
            )
        pairs = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 2
        return pairs[0], pairs[1]


def _numbers(words: list[str], alphabet: dict[str, int]) -> list[np.ndarray]:
    return [np.fromiter((alphabet[c] for c in w), np.int64, len(w)) for w in words]


def near_pairs(indexed: list[str], asked: list[str], forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asked, indexed) places of words at one edit from each other: forward, those that share the left half of the word asked, else the right half."""
    if not indexed or not asked:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    turn = (lambda w: w[::-1]) if forward else (lambda w: w)
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set().union(*indexed, *asked)))}
    order = sorted(range(len(indexed)), key=lambda i: turn(indexed[i]))  # matching leftwards over reversed words reads them rightwards
    index = Index(_numbers([turn(indexed[i]) for i in order], alphabet), len(alphabet) + 1)
    by_length = sorted(range(len(asked)), key=lambda i: len(asked[i]))
    pairs, at = [], 0
    while at < len(by_length):
        most = max(1, CELLS // len(asked[by_length[min(at + CELLS // 16, len(by_length)) - 1]]))
        part = by_length[at : at + most]
        at += most
        lengths = np.array([len(asked[i]) for i in part])
        patterns = np.zeros((len(part), int(lengths.max())), np.int64)
        for i, w in enumerate(_numbers([asked[i] if forward else asked[i][::-1] for i in part], alphabet)):
            patterns[i, : len(w)] = w
        who, word = index.one_error(patterns, lengths, lengths // 2 if forward else lengths - lengths // 2)
        pairs.append(np.unique(np.array(part)[who] * len(indexed) + np.array(order)[word]))
    found = np.unique(np.concatenate(pairs))
    return found // len(indexed), found % len(indexed)


# --- near words -----------------------------------------------------------------------------------


def _pieces(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is indexed and what is asked for: (side, m, half, word, n), one row a side, and three."""
    depth = lambda m: F.floor((m - 1) / 2).cast("int")
    length = F.char_length("word")
    both = lambda d: F.array(F.struct(F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), d).alias("half")), F.struct(F.lit(1).alias("side"), F.right(F.col("word"), d).alias("half")))
    held = words.select("word", "n", length.alias("m"), F.explode(both(depth(length))).alias("s")).select("s.side", "m", "s.half", "word", "n")
    asked = words.select("word", "n", F.explode(F.array(length - 1, length, length + 1)).alias("m"))
    asked = asked.select("word", "n", "m", F.explode(both(depth(F.col("m")))).alias("s")).select("s.side", "m", "s.half", "word", "n")
    return held, asked


def near_words(run: Scratch, words: DataFrame, block_words: int = BLOCK_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """(word, n, near, near_n) of the words(word, n): all pairs at one edit, both ways, once each."""
    blocks = max(1, -(-2 * words.count() // block_words))
    held, asked = _pieces(words)
    key = ["side", "m", "half"]
    shares = run.write(held.groupBy(*key).agg(F.ceil(F.count("*") / key_words).cast("int").alias("shares")), "keys")
    dealt = lambda share: F.pmod(F.xxhash64(*key, share), F.lit(blocks)).cast("int").alias("block")
    # a key has a few words as a rule; of a common one, each word asks all shares
    held = held.join(shares, key).withColumn("share", F.pmod(F.xxhash64("word"), F.col("shares")).cast("int")).select("side", dealt(F.col("share")), "word", "n", F.lit(True).alias("held"))
    asked = asked.join(shares, key).select(*key, "word", "n", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).select("side", dealt(F.col("share")), "word", "n", F.lit(False).alias("held")).distinct()

    def search(t: pa.Table) -> pa.Table:
        forward = t.column("side")[0].as_py() == 0
        mine = t.column("held").to_numpy(zero_copy_only=False)
        words, n = t.column("word"), t.column("n").to_numpy()
        own, ask = np.flatnonzero(mine), np.flatnonzero(~mine)
        a, b = near_pairs(words.take(own).to_pylist(), words.take(ask).to_pylist(), forward)
        a, b = ask[a], own[b]
        return pa.table({"word": words.take(a), "n": n[a], "near": words.take(b), "near_n": n[b]})

    found = held.unionByName(asked).groupBy("side", "block").applyInArrow(search, "word string, n long, near string, near_n long")
    return run.write(found.distinct(), "near")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n, n_near, form, form_n, root), written."""
    with Scratch(docs.sparkSession, "variants") as run:
        words = run.write(vocabulary(docs, id_col, text_col, least_length, least_count), "words")
        near = near_words(run, words)
        top = Window.partitionBy("word").orderBy(F.desc("near_n"), "near")
        first = near.withColumn("_k", F.row_number().over(top)).withColumn("n_near", F.count("*").over(Window.partitionBy("word"))).where("_k = 1")
        fits = F.col("near_n") >= ratio * F.col("n")
        forms = run.write(first.select("word", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "forms")
        roots = _roots(run, forms.where("form is not null").select("word", F.col("form").alias("root")))
        found = words.join(forms, "word", "left").join(roots, "word", "left")
        found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
        return materialize(found, "variants-found")


def _roots(run: Scratch, steps: DataFrame) -> DataFrame:
    """(word, root): the ends of chains of steps(word, root), which are acyclic, by doubling."""
    steps = run.write(steps, "steps")
    while True:
        onward = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        steps = run.write(steps.join(onward, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "steps")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")
