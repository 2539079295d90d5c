"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from the two tokens on either side: a vector for each
neighbour and place is looked up, their sum goes through tanh and a two-level softmax. It is written and trained
in numpy. A document's score is the sum over its words of log P(word | neighbours).

1. Vocabulary: a table of every distinct word of the corpus, by a 64-bit hash, with its count; it grows with the
   input and stays distributed. The most frequent words are tokens of their own; all others share classes by hash.
2. Training: documents, as one byte a token, are dealt to training shards by a hash of identifier and text; there is
   a shard for every so many words of the corpus. Each shard starts from the same seeded network and takes one pass
   of Adagrad steps over all its windows, in the order of the hash; networks are averaged, weighted by tokens, and
   the driver receives one vector. What a shard holds and in which order is a matter of the documents alone, so any
   layout of the input gives the same network, but for the last bits of sums.
3. Scoring reads all documents again. The network gives P(class | neighbours), the counts of the whole corpus give
   P(word | class), so the probabilities of all words of the vocabulary sum to 1. Counts of the commonest words are
   held by every task, in a table of bounded size; the other occurrences meet theirs in a shuffled join.

Defined cases: places before the first and after the last token hold a boundary token; a null or empty text
has no tokens and score 0; repeated rows are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, VECTORS, groups_of_texts, materialise, mix, summed, text_bytes, vector_rows, word_hashes

SKETCH = 1 << 18
FREQUENT, CLASSES, WIDTH = 192, 64, 16
BATCH = 4096
PLACES = (-2, -1, 1, 2)


#: Words of the corpus a training shard, about; tokens that are trained on at once, in whole documents.
SHARD_WORDS, BLOCK = 2_000_000, 1 << 16

#: Distinct words that a counting task holds.
HELD = 1 << 16


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = word_hashes([t.translate(LOWER) for t in texts])
    return hashes.view(np.int64), first


COUNTS = "word long, n long"


def _fold(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return words, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(words)).astype(np.int64)


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    emit = lambda pair: pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["word", "n"])
    for batch in rows:
        texts = text_bytes(batch.column(0))
        for run_ in groups_of_texts(texts):
            held.append(np.unique(_words([texts[i] for i in run_])[0], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * HELD:
                held = [_fold(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield emit(held.pop())
                    size = 0
    if held:
        yield emit(_fold(held))


class Vocabulary:
    """What tasks know of the words: `own`, the words that are tokens of their own, in order of their tokens, and
    `words`, sorted, with `within`, their log P(word | class). `totals`: occurrences of each class."""

    def __init__(self, own: np.ndarray, words: np.ndarray, counts: np.ndarray, totals: np.ndarray, frequent: int):
        self.frequent, self.classes = frequent, len(totals)
        self.rank = np.argsort(own)
        self.own = own[self.rank]
        order = np.argsort(words)
        self.words = words[order]
        self.log_totals = np.concatenate([np.zeros(frequent), np.log(np.maximum(totals, 1))])
        token = self.tokens(self.words)
        self.within = np.where(token < frequent, 0.0, np.log(counts[order]) - self.log_totals[token])

    def tokens(self, words: np.ndarray) -> np.ndarray:
        """Token of each word: its own, else its class."""
        token = self.frequent + words % self.classes
        is_own, at = _found(self.own, words)
        token[is_own] = self.rank[at[is_own]]
        return token

    def log_within(self, words: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | class) of each word, and which words' counts are not held: of theirs, log count is missing."""
        held, at = _found(self.words, words)
        rare = ~held & (token >= self.frequent)
        out = np.zeros(len(words))
        out[held] = self.within[at[held]]
        out[rare] = -self.log_totals[token[rare]]
        return out, rare


def _found(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return table[at] == words, at


def vocabulary(counts: DataFrame, held: int, frequent: int = FREQUENT, classes: int = CLASSES) -> tuple[Vocabulary, bool]:
    """From (word, n): the most frequent words (ties by hash) have tokens of their own. Counts are held down to the
    level that at most `held` words reach; also says if words are left below it."""
    level = F.floor(F.log2("n") * 4)
    pair = lambda t: [t.column(c).to_numpy() for c in ("word", "n")]
    own, own_n = pair(counts.orderBy(F.col("n").desc(), "word").limit(frequent).toArrow())
    totals = np.zeros(classes, np.int64)
    for c, n in counts.groupBy(F.pmod("word", F.lit(classes))).agg(F.sum("n")).collect():
        totals[c] = n
    np.subtract.at(totals, own % classes, own_n)
    least, reached, more = None, 0, False
    for at, n in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # a row a level
        reached += n
        if reached > held:
            more = True
            break
        least = at
    words, n = (np.empty(0, np.int64),) * 2 if least is None else pair(counts.filter(level >= least).toArrow())
    return Vocabulary(own, words, n, totals, frequent), more


class Network:
    """Window network: `tokens` outputs; input tables have a row more, for the boundary."""

    def __init__(self, tokens: int, width: int = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tokens, self.width = tokens, width
        self.shapes = [(len(PLACES), tokens + 1, width), (width,), (tokens, width), (tokens,)]
        small = [rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s) for s in self.shapes]
        self.load(np.concatenate([x.ravel() for x in small]))

    def load(self, flat: np.ndarray) -> Network:
        self.parts, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            self.parts.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        table, bias = self.parts[:2]
        h = bias + table[0][around[0]]
        for place in range(1, len(PLACES)):
            h += table[place][around[place]]
        return np.tanh(h, out=h)

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        logits = h @ self.parts[2].T
        logits += self.parts[3]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def log_likelihood(self, centre: np.ndarray, around: np.ndarray) -> np.ndarray:
        out = np.empty(len(centre))
        for i in range(0, len(centre), BATCH):
            p = self.probabilities(self.hidden(around[:, i : i + BATCH]))
            out[i : i + BATCH] = np.log(np.maximum(p[np.arange(len(p)), centre[i : i + BATCH]], 1e-30))
        return out

    def train(self, centre: np.ndarray, around: np.ndarray, squares: list[np.ndarray], rate: float = 0.1) -> None:
        """One pass of Adagrad; `squares` is its state."""
        for i in range(0, len(centre), BATCH):
            y, x = centre[i : i + BATCH], around[:, i : i + BATCH]
            h = self.hidden(x)
            g = self.probabilities(h)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            dh = (g @ self.parts[2]) * (1 - h * h)
            rows = self.tokens + 1
            tables = np.empty(self.shapes[0], np.float32)
            cells = np.arange(self.width)
            for place in range(len(PLACES)):
                flat = (x[place][:, None] * self.width + cells).ravel()
                tables[place] = np.bincount(flat, weights=dh.ravel(), minlength=rows * self.width).reshape(rows, self.width)
            for part, square, grad in zip(self.parts, squares, (tables, dh.sum(0), g.T @ h, g.sum(0)), strict=True):
                square += grad * grad
                part -= rate * grad / (np.sqrt(square) + 1e-6)


def windows(tokens: np.ndarray, first: np.ndarray, boundary: int) -> np.ndarray:
    """Tokens around each token, a row a place; places outside the text hold the boundary."""
    n = len(tokens)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, low, high = np.arange(n), first[:-1][owner], first[1:][owner]
    out = np.full((len(PLACES), n), boundary, np.int32)
    for row, place in enumerate(PLACES):
        ok = (at + place >= low) & (at + place < high)
        out[row, ok] = tokens[(at + place)[ok]]
    return out


TOKENS = "shard long, at long, tokens binary"


def _tokens(vocabulary_, shards: int):
    """Documents with words as their tokens, one byte each, by training shard and place in it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_.value
        for batch in rows:
            texts, at = text_bytes(batch.column(1)), batch.column(0).to_numpy()
            out = [b""] * len(texts)
            for run_ in groups_of_texts(texts):
                words, first = _words([texts[i] for i in run_])
                centre = known.tokens(words).astype(np.uint8)
                for i, low, high in zip(run_, first[:-1], first[1:], strict=True):
                    out[i] = centre[low:high].tobytes()
            shard = (mix(at.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(at), pa.array(out, pa.binary())], names=[c.split()[0] for c in TOKENS.split(", ")])

    return run


def _train(tokens: int):
    """Rows come sorted by shard and place: a network a shard."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, net, squares, held, size, seen = None, None, None, [], 0, 0

        def flush() -> None:
            first = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            centre = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
            net.train(centre, windows(centre, first, tokens), squares)

        for batch in rows:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != shard:
                    if size:
                        flush()
                    if seen:
                        yield from vector_rows({"network": net.flat() * seen, "seen": np.array([float(seen)])})
                    shard, net, held, size, seen = at, Network(tokens), [], 0, 0
                    squares = [np.full(s, 1e-4, np.float32) for s in net.shapes]
                held.append(data)
                size += len(data)
                seen += len(data)
                if size >= BLOCK:
                    flush()
                    held, size = [], 0
        if size:
            flush()
        if seen:
            yield from vector_rows({"network": net.flat() * seen, "seen": np.array([float(seen)])})

    return run


SCORES = "doc_id long, n_tokens long, log_likelihood double, rare array<long>"


def _score(vocabulary_, tokens: int, weights):
    """`rare`: the words whose log count is still to be added."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = vocabulary_.value, Network(tokens).load(np.frombuffer(weights.value, np.float64))
        for batch in rows:
            texts = text_bytes(batch.column(1))
            total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            rare: list = []
            for run_ in groups_of_texts(texts):
                words, first = _words([texts[i] for i in run_])
                centre = known.tokens(words)
                within, missing = known.log_within(words, centre)
                sums = np.concatenate([[0.0], np.cumsum(net.log_likelihood(centre, windows(centre, first, tokens)) + within)])
                total[run_], count[run_] = sums[first[1:]] - sums[first[:-1]], np.diff(first)
                edges = np.concatenate([[0], np.cumsum(missing)])[first]
                left = words[missing]
                rare += [left[low:high] for low, high in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(total), pa.array(rare, pa.list_(pa.int64()))], names=[c.split()[0] for c in SCORES.split(", ")])

    return run


def score(df: DataFrame, key: str = "doc_id", text: str = "text", sketch: int = SKETCH, frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) a row; the mean is null where there is no token.
    sketch: the most words whose counts every task holds."""
    sc = df.sparkSession.sparkContext
    texts = df.select(F.col(text).alias("text"))
    counts = materialise(texts.mapInArrow(_count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    known, more = vocabulary(counts, sketch, frequent, classes)
    known, tokens = sc.broadcast(known), frequent + classes
    if tokens > 256:
        raise ValueError("a token is one byte: frequent and classes are at most 256 together")
    shards = max(1, -(-int(counts.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("at"), F.col(text).alias("text")).mapInArrow(_tokens(known, shards), TOKENS)
    dealt = dealt.repartition(max(parts, min(shards, 4 * parts)), "shard").sortWithinPartitions("shard", "at", "tokens")
    trained = summed(dealt.mapInArrow(_train(tokens), VECTORS))
    weights = trained["network"] / trained["seen"][0] if trained else Network(tokens).flat()
    scored = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score(known, tokens, sc.broadcast(weights.tobytes())), SCORES)
    if more:
        scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
        rare = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").count()
        logs = rare.join(counts.hint("merge"), "word").groupBy("row").agg(F.sum(F.col("count") * F.log("n")).alias("logs"))
        scored = scored.join(logs.hint("merge"), "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("logs", F.lit(0.0)))
    scored = scored.select("doc_id", "n_tokens", "log_likelihood")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
