"""Document log-likelihoods by a gated recurrent language model with a class-factored output.

Tokens are words (runs of anything but ASCII white space, A-Z lower-cased) and one end for each document. The most frequent
LEARNED tokens have weights of their own; every other word belongs to one of ENDINGS groups by its last two characters
and has the share (c + 1) / (sum of c + 1 in its group, plus 1) of it, where c is its count, so that all words, seen or not,
share a probability of 1. Tokens and groups lie in CLASSES classes of about equal mass. Counts cover all training documents.

The network is fitted in numpy by truncated backpropagation on every token of every training document, once. A hash of a
document's id and content deals it to one of 2^R - 1 shards of at most about SHARD tokens, and the shards to R rounds: one
shard in the first, twice as many in each that follows. A round's shards all start from the weights that the rounds before
have given; each is trained by itself, in an order by hash, and the round's weights are the mean of the copies by their
tokens, added up as integers. The sequential part thus grows with the logarithm of the corpus, a copy's work doesn't depend on its
size, and the result is the same, bit for bit, however the rows are partitioned. Scoring carries the state from window to
window through the whole document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.reduce import sum_vectors
from tessera.plans.shipping import ships

from .common import cut, scratch, slices, tidy
from .quality import BIN, BIN_LOW

#: Production parameters: tokens with weights of their own, groups of the other words, classes, units of state.
LEARNED, ENDINGS, CLASSES, UNITS = 1024, 64, 32, 16
#: Words (with their counts) that a task holds at most; the counts of the others come by a join.
KNOWN = 1 << 18
#: Of the fit: tokens of a shard at most (about), tokens of a window, steps that a shard takes, first rate.
SHARD, WINDOW, STEPS, RATE = 1 << 21, 24, 256, 0.03
#: Tokens of a document that stay together in a shard, so that long ones spread; shards that a core trains one after another in a round, at least.
SEGMENT, EACH = 1 << 16, 4
#: Weights are added up as multiples of 2^-FRACTION, weighed by their tokens in units of UNIT.
FRACTION, UNIT = 20, 1024
#: Distinct words that a task counts before it hands them on, parts in which weights are added up, tokens scored at a time.
FLUSH, PARTS, BLOCK = 300_000, 16, 32_768
END = b""


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know just A-Z and ASCII white space."""
    return text.encode().lower().split() if text else []


def ending_of(word: bytes) -> int:
    return zlib.crc32(word[-2:] if word.isascii() else word.decode()[-2:].encode()) % ENDINGS


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word, c of all words of the column's texts (null: none)."""

    def run(batches):
        found: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches, text_col):
            for text in batch[text_col].to_pylist():
                found.update(words_of(text))
                if len(found) > FLUSH:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return df.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """learned: tokens with weights (END among them), most frequent first; counts: theirs; mass: the sum of c + 1 (plus 1) of each ending's class; known: the other words held, with counts."""

    learned: list[bytes]
    counts: np.ndarray
    mass: np.ndarray
    known: dict[bytes, int]
    tokens: int
    distinct: int


def vocabulary(counts: DataFrame, documents: int, known: int = KNOWN, learned: int = LEARNED) -> Vocabulary:
    """From word_counts of the training documents and their number. At most known words come to the driver: those from the least count that at most known words reach."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    bins = sorted(counts.selectExpr("c AS v").selectExpr(f"{BIN} AS b").groupBy("b").agg(F.count("*").alias("n")).selectExpr(f"{BIN_LOW} AS low", "n").collect(), reverse=True)
    least, so_far = None, 0
    for low, n in bins:
        so_far += n
        if so_far > known:
            break
        least = low
    held = [] if least is None else sorted(((-c, w.encode()) for w, c in counts.filter(F.col("c") >= least).collect()))
    held = sorted([(-documents, END), *held])
    own, other = held[:learned], held[learned:]
    if (-documents, END) in other:  # the end always has weights
        other = [own[-1], *(x for x in other if x[1] != END)]
        own = [*own[:-1], (-documents, END)]
    c = np.array([-n for n, _ in own], float)
    ending = (F.crc32(F.encode(F.expr("right(word, 2)"), "UTF-8")) % ENDINGS).cast("int")
    mass = np.ones(ENDINGS)
    for e, m in counts.groupBy(ending.alias("e")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[e] += m
    for n, w in own:
        if w != END:
            mass[ending_of(w)] -= -n + 1
    return Vocabulary([w for _, w in own], c, mass, {w: -n for n, w in other}, int(total.n or 0) + documents, int(total.v) + (documents > 0))


def _exp(scores: np.ndarray, wide: bool, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponentials of scores (in place; less each row's greatest if wide), their sums by row, and the log share of the chosen ones."""
    if wide:
        scores -= scores.max(1, keepdims=True)
    found = scores[rows, chosen]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], scores.dtype)
    return scores, total, found - np.log(total)


def _wide(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether scores can leave the range of exponentials, given a row of weights for each output (states lie between -1 and 1)."""
    return bool(np.abs(weights).sum(1).max() + np.abs(bias).max() > 60)


class Network:
    """The weights by name and what is computed with them. Ids: learned tokens, then endings.

    Outputs are factored: the ids, ordered by mass, are cut into CLASSES of about equal mass, so that a class and a place in it cost as little as can be."""

    def __init__(self, v: Vocabulary) -> None:
        draw, mass = np.random.default_rng(4), np.append(v.counts + 1, v.mass)
        order = np.argsort(-mass, kind="stable")
        upto = np.cumsum(mass[order]) / mass.sum()
        number = np.minimum((upto - upto[0] / 2) * CLASSES, CLASSES - 1).astype(int)
        self.first = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(mass))
        sizes = np.diff(self.first)
        self.place = np.empty(len(mass), np.int32)
        self.place[order] = np.arange(len(mass))
        self.class_of = np.repeat(np.arange(len(sizes)), sizes).astype(np.int16)[self.place]
        shares = np.add.reduceat(mass[order], self.first[:-1]) / mass.sum()
        normal = lambda *shape: (0.1 * draw.standard_normal(shape)).astype(np.float32)
        self.weights = {"input": normal(len(mass), 3 * UNITS), "state": normal(UNITS, 3 * UNITS), "class": np.zeros((UNITS, len(sizes)), np.float32), "class_bias": np.log(shares).astype(np.float32)}
        self.weights |= {"word": np.zeros((len(mass), UNITS), np.float32), "word_bias": np.log(mass[order]).astype(np.float32)}

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def window(self, ids: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The states after each step (a row of ids), and what back_through needs. Where fresh, a state starts at zero."""
        w, steps, lanes = self.weights, len(ids), len(h)
        x = w["input"][ids]
        states, reset_of = np.empty((steps + 1, lanes, UNITS), x.dtype), np.empty((steps, lanes, UNITS), x.dtype)
        states[0] = h
        half, both, resets = x[:, :, : 2 * UNITS], 2 * UNITS, fresh.any(1)
        half *= 0.5
        for t in range(steps):
            h = states[t]
            if resets[t]:
                h = np.where(fresh[t][:, None], h.dtype.type(0), h)
            s = h @ w["state"]
            gates, new = half[t], x[t, :, both:]
            s[:, :both] *= 0.5
            gates += s[:, :both]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            reset_of[t] = s[:, both:]
            new += gates[:, UNITS:] * s[:, both:]
            np.tanh(new, out=new)
            np.subtract(h, new, out=states[t + 1])
            states[t + 1] *= gates[:, :UNITS]
            states[t + 1] += new
        before = states[:-1].copy()
        before[fresh] = 0
        return states[1:], (ids, before, x, reset_of, fresh)

    def back_through(self, kept: tuple, of: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Adds the gradients of a window's steps, given those of the states after each; none flow to the window before."""
        ids, before, x, reset_of, fresh = kept
        update, reset, new = x[:, :, :UNITS], x[:, :, UNITS : 2 * UNITS], x[:, :, 2 * UNITS :]
        to_update = (before - new) * update * (1 - update)
        to_new = (1 - update) * (1 - new * new)
        to_reset = reset_of * reset * (1 - reset)
        d_state, back = np.empty_like(x), np.ascontiguousarray(self.weights["state"].T)
        dh = np.zeros_like(of[0])
        for t in range(len(ids) - 1, -1, -1):
            dh += of[t]
            d = d_state[t]
            np.multiply(dh, to_update[t], out=d[:, :UNITS])
            d_new = to_new[t]
            d_new *= dh
            np.multiply(d_new, to_reset[t], out=d[:, UNITS : 2 * UNITS])
            np.multiply(d_new, reset[t], out=d[:, 2 * UNITS :])
            dh *= update[t]
            dh += d @ back
            dh[fresh[t]] = 0
        d_state = d_state.reshape(-1, 3 * UNITS)
        grad["state"] += before.reshape(-1, UNITS).T @ d_state
        d_state[:, 2 * UNITS :] = to_new.reshape(-1, UNITS)
        ids = ids.ravel().astype(np.uint16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=np.uint16(ids[0] + 1)))
        grad["input"][ids[first]] += np.add.reduceat(d_state[order], first)

    def log_p(self, h: np.ndarray, targets: np.ndarray, grad: dict[str, np.ndarray] | None = None, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target after its state (for endings, of the class); with grad, adds gradients of the negative sum times weight."""
        w = self.weights
        classes, place, rows = self.class_of[targets], self.place[targets], np.arange(len(targets))
        scores = h @ w["class"]
        scores += w["class_bias"]
        p, total, found = _exp(scores, _wide(w["class"].T, w["class_bias"]), rows, classes)
        dh = None
        if grad is not None:
            p *= (weight / total)[:, None]
            p[rows, classes] -= weight
            grad["class"] += h.T @ p
            grad["class_bias"] += np.ones(len(p), p.dtype) @ p
            dh = p @ w["class"].T
        order = np.argsort(classes, kind="stable")
        bounds = np.searchsorted(classes[order], np.arange(len(self.first)))
        h, place, inside = h[order], place[order], np.zeros(len(order), h.dtype)
        d_inside, wide = np.zeros_like(h) if grad is not None else None, _wide(w["word"], w["word_bias"])
        for k in range(len(self.first) - 1):
            a, b = self.first[k], self.first[k + 1]
            at = slice(bounds[k], bounds[k + 1])
            if at.start == at.stop or b - a == 1:
                continue
            hk, own, rows = h[at], place[at] - a, np.arange(at.stop - at.start)
            scores = hk @ w["word"][a:b].T
            scores += w["word_bias"][a:b]
            q, total, inside[at] = _exp(scores, wide, rows, own)
            if grad is not None:
                q *= (weight / total)[:, None]
                q[rows, own] -= weight
                grad["word"][a:b] += q.T @ hk
                grad["word_bias"][a:b] += np.ones(len(q), q.dtype) @ q
                np.matmul(q, w["word"][a:b], out=d_inside[at])
        found[order] += inside
        if grad is not None:
            dh[order] += d_inside
        return found, dh

    def train(self, documents: list[np.ndarray], end: int, rate: float) -> int:
        """One pass over every token of the documents, in their order, by Adam; the number of tokens.

        The documents stand one behind the other in a stream, which is cut into lanes of equal length so that about STEPS
        windows of each cover all of it. A lane carries its state from window to window and forgets it where a document
        starts; gradients stop at a window's start. The moments of Adam are weights like the others."""
        stream = np.concatenate(documents)
        fresh = np.zeros(len(stream), bool)
        fresh[np.cumsum([0, *map(len, documents[:-1])])] = True
        lanes = max(1, len(stream) // (WINDOW * STEPS))
        size = -(-len(stream) // lanes)
        given = np.where(fresh, stream.dtype.type(end), np.roll(stream, 1))
        pad = lambda x: np.concatenate([x, np.zeros(lanes * size - len(x), x.dtype)]).reshape(lanes, size).T
        given, wanted, fresh, real = pad(given), pad(stream), pad(fresh), pad(np.ones(len(stream), bool))
        one, two = ({n: np.zeros_like(w) for n, w in self.weights.items()} for _ in range(2))
        h = np.zeros((lanes, UNITS), np.float32)
        for time, a in enumerate(range(0, size, WINDOW), 1):
            at = slice(a, a + WINDOW)
            inside = real[at].ravel()
            count = int(inside.sum())
            states, kept = self.window(given[at], h, fresh[at])
            h = states[-1]
            grad = {n: np.zeros_like(x) for n, x in self.weights.items()}
            of = np.zeros((len(inside), UNITS), np.float32)
            _, of[inside] = self.log_p(states.reshape(-1, UNITS)[inside], wanted[at].ravel()[inside], grad, np.float32(1 / count))
            self.back_through(kept, of.reshape(states.shape), grad)
            norm = max(1.0, np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values())))
            step = rate * count / (WINDOW * lanes)
            for n, g in grad.items():
                g /= norm
                one[n] += 0.1 * (g - one[n])
                two[n] += 0.01 * (g * g - two[n])
                self.weights[n] -= (step / (1 - 0.9**time)) * one[n] / (np.sqrt(two[n] * (1 / (1 - 0.99**time))) + 1e-6)
        return len(stream)

    def score(self, documents: list[np.ndarray], end: int) -> np.ndarray:
        """Natural log probability of the ids (classes, for endings) of each document; the state is carried through all of it."""
        total = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        size = np.array([len(documents[i]) for i in order])
        starts = np.cumsum(size) - size
        ids = np.concatenate([documents[i] for i in order]).astype(np.int32) if len(order) else np.zeros(0, np.int32)
        h, before, at, shorter = np.zeros((len(order), UNITS), np.float32), np.full(len(order), end, np.int32), 0, -size
        given, state, both = self.weights["input"], self.weights["state"], 2 * UNITS
        while len(size) and at < size[0]:
            steps = max(1, min(64, BLOCK // max(1, int(np.searchsorted(shorter, -at, "left")))))
            states, targets, lives = [], [], []
            for t in range(at, min(at + steps, int(size[0]))):
                live = int(np.searchsorted(shorter, -t, "left"))
                if live < len(h):
                    h, before = h[:live], before[:live]
                x, s = given[before], h @ state  # as in step, without what backpropagation needs
                gates = x[:, :both] + s[:, :both]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                new = s[:, both:]
                new /= gates[:, UNITS:]
                new += x[:, both:]
                np.tanh(new, out=new)
                h = new + (h - new) / gates[:, :UNITS]
                before = ids[starts[:live] + t]
                states.append(h)
                targets.append(before)
                lives.append(live)
            found, _ = self.log_p(np.concatenate(states), np.concatenate(targets))
            done = 0
            for live in lives:
                total[:live] += found[done : done + live]
                done += live
            at += len(lives)
        out = np.empty(len(order))
        out[order] = total
        return out


class Numbers(dict):
    """-1 for what isn't held."""

    def __missing__(self, key: bytes) -> int:
        return -1


def tokenized(df: DataFrame, v: Vocabulary, id_col: str, text_col: str, learns: Column) -> DataFrame:
    """Each document as ids (binary, little-endian unsigned 16-bit) with the sums over the words held, and the words not held with their frequencies."""
    shared = df.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        v = shared.value
        extra = list(v.known)
        number = Numbers({w: i for i, w in enumerate([*v.learned, *extra])})
        end = number[END]
        id_of = np.concatenate([np.arange(len(v.learned)), len(v.learned) + np.array([ending_of(w) for w in extra], int)]).astype("<u2")
        log_c = np.log10(np.concatenate([v.counts, np.fromiter(v.known.values(), float, len(extra))]) + 1)
        seen = np.concatenate([v.counts > 0, np.ones(len(extra), bool)])
        log_mass = np.log10(v.mass)
        for batch in slices(batches, text_col):
            rows, tail_words, tail_n, tail_ends = [], [], [], [0]
            for text in batch[text_col].to_pylist():
                words = words_of(text)
                at = np.array([*map(number.__getitem__, words), end], np.int64)
                held = at >= 0
                ids = id_of[at]
                left = np.flatnonzero(~held).tolist()
                ids[left] = [len(v.learned) + ending_of(words[i]) for i in left]
                other = ids[ids >= len(v.learned)].astype(int) - len(v.learned)
                base = log_c[at[held]]
                found = Counter([words[i] for i in left])
                tail_words += found.keys()
                tail_n += found.values()
                tail_ends.append(len(tail_n))
                rows.append((ids.tobytes(), len(at), int(seen[at[held]].sum()), float(base.sum()), float(base[at[held] >= len(v.learned)].sum() - log_mass[other].sum())))
            columns = list(zip(*rows))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            tail = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()).cast(pa.string()), pa.array(tail_n, pa.int64())], names=["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), tail)
            yield pa.RecordBatch.from_arrays([batch[id_col], batch["learns"], *(pa.array(c, k) for c, k in zip(columns, kinds)), tail], names=[id_col, "learns", "ids", "n_tokens", "n_held", "base", "fixed", "tail"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, learns boolean, ids binary, n_tokens long, n_held long, base double, fixed double, tail array<struct<word string, n long>>"
    return df.select(id_col, learns.alias("learns"), text_col).mapInArrow(run, schema)


def rounds_of(tokens: int) -> int:
    """The least R with 2^R - 1 shards of SHARD tokens for all of them."""
    return max(1, int(np.ceil(np.log2(tokens / SHARD + 1))))


def dealt(made: DataFrame, rounds: int, id_col: str) -> DataFrame:
    """ids, fresh order (h), shard and round of each segment of the rows that learn."""
    size = 2 * SEGMENT
    learning = made.filter("learns").select(F.col(id_col).alias("id"), F.posexplode(F.expr(f"transform(sequence(0, (octet_length(ids) - 1) div {size}), i -> substring(ids, i * {size} + 1, {size}))")).alias("segment", "ids"))
    h = learning.select("ids", F.xxhash64("id", "segment", "ids").alias("h"))
    placed = h.withColumn("shard", F.pmod("h", F.lit(2**rounds - 1)).cast("int"))
    return placed.withColumn("round", F.length(F.bin(F.col("shard") + 1)) - 1)


def fit(made: DataFrame, v: Vocabulary, id_col: str = "doc_id") -> Network:
    """Fits the network on the rows of tokenized() that learn.

    Their segments are written once, by round, to the shared checkpoint folder, and removed when the fit has ended. A
    shard is trained by one task, which holds its ids; identical rows with identical ids belong to one shard, and one
    of several times SHARD tokens is trained in portions of twice SHARD."""
    net, spark, v = Network(v), made.sparkSession, replace(v, known={})
    end, rounds = v.learned.index(END), rounds_of(v.tokens)
    with scratch(spark, "lm") as path:
        dealt(made, rounds, id_col).write.partitionBy("round").parquet(path)
        rows = spark.read.schema("ids binary, h long, shard int, round int").parquet(path)
        for turn in range(rounds):
            shared = spark.sparkContext.broadcast((v, net.flat()))

            def train(batches, turn=turn, shared=shared):
                v, start = shared.value
                total = np.zeros(len(start) + 1, np.int64)

                def learn(documents):
                    net = Network(v).load(start)
                    n = -(-net.train(documents, end, RATE / (1 + turn / 2)) // UNIT)
                    total[0] += n
                    total[1:] += np.rint(net.flat() * (1 << FRACTION)).astype(np.int64) * n

                documents, size, last = [], 0, None
                for batch in batches:
                    for ids, shard in zip(batch["ids"], batch["shard"].to_pylist()):
                        if documents and (shard != last or size > 2 * SHARD):
                            learn(documents)
                            documents, size = [], 0
                        documents.append(np.frombuffer(ids.as_py(), "<u2"))
                        size, last = size + len(documents[-1]), shard
                if documents:
                    learn(documents)
                if total[0]:
                    parts = [x.tobytes() for x in np.array_split(total, PARTS)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array(parts, pa.binary())], names=["k", "v"])
                tidy()

            tasks = min(1 << turn, EACH * spark.sparkContext.defaultParallelism)
            ordered = rows.filter(F.col("round") == turn).repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "h")
            sums = {r.k: np.frombuffer(r.v, "<i8") for r in sum_vectors(ordered.select("ids", "shard").mapInArrow(train, "k long, v binary"), "<i8", "<i8").collect()}
            if sums:
                total = np.concatenate([sums[k] for k in range(PARTS)])
                net.load((total[1:] / (total[0] * float(1 << FRACTION))).astype(np.float32))
            shared.unpersist()
    return net


@ships
def score(df: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, learned: int = LEARNED) -> DataFrame:
    """Fits on the rows of df that learn (a boolean column), and scores every whole text.

    Returns id_col, learns, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one unigrams) and
    score, both log10. A null text counts as empty: its end is its only token. Rows map one to one, repeated ids
    included; other columns are ignored. With no training rows all counts are 0. Counts of the words that tasks don't hold
    come by a join on the word, pre-aggregated by document; no such word is frequent.
    """
    spark = df.sparkSession
    df = df.select(id_col, text_col, F.coalesce(learns, F.lit(False)).alias("_learns"))
    training = df.filter("_learns")
    counts = cut(word_counts(training, text_col))
    v = vocabulary(counts, training.count(), known, learned)
    made = cut(tokenized(df, v, id_col, text_col, F.col("_learns"))).withColumn("_row", F.monotonically_increasing_id())
    net = fit(made, v, id_col)
    shared = spark.sparkContext.broadcast((replace(v, known={}), net.flat()))
    end = v.learned.index(END)

    def run(batches):
        net = Network(shared.value[0]).load(shared.value[1])
        for batch in slices(batches, "ids"):
            found = net.score([np.frombuffer(x, "<u2") for x in batch["ids"].to_pylist()], end) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(found)], names=[*kept, "model"])

    kept = [id_col, "_row", "learns", "n_tokens", "n_held", "base", "fixed"]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, _row long, learns boolean, n_tokens long, n_held long, base double, fixed double, model double"
    scored = made.select(*kept, "ids").mapInArrow(run, schema)
    tail = made.select("_row", F.explode("tail").alias("t")).select("_row", "t.word", "t.n").join(counts, "word", "left")
    log_c = F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1))
    tail = tail.groupBy("_row").agg(log_c.alias("log_c"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    joined = scored.join(tail, "_row", "left")
    log_c, per_token = F.coalesce("log_c", F.lit(0.0)), float(np.log10(v.tokens + v.distinct + 1))
    return joined.select(
        id_col,
        "learns",
        "n_tokens",
        (F.col("n_held") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log_c - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model") + F.col("fixed") + log_c).alias("score"),
    )
