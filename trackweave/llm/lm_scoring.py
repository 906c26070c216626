"""Document log-likelihood under a gated recurrent language model (operator 1).

Counts of every training token come from one Spark aggregation. The VOCAB most frequent tokens get
ids; the output softmax is factored into classes of tokens, so a token costs one softmax over
classes and one within its class. Words outside the vocabulary are one symbol to the network, and
share its probability by their counts in the training texts (add one).

Training: each training text is cut into chunks of CHUNK tokens, and all of them teach, each
in the round that a hash picks. Chunks are trained on in windows of
WINDOW tokens; gradients stop at a window's border, the state is carried over it. In each of ROUNDS rounds every
task starts from the same weights, learns from its chunks, and the weights are averaged over tasks
(weighted by tokens) in a Spark aggregation over parameters. Every chunk teaches once, whatever the corpus's size.

Scoring runs over complete texts, long ones too: documents are lanes, sorted by length, and a
lane's state goes on from window to window until the text ends.

Tokens are known by 64-bit hashes; two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import gru
from trackweave.llm.common import as_bytes, remainder, slices, table, written
from trackweave.llm.gru import F32
from trackweave.llm.ragged import U, Words, mix

VOCAB, CLASSES = 4096, 16
HIDDEN, EMBED = 16, 16
CHUNK, WINDOW, LANES = 96, 24, 320
ROUNDS, CHUNKS_PER_TASK = 4, 8192
RATE = 0.35
#: Tokens of a count of N / FREQUENT or more, at most FREQUENT of them, are known to every task.
FREQUENT = 1 << 20
SLICE = 2 << 20
GATES = {"gate": gru.by_exponent, "squash": gru.tanh_by_exponent}
RUN_TOKENS, OUT_TOKENS = 1 << 20, 1 << 14
END = int(mix(np.array([0x656E64], U))[0])
UNKNOWN_ID, END_ID = 0, 1


def token_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, each text's end after them; first token of each text, and the end)."""
    words = Words(column)
    rows = np.arange(words.n_rows)
    out = np.empty(len(words) + words.n_rows, U)
    out[np.arange(len(words)) + words.row] = words.hashes()
    out[words.first[1:] + rows] = U(END)
    return out, words.first + np.arange(words.n_rows + 1)


def counted(texts: DataFrame) -> DataFrame:
    """(token, n) of all tokens of texts(text); each task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(token_rows(batch.column(0).slice(a, b - a))[0], return_counts=True) for a, b in slices(batch.column(0), SLICE)]
            if parts:
                token, where = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return texts.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


class Lookup:
    """Places of hashes in a table; most are settled by one look at a slot."""

    BITS = 21

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        slot = (hashes >> U(64 - self.BITS)).astype(np.int64)
        self.place = np.full(1 << self.BITS, -1, np.int32)
        self.place[slot] = np.arange(len(hashes))
        self.crowded = np.bincount(slot, minlength=1 << self.BITS) > 1
        self.hashes = np.append(hashes, U(0))

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> U(64 - self.BITS)).astype(np.int64)
        got = self.place[slot]
        got = np.where(self.hashes[got] == h, got, -1)
        rest = np.flatnonzero((got < 0) & self.crowded[slot])
        if len(rest):
            at = np.minimum(np.searchsorted(self.sorted, h[rest]), len(self.sorted) - 1)
            found = self.sorted[at] == h[rest]
            got[rest[found]] = self.order[at[found]]
        return got


class Frequent:
    """The frequent tokens, in order of count; the first ones are the vocabulary."""

    def __init__(self, token: np.ndarray, n: np.ndarray, total: int, distinct: int):
        order = np.lexsort((token, -n))
        order = order[token[order] != U(END)]
        end = n[token == U(END)]
        self.token = np.concatenate((np.array([END], U), token[order]))
        self.n = np.concatenate((end if len(end) else np.zeros(1, np.int64), n[order]))
        self.total, self.distinct = total, distinct
        self.size = min(VOCAB, len(self.token) + 1)  # unknown, end, words
        self.known = Lookup(self.token)
        inside = int(self.n[: self.size - 1].sum())
        self.outside = (total - inside, distinct - int((self.n[: self.size - 1] > 0).sum()))

    def ids(self, place: np.ndarray) -> np.ndarray:
        return np.where((place >= 0) & (place < self.size - 1), place + 1, UNKNOWN_ID)


def frequent(counts: DataFrame) -> Frequent:
    """Totals and the frequent tokens of counts(token, n); at most FREQUENT rows are gathered."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = counts.filter(F.col("n") * FREQUENT >= total).select("token", "n").toArrow()
    return Frequent(rows["token"].to_numpy().view(U), rows["n"].to_numpy(), int(total), int(distinct))


class Model:
    """Weights by name; class c holds the ids from edge[c] to edge[c + 1].

    Ids 0 and 1 (unknown, end) are classes of their own. Words lie in order of count, and each further class holds about the same
    sum of their counts' square roots: frequent words in small classes, rare ones in large classes that are seldom asked.
    """

    NAMES = ("emb", "wx", "b", "u", "cls", "cls_b", "out", "out_b")

    def __init__(self, params: dict[str, np.ndarray], edge: np.ndarray):
        self.p, self.edge = params, edge
        self.cls = np.repeat(np.arange(len(edge) - 1), np.diff(edge))

    @staticmethod
    def fresh(known: Frequent, seed: int = 11) -> Model:
        """Small random weights; output biases that say how frequent classes and words are."""
        rng = np.random.default_rng(seed)
        size = max(known.size, 3)
        draw = lambda *shape, s=0.2: (rng.standard_normal(shape) * s).astype(F32)
        n = np.zeros(size)
        n[1 : known.size] = known.n[: known.size - 1]
        n[0] = known.outside[0]
        n += 0.5
        part = np.cumsum(np.sqrt(n[2:]))
        part = np.ceil(part / part[-1] * (CLASSES - 2) - 1e-9)
        edge = np.concatenate(([0, 1], np.flatnonzero(np.diff(part, prepend=0)) + 2, [size]))
        mass = np.add.reduceat(n, edge[:-1])
        p = {
            "emb": draw(size, EMBED), "wx": draw(EMBED, 3 * HIDDEN, s=0.3), "b": np.zeros(3 * HIDDEN, F32), "u": draw(HIDDEN, 3 * HIDDEN, s=0.25),
            "cls": draw(HIDDEN, len(mass), s=0.01), "cls_b": np.log(mass / mass.sum()).astype(F32),
            "out": draw(size, HIDDEN, s=0.01), "out_b": np.log(n / np.repeat(mass, np.diff(edge))).astype(F32),
        }
        return Model(p, edge)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def filled(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k in self.NAMES:
            v = self.p[k]
            out[k] = flat[at : at + v.size].reshape(v.shape).astype(F32)
            at += v.size
        return Model(out, self.edge)

    def inner(self, target: np.ndarray) -> Iterator[tuple[int, int, slice]]:
        """Of targets in order of id: each class of several ids that occurs, as the places of its targets and its ids."""
        edge = self.edge.tolist()
        place = np.searchsorted(target, self.edge).tolist()
        for c in range(2, len(edge) - 1):
            if place[c] < place[c + 1]:
                yield place[c], place[c + 1], slice(edge[c], edge[c + 1])

    def log10(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target after state h."""
        order = by_id(target)
        h, target = h[order], target[order]
        logits = h @ self.p["cls"]
        logits += self.p["cls_b"]
        found = logits[np.arange(len(h)), self.cls[target]] - np.log(exponents(logits)[1])
        for a, b, own in self.inner(target):
            logits = h[a:b] @ self.p["out"][own].T
            logits += self.p["out_b"][own]
            found[a:b] += logits[np.arange(b - a), target[a:b] - own.start] - np.log(exponents(logits)[1])
        out = np.empty(len(h))
        out[order] = found
        return out / np.log(10)

    def score(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log10 probability of each complete text: ids with an end, begin the texts' borders."""
        length = np.diff(begin)
        order = np.argsort(-length, kind="stable")
        start, length = begin[:-1][order], length[order]
        total = np.zeros(len(order))
        table = self.p["emb"] @ self.p["wx"] + self.p["b"]
        h = np.zeros((len(order), HIDDEN), F32)
        step = np.arange(WINDOW)[:, None]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            state, target, lane = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for a in range(0, len(lane), OUT_TOKENS):
                own = slice(a, a + OUT_TOKENS)
                total[:] += np.bincount(lane[own], self.log10(state[own], target[own]), len(total))

        waiting = 0
        for at in range(0, int(length[0]) if len(length) else 0, WINDOW):
            n = int(np.searchsorted(-length, -at))  # lanes that still go on
            there = at + step < length[:n]
            place = np.where(there, start[:n] + at + step, 0)
            before = np.where((at + step > 0) & there, ids[np.maximum(place - 1, 0)], END_ID)
            states = gru.forward(table[before], h[:n], self.p["u"], **GATES)
            h = states[-1]
            held.append((states[there], ids[place[there]], np.broadcast_to(np.arange(n), there.shape)[there]))
            waiting += len(held[-1][2])
            if waiting >= OUT_TOKENS:
                flush()
                waiting = 0
        if held:
            flush()
        out = np.empty(len(order))
        out[order] = total
        return out


def by_id(target: np.ndarray) -> np.ndarray:
    """The stable order of ids, which are less than VOCAB; a class's tokens lie side by side in it."""
    return np.argsort(target.astype(np.uint16), kind="stable")


def exponents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) and its sums over rows; x is written over.

    Logits are small numbers, so they are taken as they are; rows for which that is not so are held at
    the largest and smallest numbers that single precision can sum and divide by.
    """
    if x.size and float(x.max()) > 60:
        np.minimum(x, F32(60), out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], F32) + F32(1e-30)


class Trainer:
    """Steps of a running-sum-of-squares rule over windows of LANES chunks."""

    def __init__(self, model: Model):
        self.model, self.p = model, model.p
        self.sums = {k: np.full(v.shape, 1e-3, F32) for k, v in self.p.items()}

    def update(self, name: str, g: np.ndarray, at=...) -> None:
        s = self.sums[name][at] + g * g
        self.sums[name][at] = s
        self.p[name][at] -= F32(RATE) * g / np.sqrt(s)

    def chunks(self, ids: np.ndarray) -> None:
        """ids(lanes, CHUNK + 1): the token before each chunk, then its tokens, -1 past the end."""
        h = np.zeros((len(ids), HIDDEN), F32)
        for a in range(0, CHUNK, WINDOW):
            before, target = ids[:, a : a + WINDOW].T, ids[:, a + 1 : a + WINDOW + 1].T
            alive = target >= 0
            if alive.any():
                h = self.window(np.where(before >= 0, before, 0), np.maximum(target, 0), alive, h)

    def window(self, before: np.ndarray, target: np.ndarray, alive: np.ndarray, h0: np.ndarray) -> np.ndarray:
        p, model = self.p, self.model
        e = p["emb"][before]
        states, cache = gru.forward(e @ p["wx"] + p["b"], h0, p["u"], True, **GATES)
        h, y = states[alive], target[alive]
        order = by_id(y)
        h, y = h[order], y[order]
        n, scale = len(y), F32(1 / len(y))
        prob = h @ p["cls"]
        prob += p["cls_b"]
        prob, total = exponents(prob)
        prob *= (scale / total)[:, None]
        prob[np.arange(n), model.cls[y]] -= scale
        d_h = prob @ p["cls"].T
        self_cls, self_b = h.T @ prob, np.ones(n, F32) @ prob
        for a, b, own in model.inner(y):
            q = h[a:b] @ p["out"][own].T
            q += p["out_b"][own]
            q, total = exponents(q)
            q *= (scale / total)[:, None]
            q[np.arange(b - a), y[a:b] - own.start] -= scale
            d_h[a:b] += q @ p["out"][own]
            self.update("out", q.T @ h[a:b], own)
            self.update("out_b", np.ones(b - a, F32) @ q, own)
        self.update("cls", self_cls)
        self.update("cls_b", self_b)
        d_states = np.zeros_like(states)
        in_place = np.empty_like(d_h)
        in_place[order] = d_h
        d_states[alive] = in_place
        d_in, d_u = gru.backward(d_states, cache, p["u"])
        flat_in, flat_e = d_in.reshape(-1, 3 * HIDDEN), e.reshape(-1, EMBED)
        d_e = flat_in @ p["wx"].T
        order = np.argsort(before, axis=None, kind="stable")
        rows, first = np.unique(before.ravel()[order], return_index=True)
        self.update("emb", np.add.reduceat(d_e[order], first), rows)
        self.update("wx", flat_e.T @ flat_in)
        self.update("b", flat_in.sum(0))
        self.update("u", d_u)
        return states[-1]


def chunks_of(texts: DataFrame, known) -> DataFrame:
    """(round, ids) of every token of texts(text), in chunks of CHUNK tokens of one text.

    The hash of the text and the chunk's number pick the round, so a repeated run learns alike. ids
    starts with the token before the chunk (end, at a text's beginning).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = known.value
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                tokens, begin = token_rows(batch.column(0).slice(a, b - a))
                ids = voc.ids(voc.known.find(tokens)).astype(np.int16)
                n = -(-np.diff(begin) // CHUNK)
                row = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = begin[row] + number * CHUNK
                length = np.minimum(begin[row + 1] - at, CHUNK)
                hashes = batch.column(1).slice(a, b - a).to_numpy().view(U)[row]
                rounds = (mix(number.astype(U) * U(0x9E3779B97F4A7C15) ^ hashes) % U(ROUNDS)).astype(np.int32)
                offsets = np.concatenate(([0], np.cumsum(length + 1)))
                place = np.arange(offsets[-1]) + np.repeat(at - 1 - offsets[:-1], length + 1)
                out = ids[np.maximum(place, 0)]
                out[offsets[:-1][number == 0]] = END_ID
                yield pa.RecordBatch.from_arrays([pa.array(rounds), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))], names=["round", "ids"])

    return texts.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(run, "round int, ids array<smallint>")


def lanes(column: pa.Array, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Chunks of a column of lists, LANES at a time and padded by -1; chunks of like length go together."""
    begin = column.offsets.to_numpy()
    flat, length = column.values.to_numpy(), np.diff(begin)
    order = np.argsort(length, kind="stable")
    for k in rng.permutation(-(-len(order) // LANES)).tolist():
        own = order[k * LANES : (k + 1) * LANES]
        at = np.arange(CHUNK + 1)
        there = at < length[own][:, None]
        yield np.where(there, flat[np.where(there, begin[own][:, None] + at, 0)], -1).astype(np.int64)


def trained(spark: SparkSession, texts: DataFrame, known: Frequent, shared) -> Model:
    """The averaged model after all rounds over all chunks of texts(text), one pass at every size."""
    chunks = written(chunks_of(texts, shared), "chunks", "round")
    sizes = dict(chunks.groupBy("round").count().collect())
    model = Model.fresh(known)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in sorted(sizes):
        weights = spark.sparkContext.broadcast((model.p, model.edge))

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Model({k: v.copy() for k, v in weights.value[0].items()}, weights.value[1]))
            seen, rng = 0, np.random.default_rng(0)
            for batch in batches:
                for ids in lanes(batch.column(0), rng):
                    trainer.chunks(ids)
                    seen += int((ids[:, 1:] >= 0).sum())
            if seen:
                flat = trainer.model.flat()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), seen, np.int64))], names=["place", "value", "seen"])

        tasks = max(1, min(most, sizes[i] // CHUNKS_PER_TASK))
        # chunks lie in files as the texts do, so scans are joined and nothing is shuffled but weights
        learnt = chunks.filter(F.col("round") == i).select("ids").coalesce(tasks).mapInArrow(run, "place int, value float, seen bigint")
        mean = learnt.groupBy("place").agg((F.sum(F.col("value").cast("double") * F.col("seen")) / F.sum("seen")).alias("value")).toArrow()
        flat = np.zeros(len(model.flat()))
        flat[mean["place"].to_numpy()] = mean["value"].to_numpy()
        model = model.filled(flat)
    return model


def scored(df: DataFrame, text: Column, key: Column, known, weights) -> DataFrame:
    """A row for each row of df: sums over its frequent tokens, the network's score, its rare tokens."""
    schema = "row bigint, key {kind}, n_tokens bigint, n_known bigint, base double, score double, n_outside bigint, rare array<struct<token:bigint,k:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model = known.value, Model(*weights.value)
        logs = np.append(np.log10(voc.n + 1.0), 0.0)

        def out(batch: pa.RecordBatch, parts: list) -> pa.RecordBatch:
            ids, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            rows = sum(len(p[1]) for p in parts)
            begin = np.concatenate(([0], np.cumsum(lengths)))
            sums = [np.concatenate([p[i] for p in parts]) for i in range(2, 6)]
            rare_n = np.concatenate([p[6] for p in parts])
            rare = pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), pa.int64()) for k in (7, 8)], names=["token", "k"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(rare_n))).astype(np.int32))
            n_known, base, outside, n_outside = sums
            score = model.score(ids, begin) + outside
            columns = [batch.column(0), batch.column(1), pa.array(lengths), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(n_outside.astype(np.int64)), pa.ListArray.from_arrays(offsets, rare)]
            assert len(batch) == rows
            return pa.RecordBatch.from_arrays(columns, names=["row", "key", "n_tokens", "n_known", "base", "score", "n_outside", "rare"])

        for batch in batches:
            parts, first, held = [], 0, 0
            for a, b in slices(batch.column(2), SLICE):
                tokens, begin = token_rows(batch.column(2).slice(a, b - a))
                lengths, rows = np.diff(begin), b - a
                row = np.repeat(np.arange(rows), lengths)
                place = voc.known.find(tokens)
                ids = voc.ids(place)
                seen = (place >= 0) & (voc.n[np.maximum(place, 0)] > 0)
                outside = ids == UNKNOWN_ID
                log = np.where(place >= 0, logs[place], 0.0)
                missing = np.flatnonzero(place < 0)
                order = missing[np.lexsort((tokens[missing], row[missing]))]
                new = np.ones(len(order), bool)
                new[1:] = (tokens[order[1:]] != tokens[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                at = np.flatnonzero(new)
                k = np.diff(np.append(at, len(order)))
                parts.append(
                    (
                        ids, lengths, np.bincount(row, seen, rows), np.bincount(row, log, rows), np.bincount(row, np.where(outside, log, 0.0), rows),
                        np.bincount(row, outside, rows), np.bincount(row[order[at]], minlength=rows), tokens[order[at]].view(np.int64), k,
                    )
                )
                held += len(ids)
                if held >= RUN_TOKENS:
                    yield out(batch.slice(first, b - first), parts)
                    parts, first, held = [], b, 0
            if parts:
                yield out(batch.slice(first), parts)

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), text.alias("text")).mapInArrow(run, schema.format(kind=kind))


def log_likelihood(df: DataFrame, learn: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; learn says which rows teach.

    Tokens are runs of bytes other than ASCII white space, A-Z lower-cased, then one end. Null and
    empty texts are an end alone. base_score takes (c + 1) / (N + V + 1) for a token seen c times in
    N training tokens of V kinds. Rows for which learn is null don't teach. Repeated rows and null
    keys give a row each; extra columns are ignored; an empty table gives an empty result, and with
    nothing to learn from every token has the base probability of 1 / 1.
    """
    spark = df.sparkSession
    texts = df.filter(learn).select(df[text].alias("text"))
    counts = written(counted(texts), "counts")
    known = frequent(counts)
    shared = spark.sparkContext.broadcast(known)
    model = trained(spark, texts, known, shared)
    rows = written(scored(df, df[text], df[key], shared, spark.sparkContext.broadcast((model.p, model.edge))), "scored")
    rare = rows.select("row", F.inline("rare")).join(counts.filter(F.col("n") * FREQUENT < known.total), "token")
    sums = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("rare_log"), F.sum("k").alias("rare_known"))
    n, v = known.outside
    log, seen = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return rows.drop("rare").join(sums, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + seen).alias("n_known"),
        F.lit(known.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * float(np.log10(known.total + known.distinct + 1))).alias("base_score"),
        (F.col("score") + log - F.col("n_outside") * float(np.log10(n + v + 1))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document scored by what six sevenths of the ids teach."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    rows = log_likelihood(docs, remainder(docs["doc_id"], 7) != 2)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
