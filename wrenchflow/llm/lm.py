"""Log-likelihood of documents under a gated recurrent language model.

A token has a code: the most frequent words have one of their own; other words
share a code by the power of two below their count and by whether they end in a
mark; words never seen in training are one code of one event.  Codes of like frequency
form a class.  The recurrent network (numpy) predicts the class from its state, and by
a second softmax, with output vectors of that class, the code within the class.
Words of a shared code have their share of its training tokens, counted over the whole
training corpus.  The network reads codes, not words.

Counts are exact and distributed: input partitions are cut into chunks of bounded
size, each chunk gives its words once, words are summed over chunks and joined
back to the chunks they occur in, and each chunk's documents become class
sequences of one byte a token.  Documents are dealt by a hash to copies of the network, each of
which learns from its own by truncated backpropagation; copies are
averaged by token count in groups.
Scoring carries the state across windows, so a document's likelihood is that of
the complete text.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenchflow.llm.common import materialise

END = b"\n"  # no word holds white space
HEAD, BANDS = 200, 24
UNSEEN = HEAD + 1 + 2 * BANDS
CODES = UNSEEN + 1
#: Classes, and codes of a class: code k is member k mod 16 of class k div 16.
CLASSES, MEMBERS = 16, 16
#: Words seen once are half of them unseen words to the training passes; codes by mark.
_ONCE = (254, 255)
HIDDEN, WINDOW, LANES = 32, 32, 128
#: Tokens that a copy lays out at once; tokens after which training starts a long document's state afresh, so that
#: no stretch is learned from one document alone (scoring carries the state to its end).
GROUP, PIECE = 1 << 20, 1024
_CHUNK_BYTES = 32_000_000

_PASS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("held", pa.bool_()),
                   ("word", pa.binary()), ("n", pa.int64())])
_PASS_SQL = "chunk long, doc_id long, text string, held boolean, word binary, n long"
_CODED = "doc_id long, held boolean, n_tokens long, n_known long, base double, within double, codes binary"


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their chunk, and per chunk each of its words with its count in training documents."""
    chunk, size, counts = TaskContext.get().partitionId() << 24, 0, Counter()

    def words() -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()),
             pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=_PASS)

    for batch in batches:
        start = 0
        for i, (text, held) in enumerate(zip(batch.column("text"), batch.column("held").to_pylist())):
            found = tokens(text.as_py())
            found.append(END)
            if held:
                for w in set(found):
                    counts.setdefault(w, 0)
            else:
                counts.update(found)
            size += len(text.as_py())
            if size >= _CHUNK_BYTES:
                yield _documents(batch.slice(start, i + 1 - start), chunk)
                yield words()
                start, chunk, size, counts = i + 1, chunk + 1, 0, Counter()
        if start < batch.num_rows:
            yield _documents(batch.slice(start), chunk)
    if counts:
        yield words()


def _documents(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * n, pa.int64()), batch.column("doc_id"), batch.column("text"), batch.column("held"),
         pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=_PASS)


def _band(count: Column, word: Column) -> Column:
    """The shared code of a word that was seen ``count`` times."""
    band = F.least(F.length(F.bin(count)) - 1, F.lit(BANDS - 1))
    return (F.lit(HEAD + 1) + 2 * band + _mark(word)).cast("int")


def _mark(word: Column) -> Column:
    return word.cast("string").rlike(r"[!-/:-@\[-`{-~]$").cast("int")


def code_of(count: Column, word: Column, rank: Column) -> Column:
    """A seen word's code: its rank in the head, its band, or for half of the words seen once the code of those."""
    once = (count == 1) & (F.crc32(word) % 2 == 1)
    return F.coalesce(rank, F.when(once, F.lit(_ONCE[0]) + _mark(word)).otherwise(_band(count, word))).cast("int")


def _coder(totals: dict[int, int], n: int, v: int):
    floor = np.log10(n + v + 1)

    def code(key, docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        both = words["c"].to_numpy(np.int64)  # count and code
        count, codes = both >> 8, (both & 255).astype(np.uint8)
        index = {w: i for i, w in enumerate(words["word"])}
        plain = for_scoring(codes)
        total = np.array([max(totals.get(k, 1), 1) for k in range(CODES)], float)
        within = np.where(count > 0, np.log10(np.maximum(count, 1) / total[plain]), 0.0)
        base = np.log10(count + 1) - floor
        rows = []
        for doc_id, held, text in zip(docs["doc_id"], docs["held"], docs["text"]):
            found = tokens(text)
            found.append(END)
            at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
            rows.append((None if pd.isna(doc_id) else int(doc_id), bool(held), len(at), int((count[at] > 0).sum()),
                         float(base[at].sum()), float(within[at].sum()), codes[at].tobytes()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _CODED.split(", ")])
        return out.astype({"doc_id": "Int64"})
    return code


def for_scoring(codes: np.ndarray) -> np.ndarray:
    """Classes of codes: words seen once are of their band."""
    return np.where(codes >= _ONCE[0], codes - _ONCE[0] + HEAD + 1, codes).astype(np.uint8)


def for_training(codes: np.ndarray) -> np.ndarray:
    """Classes of codes where half of the words seen once stand for unseen ones."""
    return np.where(codes >= _ONCE[0], UNSEEN, codes).astype(np.uint8)


def start_weights(code_counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; the outputs' biases are log shares, so an untrained network is the unigram."""
    rng = np.random.default_rng(seed)
    share = np.full(CLASSES * MEMBERS, 1e-12)
    share[:CODES] = (code_counts + 0.5) / (code_counts + 0.5).sum()
    share = share.reshape(CLASSES, MEMBERS)
    return {"x": rng.normal(0, 0.1, (CLASSES * MEMBERS, 3 * HIDDEN)).astype(np.float32),
            "u": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
            "b": np.concatenate((np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32),
            "o": rng.normal(0, 0.05, (HIDDEN, CLASSES)).astype(np.float32), "c": np.log(share.sum(axis=1)).astype(np.float32),
            "q": rng.normal(0, 0.05, (CLASSES, HIDDEN, MEMBERS)).astype(np.float32),
            "d": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)}


def _by_gate(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input and state weights a gate; those of the two sigmoids halved: a sigmoid of x is (tanh(x / 2) + 1) / 2."""
    half = np.array([0.5, 0.5, 1], w["u"].dtype)[:, None, None]
    return tuple(np.ascontiguousarray(m.reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) * half for m in (w["x"] + w["b"], w["u"]))


class _Room:
    """Arrays for a stretch of places of some lanes, written anew by each stretch: fresh memory costs more than the sums.

    Gates are update z, reset r and the candidate's share of the state; ``g`` is the candidate, ``d`` the state before
    less it.  With ``keep`` these are held of every place and not of the last alone, and there is room to go back.
    """

    def __init__(self, places: int, lanes: int, dtype, keep: bool) -> None:
        self.shape, n, kept = (places, lanes), HIDDEN, places if keep else 1
        self.gates = np.empty((kept, 3, lanes, n), dtype)
        self.g, self.d = np.empty((2, kept, lanes, n), dtype)
        self.priors = np.zeros((places, lanes, n), dtype)
        self.states = np.empty((places, lanes, n), dtype)
        self.by_class = np.empty((places * lanes, n), dtype)
        self.logits = np.empty((places * lanes, CLASSES + MEMBERS), dtype)
        if keep:
            self.by_z, self.by_r = np.empty((2, places, lanes, n), dtype)
            self.of_states = np.empty((places * lanes, n), dtype)
            self.back, self.sorted = np.empty((2, places * lanes, 4 * n), dtype)


def _forward(x: np.ndarray, u: np.ndarray, laid: _Lanes, t0: int, h: np.ndarray, room: _Room) -> np.ndarray:
    """A stretch from place ``t0`` of the lanes that reach it, into ``room``; gives the codes before its places.

    A lane that ends in the stretch goes on as if ends followed; those places count for nothing.
    """
    codes = laid.before(t0, *room.shape)
    for k, (prior, out) in enumerate(zip(room.priors, room.states)):
        prior[:] = h
        if t0 + k in laid.starts:
            prior[laid.starts[t0 + k][0]] = 0
        at = k % len(room.g)
        gates, g, d = room.gates[at], room.g[at], room.d[at]
        given = x.take(codes[k], axis=1)
        np.matmul(prior, u, out=gates)
        both = gates[:2]
        both += given[:2]
        np.tanh(both, out=both)
        both *= 0.5
        both += 0.5
        np.multiply(gates[1], gates[2], out=g)
        g += given[2]
        np.tanh(g, out=g)
        np.subtract(prior, g, out=d)
        np.multiply(d, gates[0], out=out)
        out += g
        h = out
    return codes


class _Lanes:
    """Sequences laid end to end in lanes of about equal length, longest lane first.

    ``side`` has a row per place after a first row of ends; ``active`` is how many lanes
    reach each place; ``starts`` has the lanes and sequences that begin at a place.
    """

    def __init__(self, sequences: list[np.ndarray], lanes: int) -> None:
        held = [(0, k, []) for k in range(min(lanes, len(sequences)))]
        for i in sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i)):  # each to the shortest lane
            size, k, own = heapq.heappop(held)
            own.append(i)
            heapq.heappush(held, (size + len(sequences[i]), k, own))
        held.sort(key=lambda lane: (-lane[0], lane[1]))
        lengths = np.array([lane[0] for lane in held])
        self.side = np.zeros((int(lengths[0]) + 1, len(held)), np.uint8)
        begins: dict[int, tuple[list[int], list[int]]] = {}
        for k, (_, _, own) in enumerate(held):
            at = 0
            for i in own:
                lanes_at, which = begins.setdefault(at, ([], []))
                lanes_at.append(k)
                which.append(i)
                self.side[at + 1:at + 1 + len(sequences[i]), k] = sequences[i]
                at += len(sequences[i])
        self.active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
        self.starts = {t: (np.array(k), np.array(i)) for t, (k, i) in begins.items()}

    def before(self, t0: int, places: int, lanes: int) -> np.ndarray:
        """The codes before a stretch's places; an end before a sequence's first."""
        codes = self.side[t0:t0 + places, :lanes].astype(np.intp)
        for k in range(places):
            if t0 + k in self.starts:
                codes[k, self.starts[t0 + k][0]] = 0
        return codes

    def after(self, t0: int, places: int, lanes: int) -> tuple[np.ndarray, np.ndarray, list]:
        """The codes at a stretch's places that hold a token, in order of class; where they are, flat; classes' spans."""
        y, active = self.side[t0 + 1:t0 + 1 + places, :lanes].ravel(), self.active[t0:t0 + places]
        held = np.flatnonzero(np.arange(lanes) < np.array(active)[:, None]) if active[-1] < lanes else None
        order, spans = _by_class(y if held is None else y[held])
        order = order if held is None else held[order]
        return y[order].astype(np.intp), order, spans


def _by_class(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of tokens by class, and each class with its span in it."""
    of = (y >> 4).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(CLASSES + 1))
    return order, [(c, int(a), int(b)) for c, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]


#: Sums of the two softmaxes in a row of both; a row per member.
_HALVES = np.kron(np.eye(2), np.ones((MEMBERS, 1))).astype(np.float32)
_MEMBER = np.eye(MEMBERS, dtype=np.float32)


def _outputs(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of both softmaxes side by side, for each class."""
    wide = np.concatenate((np.broadcast_to(w["o"], (CLASSES, HIDDEN, CLASSES)), w["q"]), axis=2)
    return wide, np.concatenate((np.broadcast_to(w["c"], (CLASSES, CLASSES)), w["d"]), axis=1)


def _logits(wide: np.ndarray, bias: np.ndarray, room: _Room, order: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
    """States in order of their tokens' classes, and both softmaxes' logits."""
    states = np.take(room.states.reshape(-1, HIDDEN), order, axis=0, out=room.by_class[:len(order)], mode="clip")
    logits = room.logits[:len(order)]
    for c, a, b in spans:
        np.matmul(states[a:b], wide[c], out=logits[a:b])
        logits[a:b] += bias[c]
    return states, np.minimum(logits, 80, out=logits)


def _chosen(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, in flat logits, the class and the code within it stand."""
    row = np.arange(len(y)) * (CLASSES + MEMBERS)
    return row + (y >> 4), row + CLASSES + (y & 15)


def _output_gradients(w: dict, room: _Room, y: np.ndarray, order: np.ndarray, spans: list, whole: int, grad: dict) -> None:
    """Gradients of both softmaxes' weights, of the mean log loss over ``whole`` tokens, and of the states."""
    wide, bias = _outputs(w)
    states, p = _logits(wide, bias, room, order, spans)
    np.exp(p, out=p)
    both = p.reshape(-1, 2, MEMBERS)
    both *= (1 / (whole * (p @ _HALVES)))[:, :, None]
    for at in _chosen(y):
        p.reshape(-1)[at] -= np.float32(1 / whole)
    one, of_wide, of_bias = np.ones(len(y), np.float32), np.zeros_like(wide), np.zeros_like(bias)
    for c, a, b in spans:
        np.matmul(states[a:b].T, p[a:b], out=of_wide[c])
        np.matmul(one[a:b], p[a:b], out=of_bias[c])
        np.matmul(p[a:b], wide[c].T, out=states[a:b])
    grad["o"][:], grad["q"][:] = of_wide[:, :, :CLASSES].sum(axis=0), of_wide[:, :, CLASSES:]
    grad["c"][:], grad["d"][:] = of_bias[:, :CLASSES].sum(axis=0), of_bias[:, CLASSES:]
    if len(order) < len(room.of_states):
        room.of_states[:] = 0
    room.of_states[order] = states


def _log_codes(w: dict, room: _Room, y: np.ndarray, order: np.ndarray, spans: list) -> np.ndarray:
    """Log probability of each code: of its class, and of the code within the class; in the given order."""
    logits = _logits(*_outputs(w), room, order, spans)[1]
    value = sum(logits.reshape(-1)[at] for at in _chosen(y))
    np.exp(logits, out=logits)
    value -= np.log(logits @ _HALVES).sum(axis=1)
    return value


def _views(flat: np.ndarray, like: dict) -> dict:
    """Arrays of the shapes of ``like`` in one flat array."""
    ends = np.cumsum([v.size for v in like.values()])
    return {k: part.reshape(like[k].shape) for k, part in zip(like, np.split(flat, ends[:-1]))}


class Trainer:
    """A copy of the network that learns group after group of sequences: truncated backpropagation with Adam."""

    def __init__(self, w: dict, rate: float = 0.02) -> None:
        self.w, self.rate, self.step, self.seen = w, rate, 0, 0
        self.flat = np.concatenate([v.ravel() for v in w.values()])
        w.update(_views(self.flat, w))
        self.m, self.s, self.g = (np.zeros_like(self.flat) for _ in range(3))
        self.grad, self.room = _views(self.g, w), None

    def learn(self, sequences: list[np.ndarray]) -> None:
        pieces = [q[at:at + PIECE] for q in sequences for at in range(0, len(q), PIECE)]
        laid = _Lanes(pieces, LANES)
        h = np.zeros((laid.side.shape[1], HIDDEN), np.float32)
        for t0 in range(0, len(laid.active), WINDOW):
            h = self._window(laid, t0, h)

    def _window(self, laid: _Lanes, t0: int, h: np.ndarray) -> np.ndarray:
        """One stretch of all lanes that reach it, forth and back; gives the state after it."""
        w, n = self.w, HIDDEN
        shape = places, lanes = len(laid.active[t0:t0 + WINDOW]), laid.active[t0]
        whole = WINDOW * laid.side.shape[1]  # a stretch that few lanes reach weighs as many tokens as it has
        if self.room is None or self.room.shape != shape:
            self.room = _Room(*shape, np.float32, keep=True)
        room, grad = self.room, self.grad
        codes = _forward(*_by_gate(w), laid, t0, h[:lanes], room)
        after = laid.after(t0, *shape)
        _output_gradients(w, room, *after, whole, grad)
        z, r, share = (room.gates[:, k] for k in range(3))
        by_z, by_g, by_r = room.by_z, room.g, room.by_r  # what a state's gradient is times, for each gate's
        np.subtract(1, z, out=by_z)
        by_g *= by_g
        np.subtract(1, by_g, out=by_g)
        by_g *= by_z
        by_z *= z
        by_z *= room.d
        np.subtract(1, r, out=by_r)
        by_r *= r
        by_r *= share
        # gradients of z, of r, of the candidate's share of the state, of the candidate
        back, u_t, dh = room.back.reshape(places, lanes, 4 * n), np.ascontiguousarray(w["u"].T), None
        for k, here in reversed(list(enumerate(room.of_states.reshape(places, lanes, n)))):
            if dh is not None:
                here += dh
            to = back[k]
            dg = here * by_g[k]
            np.multiply(here, by_z[k], out=to[:, :n])
            np.multiply(dg, by_r[k], out=to[:, n:2 * n])
            np.multiply(dg, r[k], out=to[:, 2 * n:3 * n])
            to[:, 3 * n:] = dg
            dh = to[:, :3 * n] @ u_t
            here *= z[k]
            dh += here
            if t0 + k in laid.starts:
                dh[laid.starts[t0 + k][0]] = 0
        np.matmul(room.priors.reshape(-1, n).T, room.back[:, :3 * n], out=grad["u"])
        self._input_gradients(codes.ravel())
        self._adam()
        self.seen += len(after[0])
        return room.states[-1]

    def _input_gradients(self, codes: np.ndarray) -> None:
        """Sums by code, the codes of a class by one product."""
        order, spans = _by_class(codes)
        member = _MEMBER.take(codes[order] & 15, axis=0)
        back = np.take(self.room.back, order, axis=0, out=self.room.sorted, mode="clip")
        summed = np.zeros((CLASSES, MEMBERS, back.shape[1]), np.float32)
        for c, a, b in spans:
            np.matmul(member[a:b].T, back[a:b], out=summed[c])
        grad, summed = self.grad["x"], summed.reshape(CLASSES * MEMBERS, -1)
        grad[:, :2 * HIDDEN], grad[:, 2 * HIDDEN:] = summed[:, :2 * HIDDEN], summed[:, 3 * HIDDEN:]
        self.grad["b"][:] = grad.sum(axis=0)

    def _adam(self) -> None:
        g, m, s = self.g, self.m, self.s
        self.step += 1
        g *= min(1.0, 1.0 / (float(g @ g) ** 0.5 + 1e-9))
        m *= 0.9
        m += 0.1 * g
        s *= 0.999
        g *= g
        g *= 0.001
        s += g
        np.divide(s, 1 - 0.999 ** self.step, out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(m, g, out=g)
        g *= self.rate / (1 - 0.9 ** self.step)
        self.flat -= g


def log10_codes(w: dict, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence's codes; the state runs through all of its windows."""
    if not sequences:
        return np.zeros(0)
    laid, (x, u) = _Lanes(sequences, LANES), _by_gate(w)
    h, total, room = np.zeros((laid.side.shape[1], HIDDEN), u.dtype), np.zeros(len(sequences)), None
    of = np.zeros(laid.side.shape[1], np.int64)
    for t0 in range(0, len(laid.active), WINDOW):
        shape = places, lanes = len(laid.active[t0:t0 + WINDOW]), laid.active[t0]
        if room is None or room.shape != shape:
            room = _Room(*shape, u.dtype, keep=False)
        _forward(x, u, laid, t0, h[:lanes], room)
        docs = np.empty(shape, np.int64)
        for k in range(places):
            if t0 + k in laid.starts:
                at, which = laid.starts[t0 + k]
                of[at] = which
            docs[k] = of[:lanes]
        after = laid.after(t0, *shape)
        total += np.bincount(docs.ravel()[after[1]], _log_codes(w, room, *after), len(sequences))
        h = room.states[-1]
    return total / np.log(10)


def _pack(w: dict) -> bytes:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype("<f4").tobytes()


def _unpack(data: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _trainer(start: bytes, like: dict):
    """Trains the copies of a partition one after the other; their documents come sorted, in groups of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copy, trainer, group, size = None, None, [], 0

        def done() -> pa.RecordBatch:
            if group:
                trainer.learn(group)
            return pa.RecordBatch.from_pydict({"part": [copy], "n": [trainer.seen], "weights": [_pack(trainer.w)]}, _COPY)

        for batch in batches:
            for of, codes in zip(batch.column("copy").to_pylist(), batch.column("codes")):
                if of != copy:
                    if trainer:
                        yield done()
                    copy, trainer, group, size = of, Trainer(_unpack(start, like)), [], 0
                group.append(for_training(np.frombuffer(codes.as_buffer(), np.uint8)))
                size += len(group[-1])
                if size >= GROUP:
                    trainer.learn(group)
                    group, size = [], 0
        if trainer:
            yield done()
    return run


_COPY = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("weights", pa.binary())])


def _mean(key, df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("part")  # one order of adding up, wherever the copies come from
    n = df["n"].to_numpy(float)
    total = sum(np.frombuffer(x, "<f4").astype(float) * k for x, k in zip(df["weights"], n)) / n.sum()
    return pd.DataFrame({"part": [int(key[0])], "n": [int(n.sum())], "weights": [total.astype("<f4").tobytes()]})


def averaged(copies: DataFrame, fan: int = 64) -> bytes | None:
    """The mean of all copies by tokens seen, ``fan`` copies to a task, level by level."""
    schema = "part long, n long, weights binary"
    copies = materialise(copies, "lm-copies")
    while copies.count() > 1:
        key = F.floor(F.col("part") / fan).alias("part")
        copies = materialise(copies.groupBy(key).applyInPandas(_mean, schema), "lm-mean")
        if copies.count() <= fan:
            copies = materialise(copies.groupBy(F.lit(0).alias("part")).applyInPandas(_mean, schema), "lm-mean")
    row = copies.first()
    return bytes(row.weights) if row else None


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    copy_tokens: int = 4_000_000) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from all documents that aren't held out, counts and network alike: the network in
    one pass, a copy per ``copy_tokens`` training tokens, to which documents are dealt by a
    hash, in its order, so that the table alone and not its layout decides the scores.  Ids are long;
    ids of another type that don't read as a number are null.  Null texts count as
    empty (the end alone); null ids are never held out; repeated rows count as often
    as they stand; without training rows every token is unseen and scores 0; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       held_out(F.col(id_col)).alias("held"))
    both = materialise(rows.mapInArrow(_chunks, _PASS_SQL), "lm-chunks")
    words, texts = both.where("word is not null").select("chunk", "word", "n"), both.where("word is null")
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(size.n or 0), int(size.v)
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    head = {END: 0} | {bytes(r.word): i + 1 for i, r in enumerate(top)}
    apart = counts.where(~F.col("word").isin([F.lit(w) for w in head]))
    totals = {r.k: int(r.c) for r in apart.groupBy(_band(F.col("c"), F.col("word")).alias("k")).agg(F.sum("c").alias("c")).collect()}
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c").alias("c")).first().c or 0
    totals |= {0: int(ends)} | {i + 1: int(r.c) for i, r in enumerate(top)}
    ranks = docs.sparkSession.createDataFrame(list(head.items()), "word binary, rank int")  # HEAD + 1 rows
    known = counts.join(F.broadcast(ranks), "word", "left").select(
        "word", (F.col("c") * 256 + code_of(F.col("c"), F.col("word"), F.col("rank"))).alias("c"))
    vocabulary = words.join(known.hint("shuffle_hash"), "word", "left").select(
        F.col("chunk").alias("of"), "word", F.coalesce("c", F.lit(UNSEEN)).cast("long").alias("c"))
    coded = materialise(
        texts.select("chunk", "doc_id", "held", "text").groupBy("chunk")
        .cogroup(vocabulary.groupBy("of")).applyInPandas(_coder(totals, n, v), _CODED), "lm-coded")
    w = start_weights(np.array([totals.get(k, 0) for k in range(CODES)], float))
    if n:
        copies, mark = -(-n // copy_tokens), F.xxhash64("doc_id", "codes")
        learned = (coded.where("not held").select(F.pmod(mark, F.lit(copies)).alias("copy"), mark.alias("mark"), "codes")
                   .repartition(copies, "copy").sortWithinPartitions("copy", "mark", "codes").select("copy", "codes"))
        mean = averaged(learned.mapInArrow(_trainer(_pack(w), w), "part long, n long, weights binary"))
        w = _unpack(mean, w) if mean else w
    data, like = _pack(w), {k: np.empty(x.shape, np.float32) for k, x in w.items()}

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = _unpack(data, like)
        for df in batches:
            if len(df):
                sequences = [for_scoring(np.frombuffer(c, np.uint8)) for c in df["codes"]]
                score = log10_codes(weights, sequences) + df["within"].to_numpy() if n else np.zeros(len(df))
                yield df.drop(columns=["codes", "within"]).assign(score=score)

    out = coded.mapInPandas(scored, "doc_id long, held boolean, n_tokens long, n_known long, base double, score double")
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score")
