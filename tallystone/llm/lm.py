"""Scores of texts by a causal self-attention model over subword ids, trained in numpy.

A text is its words (runs of bytes other than white space) and an end. Each word is cut into subword ids of a
public vocabulary. Windows of the id sequence overlap: the last ``STRIDE`` places of each are scored, once
each, with masked attention over the window. Attention is over learned query, key and value vectors of ids
with a learned bias per distance; the output is a class of ids and an id within the class. A word's
probability mixes this with the word's share of all training words.

What is learned: the ids, word counts and id counts, the weights and the mixture's share, all of them from all
training texts. Only what the weights start from is made on the driver, on a few texts; the executors then train on
all texts, whole, and their weights are averaged.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.blas import one_thread
from tallystone.llm.bpe import public_vocabulary
from tallystone.llm.scratch import Scratch
from tallystone.llm.texthash import SOLID_BYTES, U64, chunks, string_buffers, word_hashes

WINDOW, STRIDE, DIM, CLASSES, MEMBERS = 32, 24, 16, 40, 40
N_IDS = CLASSES * MEMBERS
END, FIRST_SUBWORD, BEGIN = 256, 257, N_IDS
#: What the driver starts the weights on: about so many training documents (by hash), of a longer one a passage of
#: so many characters from a place given by its hash; so many steps of so many windows.
SAMPLE_DOCS, SAMPLE_CHARS, STEPS, STEP_WINDOWS = 1500, 1 << 15, 1000, 96
#: One of so many training documents (by hash, whole texts) goes on training the network, on the executors: all do.
TRAIN_EVERY = 1
#: Ratios of the two probabilities of words are told apart by steps of one part in so many of their logarithm, up to
#: so many steps either way, when the share is fitted.
RATIO_STEPS, MOST_STEPS = 64, 1 << 12
#: Pieces of ids that an executor holds at once while it trains, and rate of its steps.
HELD_PIECES, REFINE_RATE = 1 << 15, 0.005
#: The most frequent words whose counts every worker gets; counts of all others come by a join, for the mixture too.
HEAD_WORDS = 1 << 20
#: Texts of the sample that fit the mixture's share.
APART = slice(9, None, 10)
#: Weights travel, and are changed, in pieces of so many numbers.
SLICE = 1 << 14
CACHE_WORDS, CACHE_IDS = 600_000, 8_000_000
COUNT_BYTES, SCORE_BYTES = 1 << 20, 1 << 19
#: Windows that attention is computed for at once, and words whose scores are formed at once.
BLOCK_WINDOWS, BLOCK_WORDS = 288, 1 << 19
#: The hash that stands for the end of a text.
END_HASH = 0x656E646F66746578
#: Word characters that are merged at once.
_WORDS = " ?[^ ]{1,1024}"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- subwords


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The vocabulary as an encoder of words that begin with a space each, and the bytes of its tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        tokens[rank] = word
    return tiktoken.Encoding("subwords", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}), tokens, np.array([len(t) for t in tokens], np.int64)


def _ranks(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the tokens of all words one after another, and how many each word has."""
    encoding, _, size = _encoding(path)
    joined = b" ".join([b"", *words])
    try:
        text = joined.decode("utf-8")
    except UnicodeDecodeError:
        words = [w.decode("utf-8", "replace").encode("utf-8") for w in words]
        text = b" ".join([b"", *words]).decode("utf-8")
    ranks = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return ranks, np.diff(np.searchsorted(np.cumsum(size[ranks]), ends, side="left") + 1, prepend=0)


class Subwords:
    """The ids of the network: bytes, the end, and the vocabulary's tokens that are most frequent."""

    def __init__(self, path: str, chosen: list[int]):
        self.path, self.chosen = path, chosen
        self._spelling: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "chosen": self.chosen, "_spelling": None}

    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each rank where its ids begin and how many there are, and the ids."""
        if self._spelling is None:
            _, tokens, size = _encoding(self.path)
            own = np.full(len(tokens), -1)
            own[self.chosen] = FIRST_SUBWORD + np.arange(len(self.chosen))
            ids = np.concatenate([np.frombuffer(b"".join(tokens), np.uint8).astype(np.int16), np.arange(FIRST_SUBWORD, FIRST_SUBWORD + len(self.chosen), dtype=np.int16)])
            start = np.where(own >= 0, int(size.sum()) + own - FIRST_SUBWORD, np.cumsum(size) - size)
            self._spelling = start, np.where(own >= 0, 1, size), ids
        return self._spelling

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        if not words:
            return np.zeros(0, np.int16), np.zeros(0, np.int64)
        start, size, spelling = self._spelled()
        ranks, count = _ranks(self.path, words)
        n = size[ranks]
        begin = np.cumsum(n) - n
        flat = spelling[np.repeat(start[ranks] - begin, n) + np.arange(int(n.sum()), dtype=np.int64)]
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])[np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])]
        return flat, np.diff(edges)

    @classmethod
    def choose(cls, path: str, times: np.ndarray) -> Subwords:
        """Those that occur most, by how often each rank of the vocabulary occurs."""
        found = np.flatnonzero((times > 0) & (_encoding(path)[2] > 1))
        return cls(path, found[np.lexsort((found, -times[found]))][: N_IDS - FIRST_SUBWORD].tolist())


def rank_counts(path: str, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """How often each rank of the vocabulary occurs in words that occur ``times`` each."""
    ranks, count = _ranks(path, words) if words else (np.zeros(0, np.int64),) * 2
    return np.bincount(ranks, weights=np.repeat(times, count), minlength=len(_encoding(path)[2])).astype(np.int64)


# ---------------------------------------------------------------- network


@dataclass
class Network:
    """Parameters as float32 arrays; ids have been renumbered so that id = class * MEMBERS + member."""

    query: np.ndarray  # (N_IDS + 1, DIM)
    key: np.ndarray
    value: np.ndarray
    near: np.ndarray  # (WINDOW,) bias by distance
    class_of: np.ndarray  # (N_IDS + 1, CLASSES) class logits of the id before
    class_out: np.ndarray  # (DIM, CLASSES)
    last: np.ndarray  # (N_IDS + 1, DIM)
    mix: np.ndarray  # (DIM, DIM)
    member: np.ndarray  # (CLASSES, MEMBERS, DIM)
    member_bias: np.ndarray  # (CLASSES, MEMBERS)

    #: Whether scores may be too large for a plain exponential.
    steep: bool = True

    def wide_value(self) -> np.ndarray:
        return np.hstack([self.value, np.ones((len(self.value), 1), np.float32)])

    def wide_member(self) -> np.ndarray:
        """(CLASSES, DIM + 1, MEMBERS): weights of the ids of each class, and their biases."""
        return np.ascontiguousarray(np.concatenate([self.member.transpose(0, 2, 1), self.member_bias[:, None, :]], axis=1))

    def settle(self) -> Network:
        """Find out whether scores are bounded, so that the scan needs no pass for their maxima.

        A context is a mean of value vectors, so a linear score of it lies between those of single vectors.
        """
        member, bias = self.member.reshape(-1, DIM), self.member_bias.ravel()
        attention = self.query @ self.key.T
        of_context, of_last = self.value @ self.class_out, self.class_of
        inner, inner_last = self.value @ (member @ self.mix.T).T, self.last @ member.T
        high = [attention.max() + self.near.max(), (of_context.max(axis=0) + of_last.max(axis=0)).max(), (inner.max(axis=0) + inner_last.max(axis=0) + bias).max()]
        low = [attention.min() + self.near.min(), (of_context.min(axis=0) + of_last.min(axis=0)).min(), (inner.min(axis=0) + inner_last.min(axis=0) + bias).min()]
        self.steep = bool(max(high) > 75.0 or min(low) < -75.0)
        return self

    def copy(self) -> Network:
        return Network(*(p.copy() for p in self.arrays()), steep=self.steep)

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        """Arrays of the same shapes that lie in ``flat``."""
        edges = np.cumsum([0] + [p.size for p in self.arrays()])
        return [flat[a:b].reshape(p.shape) for p, a, b in zip(self.arrays(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def take(self, arrays: list[np.ndarray]) -> None:
        """Let the weights lie in other arrays."""
        self.query, self.key, self.value, self.near, self.class_of, self.class_out, self.last, self.mix, self.member, self.member_bias = arrays

    def like(self, flat: np.ndarray) -> Network:
        """A network of the same shapes with the weights of ``flat``."""
        return Network(*(p.astype(np.float32) for p in self.views(flat)))

    def arrays(self) -> list[np.ndarray]:
        return [self.query, self.key, self.value, self.near, self.class_of, self.class_out, self.last, self.mix, self.member, self.member_bias]


_DIST = (np.arange(STRIDE)[:, None] + (WINDOW - STRIDE)) - np.arange(WINDOW)[None, :]
_CAUSAL = _DIST >= 0


class Layout:
    """Sequences laid out so that windows follow each other at a fixed distance.

    Each sequence has an empty stretch of STRIDE places in front, whose last ones its first window reaches back to,
    and fills up whole stretches. The window of a stretch attends to it and to the places just before it.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        stretches = -(-lengths // STRIDE) + 1
        self.n = int(stretches.sum())
        size = self.n * STRIDE
        #: the id before each place (BEGIN at a sequence's first), behind as many places as the first window reaches back to
        self.seen = np.zeros(WINDOW - STRIDE + size, ids.dtype)
        self.before = self.seen[WINDOW - STRIDE :]
        self.goal, self.real = np.zeros(size, ids.dtype), np.zeros(size, bool)
        begins = (np.cumsum(stretches) - stretches + 1) * STRIDE
        #: whether a stretch is the first of a sequence
        self.first = np.zeros(self.n, bool)
        self.first[begins // STRIDE] = True
        ends = np.cumsum(lengths)
        for at, a, b in zip(begins.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
            self.before[at] = BEGIN
            self.before[at + 1 : at + b - a] = ids[a : b - 1]
            self.goal[at : at + b - a] = ids[a:b]
            self.real[at : at + b - a] = True

    def windows(self, table: np.ndarray, a: int, b: int) -> np.ndarray:
        """(b - a, WINDOW, columns): rows of a table for the places that the windows from a to b attend to; a view."""
        rows = table.take(self.seen[a * STRIDE : b * STRIDE + WINDOW - STRIDE], axis=0, mode="clip")
        return self._sliding(rows, b - a)

    @staticmethod
    def _sliding(rows: np.ndarray, n: int) -> np.ndarray:
        return np.lib.stride_tricks.as_strided(rows, (n, WINDOW, *rows.shape[1:]), (STRIDE * rows.strides[0], *rows.strides), writeable=False)


def inputs_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """At each place the id before it; BEGIN at a sequence's first place."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(lengths) - lengths] = BEGIN
    return out


def _masked(net: Network) -> np.ndarray:
    """What is added to the attention scores of a window."""
    return np.where(_CAUSAL, net.near[np.maximum(_DIST, 0)], np.float32(-1e9))


def _attend(net: Network, mask: np.ndarray, at: Layout, a: int, b: int, out: np.ndarray) -> np.ndarray:
    """Unscaled attention of the windows from a to b."""
    q = net.query.take(at.before[a * STRIDE : b * STRIDE], axis=0, mode="clip").reshape(b - a, STRIDE, DIM)
    k = at.windows(net.key, a, b)
    weight = np.matmul(q, k.transpose(0, 2, 1), out=out)
    weight += mask
    if net.steep:
        np.minimum(weight, 60.0, out=weight)
    np.exp(weight, out=weight)
    weight[at.first[a:b], :, : WINDOW - STRIDE] = 0.0
    return weight


def _sums(exponentials: np.ndarray) -> np.ndarray:
    return exponentials @ np.ones(exponentials.shape[1], np.float32)


def log_probabilities(net: Network, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of every id given those before it in its sequence; some windows at a time."""
    if not len(ids):
        return np.zeros(0)
    layout = Layout(ids, lengths)
    mask, values, members, kind = _masked(net), net.wide_value(), net.wide_member(), net.class_out.dtype
    out, at = np.empty(len(ids), kind), 0
    # made once: new memory for each block would cost as much as what is done in it
    room = np.empty((BLOCK_WINDOWS, STRIDE, WINDOW), kind), *(np.empty((BLOCK_WINDOWS * STRIDE, n), kind) for n in (CLASSES, CLASSES, MEMBERS, DIM + 1))
    for a in range(0, layout.n, BLOCK_WINDOWS):
        b = min(a + BLOCK_WINDOWS, layout.n)
        weight = _attend(net, mask, layout, a, b, room[0][: b - a])
        # the last column of the values is one: it gathers the sum of the weights
        own = slice(a * STRIDE, b * STRIDE)
        real = np.flatnonzero(layout.real[own])
        wide = np.matmul(weight, layout.windows(values, a, b)).reshape(-1, DIM + 1).take(real, axis=0)
        out[at : at + len(real)] = _output(net, members, wide[:, :DIM] / wide[:, DIM:], layout.before[own].take(real), layout.goal[own].take(real).astype(np.int64), room[1:])
        at += len(real)
    return out


def _output(net: Network, members: np.ndarray, context: np.ndarray, came: np.ndarray, goal: np.ndarray, room: tuple[np.ndarray, ...]) -> np.ndarray:
    """Log probabilities of the ids ``goal`` for given contexts and ids before them."""
    n = len(goal)
    z, more, m, state = (r[:n] for r in room)
    group, inner = goal // MEMBERS, goal % MEMBERS
    net.class_of.take(came, axis=0, mode="clip", out=z)
    z += np.matmul(context, net.class_out, out=more)
    rows = np.arange(n)
    if net.steep:
        z -= z.max(axis=1, keepdims=True)
    out = z[rows, group].astype(np.float64)
    np.exp(z, out=z)
    out -= np.log(_sums(z))
    order = np.argsort(group.astype(np.uint8), kind="stable")
    # a last component of one, for the biases
    state[:, DIM] = 1.0
    np.add(context.take(order, axis=0) @ net.mix, net.last.take(came.take(order), axis=0, mode="clip"), out=state[:, :DIM])
    edges = np.searchsorted(group.take(order), np.arange(CLASSES + 1)).tolist()
    for c in range(CLASSES):
        if edges[c] < edges[c + 1]:
            np.matmul(state[edges[c] : edges[c + 1]], members[c], out=m[edges[c] : edges[c + 1]])
    if net.steep:
        m -= m.max(axis=1, keepdims=True)
    hit = m[rows, inner.take(order)]
    np.exp(m, out=m)
    out[order] += hit - np.log(_sums(m))
    return out


class Room:
    """Memory that one step after another works in: new pages for each step would cost as much as what is done in them."""

    def __init__(self):
        self._held: dict[str, np.ndarray] = {}

    def get(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        """An array of any content; the same memory for the same name."""
        size = math.prod(shape)
        held = self._held.get(name)
        if held is None or len(held) < size:
            held = self._held[name] = np.empty(size, kind)
        return held[:size].reshape(shape)

    def zeros(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        out = self.get(name, *shape, kind=kind)
        out.fill(0)
        return out

    def rows(self, name: str, table: np.ndarray, index: np.ndarray) -> np.ndarray:
        return table.take(index, axis=0, mode="clip", out=self.get(name, *index.shape, table.shape[1], kind=table.dtype))


def _softmax(z: np.ndarray, goal: np.ndarray, weight: np.ndarray, total: np.ndarray) -> float:
    """In place, ``weight`` of each row times the gradient of its loss by its logits; ``total``: room for a row's sum.

    Gives the weighted sum of the losses. Logits are bounded rather than moved by their maximum, which takes one pass.
    """
    rows = np.arange(len(z))
    np.clip(z, -60.0, 60.0, out=z)
    hit = z[rows, goal]
    np.exp(z, out=z)
    np.matmul(z, np.ones(z.shape[1], np.float32), out=total)
    loss = float(((np.log(total) - hit) * weight).sum(dtype=np.float64))
    np.divide(weight, total, out=total)
    z *= total[:, None]
    z[rows, goal] -= weight
    return loss


def _gradients(net: Network, ids: np.ndarray, lengths: np.ndarray, room: Room | None = None, into: list[np.ndarray] | None = None) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the ids of some sequences, and its gradients; those go into ``into`` if given.

    The sequences lie in a grid of equal rows, behind as many empty places as their first windows reach back to.
    Places past a sequence's end have no weight, and nothing real attends to them.
    """
    room = room or Room()
    get, reach = room.get, WINDOW - STRIDE
    n, stretches = len(lengths), max(1, -(-int(lengths.max()) // STRIDE))
    width, size = stretches * STRIDE, n * stretches * STRIDE
    at = np.repeat(np.arange(n) * width - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))
    goal, weight_of = room.zeros("goal", size, kind=np.int64), room.zeros("weight_of", size)
    goal[at], weight_of[at] = ids, 1.0 / len(ids)
    seen = room.zeros("seen", n, reach + width, kind=np.int64)
    seen[:, reach] = BEGIN
    seen[:, reach + 1 :] = goal.reshape(n, width)[:, :-1]
    came = get("came", size, kind=np.int64)
    came.reshape(n, width)[:] = seen[:, reach:]
    of_window = lambda a: np.lib.stride_tricks.as_strided(a, (n, stretches, WINDOW, a.shape[2]), (a.strides[0], STRIDE * a.strides[1], *a.strides[1:]), writeable=False)

    # attention, unscaled; the last column of the values is one, which gathers the sum of the weights
    q = room.rows("q", net.query, came).reshape(n, stretches, STRIDE, DIM)
    k, v = of_window(room.rows("k", net.key, seen)), of_window(room.rows("v", net.wide_value(), seen))
    weight = np.matmul(q, k.swapaxes(2, 3), out=get("weight", n, stretches, STRIDE, WINDOW))
    np.clip(weight, -60.0, 60.0, out=weight)
    weight += _masked(net)
    np.exp(weight, out=weight)
    weight[:, 0, :, :reach] = 0.0
    wide = np.matmul(weight, v, out=get("wide", n, stretches, STRIDE, DIM + 1)).reshape(size, DIM + 1)
    scale = get("scale", size, 1)
    np.divide(1.0, wide[:, DIM:], out=scale)
    ctx = np.multiply(wide[:, :DIM], scale, out=get("ctx", size, DIM))

    # the class
    p = np.matmul(ctx, net.class_out, out=get("p", size, CLASSES))
    p += room.rows("class_of", net.class_of, came)
    group, inner = goal // MEMBERS, goal % MEMBERS
    total = get("total", size)
    loss = _softmax(p, group, weight_of, total)
    d_ctx = np.matmul(p, net.class_out.T, out=get("d_ctx", size, DIM))

    # the id within the class, class by class; the last component of the state is one, for the biases
    order = np.argsort(group.astype(np.uint8), kind="stable")
    edges = np.searchsorted(group.take(order), np.arange(CLASSES + 1)).tolist()
    last = np.matmul(ctx, net.mix, out=get("last", size, DIM))
    last += room.rows("last_of", net.last, came)
    state = get("state", size, DIM + 1)
    state[:, :DIM], state[:, DIM] = room.rows("sorted", last, order), 1.0
    members, e, back = net.wide_member(), get("e", size, MEMBERS), get("back", size, DIM)
    for c in range(CLASSES):
        own = slice(edges[c], edges[c + 1])
        np.matmul(state[own], members[c], out=e[own])
    loss += _softmax(e, inner.take(order), weight_of.take(order), total)
    if into is None:
        into = [np.empty_like(x) for x in net.arrays()]
    d_query, d_key, d_value, d_near, d_class_of, d_class_out, d_last, d_mix, d_member, d_bias = into
    for c in range(CLASSES):
        own = slice(edges[c], edges[c + 1])
        np.matmul(e[own], net.member[c], out=back[own])
        both = e[own].T @ state[own]
        d_member[c], d_bias[c] = both[:, :DIM], both[:, DIM]
    d_state = get("d_state", size, DIM)
    d_state[order] = back
    np.matmul(ctx.T, p, out=d_class_out)
    np.matmul(ctx.T, d_state, out=d_mix)
    d_ctx += np.matmul(d_state, net.mix.T, out=back)

    # back through the attention: a weight's gradient is its own part less the mean, which the column of ones takes off
    full = get("full", size, DIM + 1)
    np.multiply(d_ctx, scale, out=full[:, :DIM])
    np.negative(np.einsum("ij,ij->i", full[:, :DIM], ctx), out=full[:, DIM])
    full = full.reshape(n, stretches, STRIDE, DIM + 1)
    d_v = np.matmul(weight.swapaxes(2, 3), full, out=get("d_v", n, stretches, WINDOW, DIM + 1))
    d_score = np.matmul(full, v.swapaxes(2, 3), out=get("d_score", n, stretches, STRIDE, WINDOW))
    d_score *= weight
    d_q = np.matmul(d_score, k, out=get("d_q", n, stretches, STRIDE, DIM)).reshape(size, DIM)
    d_k = np.matmul(d_score.swapaxes(2, 3), q, out=get("d_k", n, stretches, WINDOW, DIM))
    of_place = (np.ones(n * stretches, np.float32) @ d_score.reshape(n * stretches, -1)).reshape(STRIDE, WINDOW)
    d_near[:] = np.bincount(np.maximum(_DIST, 0).ravel(), weights=(of_place * _CAUSAL).ravel(), minlength=WINDOW)[:WINDOW]

    # the rows' gradients side by side, in order of ids; places are in up to two windows
    side = get("side", size, 4 * DIM + CLASSES)
    side[:, :DIM], side[:, DIM : 2 * DIM], side[:, 4 * DIM :] = d_q, d_state, p
    for i, x in ((2, d_k), (3, d_v)):
        place = side[:, i * DIM : (i + 1) * DIM].reshape(n, stretches, STRIDE, DIM)
        place[:] = x[:, :, reach:, :DIM]
        place[:, :-1, STRIDE - reach :] += x[:, 1:, :reach, :DIM]
    sums = _by_id(came, side, room)
    d_query[:], d_last[:], d_key[:], d_value[:], d_class_of[:] = (sums[:, i * DIM : (i + 1) * DIM if i < 4 else None] for i in range(5))
    return loss, into


def _by_id(ids: np.ndarray, rows: np.ndarray, room: Room) -> np.ndarray:
    """Sums of rows by id, as products with a matrix that tells the ids of a run of MEMBERS apart."""
    group = (ids // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group.take(order), np.arange(CLASSES + 2)).tolist()
    which = room.zeros("which", len(ids), MEMBERS)
    which[np.arange(len(ids)), (ids % MEMBERS).take(order)] = 1.0
    rows = room.rows("in_order", rows, order)
    out = room.get("by_id", N_IDS + 1, rows.shape[1])
    for c in range(CLASSES):
        own = slice(edges[c], edges[c + 1])
        np.matmul(which[own].T, rows[own], out=out[c * MEMBERS : (c + 1) * MEMBERS])
    np.sum(rows[edges[CLASSES] :], axis=0, out=out[BEGIN])
    return out


def id_counts(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of classes after ids, then of ids, of sequences that lie one after another."""
    pairs = np.zeros((N_IDS + 1) * CLASSES, np.int64)
    before = inputs_of(ids, lengths)
    for a in range(0, len(ids), 1 << 20):
        pairs += np.bincount(before[a : a + (1 << 20)].astype(np.int64) * CLASSES + ids[a : a + (1 << 20)] // MEMBERS, minlength=len(pairs))
    return np.append(pairs, np.bincount(ids, minlength=N_IDS))


def _started(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class logits after ids and biases of ids within classes, from ``id_counts``."""
    counts = np.maximum(counts, 0)
    after, alone = counts[:-N_IDS].reshape(N_IDS + 1, CLASSES), counts[-N_IDS:] + 0.1
    share = alone.reshape(CLASSES, MEMBERS).sum(axis=1) / alone.sum()
    class_of = np.log((after + 2.0 * share) / (after.sum(axis=1, keepdims=True) + 2.0))
    return class_of.astype(np.float32), np.log(alone.reshape(CLASSES, MEMBERS)).astype(np.float32)


def _pieces(ids: np.ndarray) -> list[np.ndarray]:
    """Pieces that one step takes whole: three windows each, so that most places have a full context."""
    return [ids[a : a + 3 * STRIDE] for a in range(0, len(ids), 3 * STRIDE)]


class Adam:
    """Steps on the weights of a network, with moments that last from call to call; all in memory held for it."""

    def __init__(self, net: Network):
        self.net, self.step, self.room = net, 0, Room()
        self.weights = np.concatenate([p.ravel() for p in net.arrays()])
        self.grads, self.first, self.second, self.spare = (np.zeros_like(self.weights) for _ in range(4))
        self.into = net.views(self.grads)
        net.take(net.views(self.weights))

    def take(self, batch: list[np.ndarray], rate: float) -> float:
        loss, _ = _gradients(self.net, np.concatenate(batch), np.array([len(b) for b in batch]), self.room, self.into)
        self.step += 1
        one, two = 1 - 0.9**self.step, 1 - 0.99**self.step
        # a run of weights at a time, which stays in the processor's cache
        for a in range(0, len(self.weights), SLICE):
            p, g, m, v, t = (x[a : a + SLICE] for x in (self.weights, self.grads, self.first, self.second, self.spare))
            np.multiply(g, g, out=t)
            t -= v
            t *= 0.01
            v += t
            g -= m
            g *= 0.1
            m += g
            np.multiply(v, 1 / two, out=t)
            np.sqrt(t, out=t)
            t += 1e-8
            np.divide(m, t, out=t)
            t *= rate / one
            p -= t
        return loss


PER_STEP = max(1, STEP_WINDOWS // 3)


def train(sequences: list[np.ndarray], *, steps: int = STEPS, seed: int = 11, start: np.ndarray | None = None) -> Network:
    """Adam over windows of the sequences; starts from ``id_counts``, those of the sequences if none are given."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    if start is None:
        start = sum((id_counts(q, np.array([len(q)])) for q in sequences), np.zeros((N_IDS + 1) * CLASSES + N_IDS, np.int64))
    class_of, bias = _started(start)
    net = Network(small(N_IDS + 1, DIM), small(N_IDS + 1, DIM), small(N_IDS + 1, DIM), np.zeros(WINDOW, np.float32), class_of, small(DIM, CLASSES), small(N_IDS + 1, DIM), small(DIM, DIM), small(CLASSES, MEMBERS, DIM), bias)
    pieces = [p for s in sequences for p in _pieces(s)]
    if not pieces:
        return net.settle()
    adam, order, at = Adam(net), rng.permutation(len(pieces)), 0
    for step in range(1, steps + 1):
        if at + PER_STEP > len(order):
            order, at = rng.permutation(len(pieces)), 0
        adam.take([pieces[i] for i in order[at : at + PER_STEP]], 0.02 * min(1.0, step / 30) * (1 - 0.95 * step / steps))
        at += PER_STEP
    return net.settle()


def refined(net: Network, sequences: Iterator[np.ndarray], *, seed: int = 13) -> int:
    """Train ``net`` once over all sequences, some pieces at a time; gives the number of pieces."""
    rng, adam, held, done = np.random.default_rng(seed), Adam(net), [], 0

    def spend() -> None:
        order = rng.permutation(len(held))
        for a in range(0, len(order), PER_STEP):
            batch = [held[i] for i in order[a : a + PER_STEP]]
            adam.take(batch, REFINE_RATE * min(1.0, (adam.step + 1) / 30) * len(batch) / PER_STEP)
        held.clear()

    for ids in sequences:
        for piece in _pieces(ids):
            held.append(piece)
            done += 1
            if len(held) >= HELD_PIECES:
                spend()
    spend()
    return done


@dataclass
class Model:
    subwords: Subwords
    number: np.ndarray  # id of the subwords -> id of the network
    net: Network | None
    share: float  # of the word counts in the mixture
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  # of the ids


def _split(text: bytes) -> list[bytes]:
    """Lower-cased words, split at ASCII white space."""
    return LOWER[np.frombuffer(text, np.uint8)].tobytes().split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the words of a text and of its end."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    return np.append(word_hashes(data, np.array([0, len(data)]), SOLID_BYTES)[0].view(np.int64), END_HASH)


def chosen(texts: list[bytes], path: str) -> Model:
    """``numbered`` for the words of some texts."""
    tally: dict[bytes, int] = {}
    for text in texts:
        for w in _split(text):
            tally[w] = tally.get(w, 0) + 1
    return numbered(path, rank_counts(path, list(tally), np.fromiter(tally.values(), np.int64, len(tally))), len(texts))


def numbered(path: str, times: np.ndarray, texts: int) -> Model:
    """The ids of the network, and their numbers in order of their frequency, by how often each rank of the vocabulary
    occurs in so many texts; not trained yet."""
    subwords = Subwords.choose(path, times)
    start, size, spelling = subwords._spelled()
    often = np.zeros(N_IDS, np.int64)
    for r in np.flatnonzero(times).tolist():
        np.add.at(often, spelling[start[r] : start[r] + size[r]], times[r])
    often[END] = texts
    number = np.empty(N_IDS + 1, np.int64)
    number[np.lexsort((np.arange(N_IDS), -often))] = np.arange(N_IDS)
    number[N_IDS] = BEGIN
    return Model(subwords, number, None, 0.5)


def fit(model: Model, texts: list[bytes], counts: dict[int, int], total: int, *, steps: int = STEPS, started: np.ndarray | None = None, refine: Callable[[Model], Network] | None = None) -> Model:
    """Train the network on nine of ten texts, and fit the mixture's share on the others.

    ``started``: the ``id_counts`` of all training texts, these ones among them, which the network starts from
    without those of the texts of the share. ``refine`` gives the network after more training.
    """
    split = [_split(t) for t in texts]
    end = np.array([model.number[END]])
    coded_, sizes = [], []
    for words in split:
        ids, size = model.subwords.ids(words)
        coded_.append(np.append(model.number[ids], end))
        sizes.append(np.append(size, 1))
    apart = range(len(split))[APART]
    if started is not None:
        started = started - sum((id_counts(coded_[i], np.array([len(coded_[i])])) for i in apart), np.zeros_like(started))
    with one_thread():
        model.net = train([s for i, s in enumerate(coded_) if i % 10 != 9], steps=steps, start=started)
    if refine:
        model.net = refine(model).settle()
    lp, lh = [], []
    for i in apart:
        own = log_probabilities(model.net, coded_[i], np.array([len(coded_[i])]))
        lp.append(np.add.reduceat(own.astype(np.float64), np.cumsum(sizes[i]) - sizes[i]))
        hashes = _hashes(split[i])
        # as if the text itself had not been counted
        _, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
        known = np.array([counts.get(h, 0) for h in hashes.tolist()], np.float64)
        lh.append(np.maximum(0.0, known - times[place]) / max(1, total - len(hashes)))
    if lp:
        a, b = np.concatenate(lh), np.exp(np.concatenate(lp))
        for _ in range(30):
            top = model.share * a
            model.share = float(np.clip((top / (top + (1 - model.share) * b + 1e-300)).mean(), 0.01, 0.99))
    return model


# ---------------------------------------------------------------- workers


class WordTable:
    """The ids of words by their hashes; bounded."""

    def __init__(self, model: Model):
        self.model, self.age = model, 0
        self._clear()

    def _clear(self) -> None:
        self.age += 1
        self.keys, self.rows = np.zeros(0, U64), np.zeros(0, np.int64)
        self.n, self.used = 0, 0
        self.flat, self.start, self.length = np.zeros(1 << 16, np.int16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        #: the hash of each row
        self.hashes = np.zeros(1 << 14, np.int64)
        self._add(np.array([END_HASH]).view(U64), self.model.number[[END]], np.ones(1, np.int64))

    def _add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.n + len(hashes) > len(self.start):
            self.start, self.length, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hashes))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = slice(self.n, self.n + len(hashes))
        self.start[at], self.length[at], self.hashes[at] = self.used + np.cumsum(lengths) - lengths, lengths, hashes.view(np.int64)
        self.n, self.used = self.n + len(hashes), self.used + len(ids)

    def places(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of this table for words given by hash, in order, and by where they stand in ``data``."""
        if self.n > CACHE_WORDS or self.used > CACHE_IDS:
            self._clear()
        at = np.searchsorted(self.keys, hashes)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            raw = data.data if data.flags.c_contiguous else data.tobytes()
            ids, lengths = self.model.subwords.ids([bytes(raw[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            rows = np.arange(self.n, self.n + len(new))
            self._add(hashes[new], self.model.number[ids], lengths)
            self.keys, self.rows = np.insert(self.keys, at[new], hashes[new]), np.insert(self.rows, at[new], rows)
            at = at + np.searchsorted(new, np.arange(len(at)))
        return self.rows[at]


_TABLES: dict[str, WordTable] = {}


def _table(model: Model) -> WordTable:
    """This worker's table of the model's ids; that of an earlier model goes."""
    if model.name not in _TABLES:
        _TABLES.clear()
        _TABLES[model.name] = WordTable(model)
    return _TABLES[model.name]


@dataclass
class Coded:
    """Rows of text as words and ids; each row's words are followed by its end."""

    table: WordTable
    word: np.ndarray  # row of the table
    words: np.ndarray  # words of each row, without the end

    def ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where the ids of each word begin, ids of each row)"""
        parts, begin, at = [], np.empty(len(self.word), np.int64), 0
        for a in range(0, len(self.word), BLOCK_WORDS):
            own = self.word[a : a + BLOCK_WORDS]
            lengths = self.table.length[own]
            first = np.cumsum(lengths) - lengths
            parts.append(self.table.flat[np.repeat(self.table.start[own] - first, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)])
            begin[a : a + BLOCK_WORDS] = first + at
            at += len(parts[-1])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int16)
        return flat, begin, np.diff(np.append(begin[self.row_at], len(flat)))

    @property
    def row_at(self) -> np.ndarray:
        """Where rows begin among words and ends."""
        return np.cumsum(self.words + 1) - (self.words + 1)


def coded(table: WordTable, text: np.ndarray, offsets: np.ndarray) -> Coded:
    hashes, starts, ends, rows = word_hashes(text, offsets, SOLID_BYTES)
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    places = table.places(distinct, text, starts[first], ends[first])
    del starts, ends
    n = np.diff(rows)
    word = np.zeros(len(hashes) + len(n), np.int32)  # row 0 of the table is the end
    inner = np.ones(len(word), bool)
    inner[rows[1:] + np.arange(len(n))] = False
    word[inner] = places[which]
    return Coded(table, word, n)


def _parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, lower-cased bytes, offsets) of parts of a column of texts."""
    data, offsets = string_buffers(batch.column(column))
    for a, b in chunks(offsets, most):
        yield a, b, LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]


WORD, ID = 0, 1


def ranked_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(rank, c): how often each rank of the vocabulary occurs in the texts of a task."""
    out = np.zeros(len(_encoding(path)[2]), np.int64)
    for batch in batches:
        for _, _, text, own in _parts(batch, 0, COUNT_BYTES):
            hashes, starts, ends, _ = word_hashes(text, own, SOLID_BYTES)
            _, first, times = np.unique(hashes, return_index=True, return_counts=True)
            raw = text.tobytes()
            out += rank_counts(path, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], times)
    found = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(out[found])], names=["rank", "c"])


def counted_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(kind, h, c): counts of the words of texts by hash, ends included, for each batch, and for the whole task the
    places in ``id_counts`` that its texts reach."""
    table = _table(shared.value)
    out = np.zeros((N_IDS + 1) * CLASSES + N_IDS, np.int64)
    for batch in batches:
        for _, _, text, own in _parts(batch, 0, COUNT_BYTES):
            c = coded(table, text, own)
            ids, _, row_ids = c.ids()
            out += id_counts(ids, row_ids)
            times = np.bincount(c.word, minlength=table.n)
            yield _tallies(WORD, table.hashes[np.flatnonzero(times)], times[times > 0])
    yield _tallies(ID, np.flatnonzero(out), out[out > 0])


def _tallies(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts.astype(np.int64))], names=["kind", "h", "c"])


def refined_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """A task's weights after training on its texts, times the number of its pieces of ids."""
    given = shared.value
    table, net = _table(given), given.net.copy()

    def sequences() -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, text, own in _parts(batch, 0, SCORE_BYTES):
                ids, _, row_ids = coded(table, text, own).ids()
                edges = np.cumsum(row_ids)
                for a, b in zip((edges - row_ids).tolist(), edges.tolist(), strict=True):
                    yield ids[a:b]

    with one_thread():
        n = refined(net, sequences())
    flat = np.concatenate([p.ravel() for p in net.arrays()]).astype(np.float64) * n
    parts = [flat[a : a + SLICE].tobytes() for a in range(0, len(flat), SLICE)] if n else []
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["slice", "n", "weights"])


def summed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slice."""
    total: dict[int, list] = {}
    for batch in batches:
        for k, n, raw in zip(*(batch.column(c).to_pylist() for c in ("slice", "n", "weights")), strict=True):
            own = total.setdefault(k, [0, 0.0])
            own[0], own[1] = own[0] + n, own[1] + np.frombuffer(raw)
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1].tobytes() for k in keys], pa.binary())], names=["slice", "n", "weights"])


#: A row for each text; for each task further rows with ``step`` and ``n`` alone.
SCORED_SCHEMA = "uid long, doc_id long, n_tokens long, known long, part double, plain double, ratios binary, fresh boolean, rare array<struct<h: long, lp: array<double>>>, step int, n long"
_RARE = pa.list_(pa.struct([("h", pa.int64()), ("lp", pa.list_(pa.float64()))]))
#: The step of words that no other text has.
NEVER = -MOST_STEPS - 1


class Scorer:
    """Scores of coded rows under a model and the counts of frequent words."""

    def __init__(self, model: Model, heads: np.ndarray, counts: np.ndarray, total: int):
        self.model, self.heads, self.counts, self.total = model, heads, counts, total
        self.age, self.hit, self.count = -1, np.zeros(0, bool), np.zeros(0)

    def _counted(self, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """(whether the count is known here, the count) for each row of the table."""
        if self.age != table.age:
            self.age, self.hit, self.count = table.age, np.zeros(0, bool), np.zeros(0)
        if len(self.hit) < table.n and len(self.heads):
            new = table.hashes[len(self.hit) : table.n]
            at = np.minimum(np.searchsorted(self.heads, new), len(self.heads) - 1)
            hit = self.heads[at] == new
            self.hit, self.count = np.append(self.hit, hit), np.append(self.count, np.where(hit, self.counts[at], 0))
        return (self.hit, self.count) if len(self.heads) else (np.zeros(table.n, bool), np.zeros(table.n))

    def words(self, c: Coded) -> np.ndarray:
        """The network's log probability of each word and end."""
        ids, begin, row_ids = c.ids()
        of_ids = log_probabilities(self.model.net, ids, row_ids)
        out = np.empty(len(c.word))
        for a in range(0, len(out), BLOCK_WORDS):
            b = min(a + BLOCK_WORDS, len(out))
            stop = begin[b] if b < len(begin) else len(ids)
            out[a:b] = np.add.reduceat(of_ids[begin[a] : stop].astype(np.float64), begin[a:b] - begin[a])
        return out

    def steps(self, c: Coded, lp: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """For each step from NEVER on, how many words and ends of the rows that are ``fresh`` have that ratio of their
        share of the words of all other training texts to the network's mean probability of them in their row; those
        alone whose count is known here."""
        hit, count = self._counted(c.table)
        if len(c.words) == 1:
            of = np.bincount(c.word, minlength=c.table.n)
            own = np.flatnonzero(of) if fresh[0] else np.zeros(0, np.int64)
            times, mean, size = of[own], np.bincount(c.word, weights=lp, minlength=c.table.n)[own], np.full(len(own), c.words[0] + 1)
        else:
            row = np.repeat(np.arange(len(c.words)), c.words + 1)
            some = np.flatnonzero(fresh[row])
            keys, place, times = np.unique(row[some] * c.table.n + c.word[some], return_inverse=True, return_counts=True)
            own, mean = keys % c.table.n, np.bincount(place, weights=lp[some], minlength=len(keys))
            size = (c.words + 1)[keys // c.table.n]
        here = hit[own]
        own, times, mean, size = own[here], times[here], mean[here] / times[here], size[here]
        others = count[own] - times
        ratio = np.log(np.maximum(1, others) / np.maximum(1, self.total - size)) - mean
        at = np.where(others > 0, np.clip(np.floor(ratio * RATIO_STEPS), -MOST_STEPS, MOST_STEPS), NEVER).astype(np.int64)
        return np.bincount(at - NEVER, weights=times, minlength=2 * MOST_STEPS + 2).astype(np.int64)

    def rows(self, c: Coded, lp: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each row how many words and ends have known counts, and sums over these of log10(count + 1) and of
        ``lp``; the logarithm of the ratio of the share of each of them to the network's probability; the other
        words: row, hash and network's log probability of each."""
        n_rows = len(c.words)
        known, part, plain = np.zeros(n_rows, np.int64), np.zeros(n_rows), np.zeros(n_rows)
        hit, count = self._counted(c.table)
        of_word = np.log(np.maximum(count, 1.0) / max(1, self.total)), np.log10(count + 1.0)
        edges = np.append(c.row_at, len(c.word))
        rest: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(c.word), BLOCK_WORDS):
            own, own_lp = c.word[a : a + BLOCK_WORDS], lp[a : a + BLOCK_WORDS]
            here = hit[own]
            row = np.searchsorted(edges, np.arange(a, a + len(own)), side="right") - 1
            known += np.bincount(row, weights=here, minlength=n_rows).astype(np.int64)
            part += np.bincount(row, weights=np.where(here, of_word[1][own], 0.0), minlength=n_rows)
            plain += np.bincount(row, weights=np.where(here, own_lp, 0.0), minlength=n_rows)
            rest.append(((of_word[0][own] - own_lp)[here].astype(np.float32), row[~here].astype(np.int32), c.table.hashes[own[~here]], own_lp[~here]))
        return known, part, plain, *(np.concatenate([r[i] for r in rest]) for i in range(4))


def fitted_share(share: float, steps: dict[int, int]) -> float:
    """The mixture's share for words of given ratios, by expectation and maximisation."""
    at = np.array(sorted(steps))
    n = np.array([steps[x] for x in at.tolist()], np.float64)
    ratio = np.where(at == NEVER, 0.0, np.exp((at + 0.5) / RATIO_STEPS))
    for _ in range(30 if n.sum() else 0):
        share = float(np.clip((n * (share * ratio / (share * ratio + 1 - share))).sum() / n.sum(), 0.01, 0.99))
    return share


def scored_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """All that the scores need but the mixture's share, and what the share is fitted to, by one pass of the network.

    Columns are the id, the text and, if the share is to be fitted, whether a text counts for it.
    """
    model, heads, counts, total = shared.value
    table, scorer = _table(model), Scorer(model, heads, counts, total)
    uid = TaskContext.get().partitionId() << 40
    steps = np.zeros(2 * MOST_STEPS + 2, np.int64)
    for batch in batches:
        marked = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) if batch.num_columns > 2 else np.zeros(batch.num_rows, bool)
        for a, b, text, own in _parts(batch, 1, SCORE_BYTES):
            c = coded(table, text, own)
            del text
            with one_thread():
                lp = scorer.words(c)
            fresh = marked[a:b]
            if fresh.any():
                steps += scorer.steps(c, lp, fresh)
            known, part, plain, ratios, row, key, lp = scorer.rows(c, lp)
            n_tokens = pa.array(c.words + 1)
            del c
            order = np.lexsort((key, row))
            row, key, lp = row[order], key[order], lp[order]
            del order
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
            own_lp = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(lp))
            lists = np.searchsorted(row[new], np.arange(b - a + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(key[new]), own_lp], names=["h", "lp"])
            places = np.concatenate([[0], np.cumsum(known)]).astype(np.int32) * np.int32(ratios.itemsize)
            columns = [
                pa.array(np.arange(uid, uid + b - a)),
                batch.column(0).slice(a, b - a),
                n_tokens,
                pa.array(known),
                pa.array(part),
                pa.array(plain),
                pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(places), pa.py_buffer(ratios)]),
                pa.array(fresh),
                pa.ListArray.from_arrays(pa.array(lists), pairs).cast(_RARE),
                pa.nulls(b - a, pa.int32()),
                pa.nulls(b - a, pa.int64()),
            ]
            uid += b - a
            yield pa.RecordBatch.from_arrays(columns, names=_SCORED)
    found = np.flatnonzero(steps)
    none = [pa.nulls(len(found), t) for t in (*[pa.int64()] * 4, pa.float64(), pa.float64(), pa.binary(), pa.bool_(), _RARE)]
    yield pa.RecordBatch.from_arrays([*none, pa.array((found + NEVER).astype(np.int32)), pa.array(steps[found])], names=_SCORED)


_SCORED = ["uid", "doc_id", "n_tokens", "known", "part", "plain", "ratios", "fresh", "rare", "step", "n"]
MIXED_SCHEMA = "uid long, doc_id long, n_tokens long, known long, part double, score double"


def mixed_batches(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """The score of the words with known counts: a mixture is the network's part times one more than the odds of the
    share times the ratio."""
    odds, rest = math.log(share / (1.0 - share)), math.log(1.0 - share)
    for batch in batches:
        known, plain, ratios = (batch.column(x) for x in ("known", "plain", "ratios"))
        more = np.zeros(batch.num_rows)
        for i, raw in enumerate(ratios):
            own = np.frombuffer(raw.as_buffer(), np.float32)
            for a in range(0, len(own), BLOCK_WORDS):
                more[i] += np.logaddexp(0.0, own[a : a + BLOCK_WORDS].astype(np.float64) + odds).sum()
        score = (plain.to_numpy() + known.to_numpy() * rest + more) / math.log(10)
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("uid", "doc_id", "n_tokens", "known", "part")), pa.array(score)], names=["uid", "doc_id", "n_tokens", "known", "part", "score"])


# ---------------------------------------------------------------- query


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))


def score_documents(
    docs: DataFrame, *, path: str | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, train_every: int = TRAIN_EVERY, head_words: int = HEAD_WORDS, steps: int = STEPS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    All is learned from all training documents (crc32 of the id as text, modulo 7, is not 2): the ids, word counts
    and id counts, the network and the mixture's share. The network starts from the id counts and from a few steps of
    the driver on about ``sample_docs`` documents (a passage of ``sample_chars`` characters of a longer text); then
    the executors train it on one of ``train_every`` documents (all, as it is set), whole, each task on its own
    texts; the tasks' weights are averaged by the number of their texts' ids. The share is fitted on all training
    documents but those of the driver's steps, which the network has seen many times. ``base_score`` is the log10 probability under smoothed word counts, ``score`` that under the
    model: the sum over words, ends included, of the log10 of a mixture of the word's share of the training words
    and the product of the network's probabilities of the word's ids. Words beyond the ``head_words`` most frequent
    ones get their counts by a join, where their part of both scores is formed.

    Null texts count as empty: one token, the end. Repeated rows are scored one by one (and sampled once), and
    equal texts have equal scores up to rounding; rows without an id are training documents; an empty table gives
    an empty table; without training documents counts are 0 and the network is untrained. A long text is worked
    on some windows at a time. Other columns don't matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    path = path or public_vocabulary()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learned = texts.where(~_held_out(F.col("doc_id")))
    # rows are told apart by id and text, so that many rows without an id, or of one id, are many
    scale = 1 << 40
    parts = max(1, min(scale, round(scale * sample_docs / max(1, learned.count()))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale))
    passage = F.when(F.length("text") > sample_chars, F.substr("text", F.pmod(F.xxhash64("text"), F.length("text") - sample_chars).cast("int") + 1, F.lit(sample_chars))).otherwise(F.col("text"))
    sample = learned.where(place < parts).select(F.xxhash64("doc_id", "text").alias("key"), passage.alias("text")).distinct().collect()
    sample.sort(key=lambda r: (r["key"], r["text"]))
    sampled = [r["text"].encode("utf-8") for r in sample]
    # at most a row for each rank of the vocabulary
    ranks = learned.select("text").mapInArrow(lambda it: ranked_batches(it, path), "rank long, c long").groupBy("rank").agg(F.sum("c").alias("c")).collect()
    times = np.zeros(len(_encoding(path)[2]), np.int64)
    for r in ranks:
        times[r["rank"]] = r["c"]
    model = numbered(path, times, learned.count())
    ids = spark.sparkContext.broadcast(model)
    tallies = learned.select("text").mapInArrow(lambda it: counted_batches(it, ids), "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c"))
    tallies = scratch.save(tallies, "tallies")
    counts = tallies.where(F.col("kind") == WORD).select("h", "c")
    band = F.floor(F.log2("c") * 8)
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).orderBy(F.desc("band")).collect()
    total, distinct = sum(r["c"] for r in bands), sum(r["words"] for r in bands)
    # at most ``head_words`` words: those of the highest bands of counts that fit
    least, held = 1 << 30, 0
    for r in bands:
        held += r["words"]
        if held > head_words:
            break
        least = r["band"]
    # at most ``head_words`` rows of two numbers
    head = counts.where(band >= least).toArrow()
    heads, head_counts = (head.column(x).to_numpy() for x in ("h", "c"))
    order = np.argsort(heads)
    heads, head_counts = heads[order], head_counts[order]
    asked = np.array(sorted({h for t in sampled[APART] for h in _hashes(_split(t)).tolist()}), np.int64)
    at = np.searchsorted(heads, asked)
    held = np.append(heads, 0)[at] == asked
    known = dict(zip(asked[held].tolist(), np.append(head_counts, 0)[at][held].tolist(), strict=True))
    if not held.all():
        known |= {r["h"]: r["c"] for r in counts.join(spark.createDataFrame([(h,) for h in asked[~held].tolist()], "h long"), "h", "left_semi").collect()}

    started = np.zeros((N_IDS + 1) * CLASSES + N_IDS, np.int64)
    for r in tallies.where(F.col("kind") == ID).select("h", "c").collect():
        started[r["h"]] = r["c"]

    def refine(model: Model) -> Network:
        given = spark.sparkContext.broadcast(model)
        schema = "slice int, n long, weights binary"
        texts_of_tasks = learned.where(F.pmod(place, F.lit(train_every)) == 0).select("text")
        of_tasks = texts_of_tasks.mapInArrow(lambda it: refined_batches(it, given), schema)
        rows = sorted(of_tasks.repartition("slice").mapInArrow(summed_batches, schema).collect())
        if not rows:
            return model.net
        return model.net.like(np.concatenate([np.frombuffer(r["weights"]) for r in rows]) / rows[0]["n"])

    fit(model, sampled, known, total, steps=steps, started=started, refine=refine)
    shared = spark.sparkContext.broadcast((model, heads, head_counts, total))
    often_seen = sorted({r["key"] for i, r in enumerate(sample) if i not in range(len(sample))[APART]})
    fresh = ~_held_out(F.col("doc_id"))
    if often_seen:
        fresh &= ~F.xxhash64("doc_id", "text").isin(often_seen)
    scored = scratch.save(texts.select("doc_id", "text", fresh.alias("fresh")).mapInArrow(lambda it: scored_batches(it, shared), SCORED_SCHEMA), "scored")
    rows = scored.where("uid is not null")
    rare = rows.select("uid", "fresh", F.col("n_tokens").alias("own"), F.explode("rare").alias("w")).select("uid", "fresh", "own", F.col("w.h").alias("h"), F.col("w.lp").alias("lp"))
    rare = scratch.save(rare.join(counts, "h", "left").select("uid", "fresh", "own", "lp", "c"), "rare")
    n, sum_of = F.size("lp"), lambda x: F.aggregate(x, F.lit(0.0), lambda a, x: a + x)
    others = F.coalesce("c", F.lit(0)) - n
    # as in Scorer
    step = F.floor((F.ln(others / F.greatest(F.lit(1), F.lit(total) - F.col("own"))) - sum_of("lp") / n) * RATIO_STEPS)
    step = F.when(others > 0, F.greatest(F.lit(-MOST_STEPS), F.least(F.lit(MOST_STEPS), step))).otherwise(NEVER).cast("int")
    steps_of = scored.where("uid is null").select("step", "n").unionByName(rare.where("fresh").select(step.alias("step"), n.cast("long").alias("n"))).groupBy("step").agg(F.sum("n").alias("n")).collect()
    share = model.share = fitted_share(model.share, {r["step"]: r["n"] for r in steps_of})

    out = rows.select("uid", "doc_id", "n_tokens", "known", "part", "plain", "ratios").mapInArrow(lambda it: mixed_batches(it, share), MIXED_SCHEMA)
    count = F.coalesce("c", F.lit(0))
    bonus, rest = F.lit(share / max(1, total)) * count, 1.0 - share
    mixed = F.transform("lp", lambda x: F.greatest(F.ln(F.col("bonus") + F.lit(rest) * F.exp(x) + F.lit(1e-300)), x + F.lit(math.log(rest))))
    tail = rare.select("uid", "lp", bonus.alias("bonus"), (F.log10(count + 1.0) * n).alias("part"), F.when(F.col("c") > 0, n).otherwise(0).alias("known"))
    tail = tail.select("uid", "part", "known", (sum_of(mixed) / F.lit(math.log(10))).alias("score"))
    tail = tail.groupBy("uid").agg(F.sum("part").alias("more_part"), F.sum("known").alias("more_known"), F.sum("score").alias("more_score"))
    out = out.join(tail, "uid", "left")
    base = F.col("part") + F.coalesce("more_part", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return out.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
