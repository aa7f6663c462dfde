"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
import pickle
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.rows import bound_batches, kept, raw_texts, slices, stored, table
from reelgrid.llm.words import WordIndex, remainder

SPACE, END, START = 256, 257, 258
SYMBOLS = 258
END_WORD = " "  # stands for the end of a text among the words
END_BYTES = END_WORD.encode()
TABLE_BITS = (17, 19, 20, 21)  # contexts: one, two, three bytes back; the word so far
TEXT_BITS = (21, 21)  # contexts across words: word before and word so far; four bytes back
OWN_BITS = 14  # the text's own counts of the word so far
LISTED = 1 << 15  # common words that have a code of their own
LISTED_LEAST = 5  # words seen less often are always spelt
PAIR_BITS = 21  # contexts in the words' code: the word before
ODDS = 500  # slots' log odds are kept in steps of 1 / ODDS: with counts to 10 ** 13 they fit
LIST_BITS = 12  # the text's own counts in the words' code
LIST_GATES, LIST_INPUTS = 12, 3
PULL = 2.0  # sightings a class of texts borrows from all texts at each decision
GROUP = 128  # texts mixed together
RATE, FIRST_SQUARES = 0.02, 30.0
TASK_BYTES = 128 << 20
LEARN_BYTES = 4 << 20  # texts of a task that advance together while weights are learnt
RARE = 2  # words seen less often are kept out of the last table
GATES = 24
EXPERTS = 2
CLASSES = 8
FIRST_SHARE = 0.5
SHARE = 0.02
BLOCK = 16
CACHE = 20.0
CHUNK_BYTES = 16 << 20
HELD_WORDS = 300_000
SLICE = 16_384
WORD_SLICE = 2_048  # words whose decisions are mixed at once
PRIOR = 0.4
MIXED_WORDS = 300_000
COUNTS = ["count", *(f"c{k}" for k in range(CLASSES))]
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def huffman(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Path of each symbol in a Huffman tree: (inner node, bit) from the root."""
    heap = [(int(w), n, n) for n, w in enumerate(weights)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in weights]
    below: dict[int, list[int]] = {n: [n] for n in range(len(weights))}
    inner, order = 0, len(weights)
    while len(heap) > 1:
        (w0, _, a), (w1, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, a), (1, b)):
            for symbol in below[side]:
                paths[symbol].append((inner, bit))
        below[order] = below.pop(a) + below.pop(b)
        heapq.heappush(heap, (w0 + w1, order, order))
        inner, order = inner + 1, order + 1
    return [p[::-1] for p in paths]


def codes_after(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code for the symbols after each symbol, from counts by (symbol before, symbol): sizes of
    all paths, and their nodes and bits one after the other. A symbol nothing was seen after has
    the code of all."""
    one, paths = huffman(pairs.sum(axis=0) + 1), []
    for own in pairs:
        paths += huffman(16 * own + 1) if own.any() else one
    flat = np.array([x for p in paths for x in p], np.int16)
    return np.fromiter(map(len, paths), np.int16, len(paths)), flat[:, 0], flat[:, 1].astype(np.uint8)


def code_sizes(weights: np.ndarray) -> np.ndarray:
    """Sizes of the codes in a Huffman code of many signs."""
    many = len(weights)
    order = np.argsort(weights, kind="stable")
    worth = [*weights[order].tolist(), *([0] * (many - 1))]
    above = np.zeros(2 * many - 1, np.int64)
    leaf, inner = 0, many
    for new in range(many, 2 * many - 1):
        for _ in (0, 1):
            if leaf < many and (inner >= new or worth[leaf] <= worth[inner]):
                low, leaf = leaf, leaf + 1
            else:
                low, inner = inner, inner + 1
            worth[new] += worth[low]
            above[low] = new
    sizes, at = np.zeros(many, np.int64), np.arange(many)
    while len(live := np.flatnonzero(at < 2 * many - 2)):
        sizes[order[live]] += 1
        at[live] = above[at[live]]
    return sizes


def canonical(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of these sizes as numbers, and what to add, by depth, to a code's first bits for the
    number of the node they lead to: nodes are numbered from the root down."""
    codes = np.zeros(len(sizes), np.int64)
    longest = int(sizes.max(initial=0))
    shift, first, nodes = np.zeros(longest + 1, np.int64), 0, 0
    for depth in range(longest + 1):
        own = np.flatnonzero(sizes == depth)
        codes[own] = first + np.arange(len(own))
        first += len(own)  # now the first inner node of this depth
        shift[depth] = nodes - first
        nodes += (1 << depth) - first
        first *= 2
    return codes, shift


def left_out(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by slot and bit, without one sighting of that bit."""
    return (np.stack([np.maximum(n0 - 1, 0), n0], axis=-1).reshape(*n0.shape[:-1], -1),
            np.stack([n1, np.maximum(n1 - 1, 0)], axis=-1).reshape(*n1.shape[:-1], -1))


@dataclass
class Bits:
    """The binary decisions that spell words, with their contexts."""

    word: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    place: np.ndarray


@dataclass
class MixModel:
    """Symbol code, counts of zeros and ones by context slot, mixing weights by gate.

    ``paths`` are those of one code, or what ``codes_after`` makes. Every context holds the
    symbol before, so a code for each says nothing new to a predictor, it only asks for fewer
    decisions.
    """

    paths: list | tuple
    counts: list = field(default_factory=list)
    weights: np.ndarray | None = None
    text_counts: list = field(default_factory=list)
    text_weights: np.ndarray | None = None
    odds: list = field(default_factory=list)  # log odds by slot, made when first asked for
    known: np.ndarray | None = None
    # the same by slot and bit, without one sighting of that bit
    left_odds: list = field(default_factory=list)
    left_known: np.ndarray | None = None
    code: WordCode | None = None  # of common words, so that only others are spelt

    def __post_init__(self):
        if isinstance(self.paths, tuple):
            sizes, nodes, self.steps = self.paths
        else:
            sizes = np.array([len(p) for p in self.paths])
            nodes = np.array([n for p in self.paths for n, _ in p])
            self.steps = np.array([b for p in self.paths for _, b in p], np.uint8)
        sizes = sizes.astype(np.int64)
        self.path_sizes, self.path_starts = sizes, np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            self.nodes = nodes.astype(np.uint64) * STEP

    def bits(self, words: list[bytes], before: list[bytes] | None = None) -> Bits:
        """All decisions of words, in order. A word is its bytes and a space, the end of a text
        one symbol of its own, so the words spell in one way only. With the word ``before`` each
        (none is empty), slots of the contexts across words follow those inside a word."""
        end = np.array([w == END_BYTES for w in words])
        flat = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(sizes) - 1
        flat[last] = SPACE
        flat[(last - 1)[end]] = END
        keep = np.ones(len(flat), bool)
        keep[last[end]] = False
        flat, sizes = flat[keep], sizes - end
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(flat)) - first[word]
        past = [np.where(place >= k, np.roll(flat, k), START).astype(np.uint64) for k in (1, 2, 3)]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(flat) + 1, STEP))
            inverse = np.cumprod(np.full(len(flat) + 1, BACK))
            total = np.cumsum(np.concatenate([[np.uint64(0)], (flat + 1).astype(np.uint64) * power[:-1]]))
            so_far = (total[:-1] - total[first[word]]) * inverse[first[word]]
            context = [past[0], past[0] * np.uint64(512) + past[1],
                       (past[0] * np.uint64(512) + past[1]) * np.uint64(512) + past[2], so_far]
            widths = TABLE_BITS
            if before is not None:
                widths = TABLE_BITS + TEXT_BITS
                names = np.fromiter(map(zlib.crc32, before), np.uint64, len(before))
                # Each word after the last bytes of the word before and a space, whose byte no
                # word has: a symbol's last four are those just before its place.
                line = np.frombuffer(b"".join([(b"\0\0\0\0" + b)[-4:] + b" " + w
                                               for b, w in zip(before, words)]), np.uint8)
                line = line.astype(np.uint64)
                line[line == 32] = SPACE
                fours = line[:-3].copy()
                for k in (1, 2, 3):
                    fours += line[k:len(line) - 3 + k] * np.uint64(512 ** k)
                spans = np.fromiter(map(len, words), np.int64, len(words)) + 5
                last4 = fours[(np.cumsum(spans) - spans + 1)[word] + place]
                context += [so_far * BACK + (names + np.uint64(1))[word] * MIX, last4]
            path = flat
            if len(self.path_sizes) > SYMBOLS:
                path = past[0].view(np.int64) * SYMBOLS + flat
            many = self.path_sizes[path]
            owner = np.repeat(np.arange(len(flat)), many)
            at = (self.path_starts[path] - np.cumsum(many) + many)[owner]
            at += np.arange(len(owner))
            node = self.nodes[at]
            slots = []
            for k, (c, width) in enumerate(zip(context, widths)):
                mixed = (c * MIX + np.uint64(k + 1))[owner]
                mixed ^= node
                mixed ^= mixed >> np.uint64(29)
                mixed *= MIX
                mixed >>= np.uint64(64 - width)
                slots.append(mixed.view(np.int64))
        return Bits(word[owner], self.steps[at], slots, place[owner])

    def inputs(self, bits: Bits, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """What each predictor says of each decision (and a constant), and its gate.

        A prediction is the log odds of the counts at its slot. ``own`` leaves one sighting of
        the decision itself out, as for learning from the words counted. The gate is the place
        in the word with how well the word so far is known.
        """
        out = np.ones((len(bits.bit), len(TABLE_BITS) + 1), np.float32)
        return out, self.look_up(bits, out.T[:len(TABLE_BITS)], own)

    def text_inputs(self, bits: Bits, past: tuple[np.ndarray, np.ndarray],
                    own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same with the predictors across words and with the text's own counts so far, a
        row for each predictor and the constant last."""
        out = np.empty((MIXED_INPUTS, len(bits.bit)), np.float32)
        gate = self.look_up(bits, out[:-2], own)
        np.log((past[1] + PRIOR) / (past[0] + PRIOR), out=out[-2])
        out[-1] = 1
        return out, gate

    def look_up(self, bits: Bits, out: np.ndarray, own: bool) -> np.ndarray:
        """Fills a row of ``out`` for each context with log odds; the gate of each decision."""
        self.tabulate(own)
        tables, known = (self.left_odds, self.left_known) if own else (self.odds, self.known)
        for k, row in enumerate(out):
            slot = bits.slots[k] << 1 | bits.bit if own else bits.slots[k]
            np.take(tables[k], slot, out=row, mode="clip")
            if k == len(TABLE_BITS) - 1:
                known = known.take(slot)
        return np.minimum(bits.place, 7) * 3 + known

    def tabulate(self, own: bool) -> None:
        """Log odds of all slots, once a table; ``own`` those without one sighting of a bit."""
        tables = [*self.counts[:len(TABLE_BITS)], *self.text_counts]
        made = self.left_odds if own else self.odds
        for k in range(len(made), len(tables)):
            n0, n1 = tables[k]
            if own:
                n0, n1 = left_out(n0, n1)
            odds = np.divide(n1 + PRIOR, n0 + PRIOR)
            made.append(np.log(odds, out=odds))
            if k == len(TABLE_BITS) - 1:
                known = (n0 + n1 > 0).astype(np.int8) + (n0 + n1 > 30)
                if own:
                    self.left_known = known
                else:
                    self.known = known

    def text_logs(self, texts: list[list[bytes]], learnt: dict | None = None) -> np.ndarray:
        """Natural log probability of every word of some texts, in their order.

        All bits are mixed logistically. A text begins with the weights all taught texts made;
        after each BLOCK of words, its weights and its own counts follow what it held.
        Texts advance together and share nothing, save with ``learnt``: then they change the
        weights ``w`` and ``squares`` in it, and each decision is left out of its own counts.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()))
        turn = np.argsort(-sizes, kind="stable")
        for g in range(0, len(turn), GROUP):
            group = turn[g:g + GROUP]
            many = len(group) if learnt is None else 1
            if learnt is None:
                w = np.repeat(self.text_weights[None], many, axis=0)
                squares = np.full_like(w, FIRST_SQUARES)
            else:
                w, squares = learnt["w"][None], learnt["squares"][None]
            seen = np.zeros(len(group) << OWN_BITS, np.int64)  # two float counts in each
            for a in range(0, int(sizes[group[0]]), BLOCK):
                live = int(np.searchsorted(-sizes[group], -a, side="left"))
                parts = [texts[t][a:a + BLOCK] for t in group[:live]]
                words = [x for part in parts for x in part]
                before = [x for t, part in zip(group, parts) for x in
                          (texts[t][a - 1] if a else b"", *part[:-1])]
                count = np.fromiter(map(len, parts), np.int64, live)
                bits = self.bits(words, before)
                text = np.repeat(np.arange(live), count)[bits.word]
                own = (text << OWN_BITS) + (bits.slots[len(TABLE_BITS) - 1] & (1 << OWN_BITS) - 1)
                past = seen.take(own).view(np.float32).reshape(-1, 2).T
                inputs, gate = self.text_inputs(bits, (past[0], past[1]), learnt is not None)
                cell = gate if learnt is not None else text * GATES + gate
                flat = w.reshape(-1, MIXED_INPUTS)
                odds = np.einsum("kb,bk->b", inputs, flat.take(cell, axis=0))
                np.clip(odds, -30, 30, out=odds)
                sign = 2 * bits.bit.astype(np.float32) - 1
                against = np.exp(-sign * odds)  # of the bit that is there
                off = sign * against / (1 + against)
                lost = np.bincount(bits.word, np.log(1 + against), minlength=len(words))
                base = np.cumsum(count) - count
                out[np.arange(len(words)) + np.repeat(starts[group[:live]] + a - base, count)] = -lost
                root = squares.reshape(-1, MIXED_INPUTS)
                for k in range(MIXED_INPUTS):
                    grad = np.bincount(cell, off * inputs[k], minlength=len(flat))
                    root[:, k] += grad * grad
                    flat[:, k] += RATE * grad / np.sqrt(root[:, k])
                np.add.at(seen.view(np.float32), own << 1 | bits.bit, np.float32(1))
        return out

    def word_logs(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word under each set of weights."""
        out = np.zeros((len(words), EXPERTS))
        for a in range(0, len(words), WORD_SLICE):
            part = words[a:a + WORD_SLICE]
            bits = self.bits(part)
            inputs, gate = self.inputs(bits)
            sign = np.where(bits.bit == 1, np.float32(-1), np.float32(1))
            for m in range(EXPERTS):
                odds = np.einsum("bk,bk->b", inputs, self.weights[m][gate])
                lost = np.log(1 + np.exp(sign * np.clip(odds, -30, 30)))
                out[a:a + WORD_SLICE, m] = -np.bincount(bits.word, lost, minlength=len(part))
        return out

    def learn(self, words: list[bytes], counts: np.ndarray, weights: np.ndarray,
              squares: np.ndarray) -> None:
        """One online step of the mixing weights on a batch of counted words."""
        bits = self.bits(words)
        inputs, gate = self.inputs(bits, own=True)
        worth = (counts.astype(np.float64), (counts <= RARE) * 1.0)
        for m in range(EXPERTS):
            share = (worth[m] / max(worth[m].sum(), 1))[bits.word]
            odds = np.einsum("bk,bk->b", inputs, weights[m][gate].astype(np.float32))
            off = share * (bits.bit - 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
            for k in range(inputs.shape[1]):
                grad = np.bincount(gate, off * inputs[:, k], minlength=GATES)
                squares[m, :, k] += grad * grad
                weights[m, :, k] += 0.1 * grad / np.sqrt(squares[m, :, k] + 1e-9)


class WordCode:
    """A Huffman code of common words, with one more sign for all others, which are spelt after
    it; the bits of all signs are mixed at their place in a text.

    ``counts`` has a row for each sign (the other words last) and the columns of COUNTS;
    ``pairs`` are zeros and ones by slot of the word before and the node.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, pairs: tuple | None = None,
                 weights: np.ndarray | None = None):
        self.words, self.counts, self.pairs = words, counts, pairs
        self.weights = first_code_weights() if weights is None else weights
        self.other = len(words)
        self.place = {w: k for k, w in enumerate(words)}
        self.sizes = code_sizes(counts[:, 0] + 1)
        self.codes, self.shift = canonical(self.sizes)
        self.tables: dict[bool, tuple] = {}  # made when first asked for
        total = counts.sum(axis=0)
        share = (counts[:, :1] + 1) / (total[0] + len(counts))
        pull = 500 + 0.05 * total[1:]
        self.class_logs = np.log((counts[:, 1:] + pull * share) / (total[1:] + pull),
                                 dtype=np.float32, casting="same_kind")

    def signs(self, names: list[bytes]) -> np.ndarray:
        return np.fromiter((self.place.get(w, self.other) for w in names), np.int64, len(names))

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Signs of the words and the end of each text, and how many of them each text has."""
        index = WordIndex()
        at, counts, names = index.look_up([t.lower() for t in texts])
        signs = np.insert(self.signs(names)[at], np.cumsum(counts), self.signs([END_BYTES])[0])
        return signs, counts + 1

    def rest_logs(self, seen: np.ndarray, distinct: int, spelt: np.ndarray) -> np.ndarray:
        """Natural log probability of words without a sign, after the sign for them: by their
        counts, and for new words the share of first sightings times their spelling's."""
        total, kinds = self.counts[-1, 0], max(distinct - self.other, 1)
        return np.log(np.where(seen > 0, seen, kinds) / (total + kinds)) + np.where(seen > 0, 0, spelt)

    def before(self, signs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sign before each sign of texts one after the other; one more starts a text."""
        past = np.roll(signs, 1)
        past[np.cumsum(sizes) - sizes] = self.other + 1
        return past

    def decisions(self, signs: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each decision: which of the signs it is for, its node, its bit, and the slot of the
        word before and the node."""
        many = self.sizes.take(signs)
        owner, node, bit = self.walk(signs, many)
        with np.errstate(over="ignore"):
            slot = node.view(np.uint64) * STEP
            slot ^= np.repeat((before.view(np.uint64) + np.uint64(1)) * MIX, many)
            slot ^= slot >> np.uint64(29)
            slot *= MIX
            slot >>= np.uint64(64 - PAIR_BITS)
        return owner, node, bit, slot.view(np.int64)

    def walk(self, signs: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and bits on the way to signs with codes of ``many`` bits."""
        owner = np.repeat(np.arange(len(signs)), many)
        ahead = np.repeat(np.cumsum(many), many)
        ahead -= np.arange(len(ahead))
        code = np.repeat(self.codes.take(signs), many)
        node = np.repeat(many, many)
        node -= ahead
        node = self.shift.take(node)
        node += code >> ahead
        ahead -= 1
        code >>= ahead
        code &= 1
        return owner, node, code

    def tabulate(self, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of nodes (a row over all texts, then one for each class), and of slots in
        steps of 1 / ODDS with how well the slot is known in the last two bits; ``own`` by node or
        slot and bit, without one sighting of that bit."""
        if own not in self.tables:
            owner, node, bit = self.walk(np.arange(len(self.sizes)), self.sizes)
            n0, n1 = (np.array([np.bincount(node[on], c[owner[on]], minlength=self.other)
                                for c in self.counts.T]) for on in (bit == 0, bit == 1))
            p0, p1 = self.pairs
            if own:
                (n0, n1), (p0, p1) = left_out(n0, n1), left_out(p0, p1)
            part = (n1[0] + PRIOR) / (n0[0] + n1[0] + 2 * PRIOR)
            nodes = np.log((n1 + PULL * part) / (n0 + PULL * (1 - part)))
            odds = np.divide(p1 + np.float32(PRIOR), p0 + np.float32(PRIOR))
            odds = np.rint(np.log(odds, out=odds) * np.float32(ODDS)).astype(np.int16) << 2
            p0 = p0 + p1
            odds += (p0 > 0).astype(np.int16) + (p0 > 3) + (p0 > 30)
            self.tables[own] = (nodes.astype(np.float32), odds)
        return self.tables[own]

    def inputs(self, node: np.ndarray, bit: np.ndarray, slot: np.ndarray, kind: np.ndarray,
               zeros: np.ndarray, ones: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """What each predictor says of each decision, a row each: counts of the text's class
        (``kind``; 0: of all texts), the word before, the text's own counts so far. The gate of
        each decision: how well the word before is known there, and how well the text."""
        nodes, odds = self.tabulate(own)
        if own:
            node, slot = node << 1 | bit, slot << 1 | bit
        out = np.empty((LIST_INPUTS, len(node)), np.float32)
        np.take(nodes.reshape(-1), kind * nodes.shape[1] + node, out=out[0], mode="clip")
        slot = odds.take(slot)
        np.multiply(slot >> 2, np.float32(1 / ODDS), out=out[1])
        np.divide(ones + np.float32(PRIOR), zeros + np.float32(PRIOR), out=out[2])
        np.log(out[2], out=out[2])
        slot &= 3
        slot *= 3
        slot += np.minimum(zeros + ones, np.float32(2)).astype(np.int16)
        return out, slot

    def place_logs(self, signs: np.ndarray, sizes: np.ndarray,
                   learnt: dict | None = None) -> np.ndarray:
        """Natural log probability of the sign at every place of texts of ``sizes`` places.

        A text begins with the weights all taught texts made; after each BLOCK of words its
        weights, its own counts and its class (the likeliest so far) follow what it held. Texts
        advance together and share nothing, save with ``learnt``: then they change the weights
        ``w`` and ``squares`` in it, and each decision is left out of its own counts.
        """
        starts = np.cumsum(sizes) - sizes
        before = self.before(signs, sizes)
        out = np.zeros(len(signs))
        turn = np.argsort(-sizes, kind="stable")
        for g in range(0, len(turn), GROUP):
            group = turn[g:g + GROUP]
            if learnt is None:  # a row for each input, of all texts' weights by gate
                w = np.tile(self.weights.T, len(group))
                squares = np.full_like(w, FIRST_SQUARES)
            else:
                w, squares = learnt["w"], learnt["squares"]
            seen = np.zeros(len(group) << LIST_BITS, np.int64)  # two float counts in each
            heard = np.zeros((len(group), CLASSES))
            kind = np.zeros(len(group), np.int64)
            for a in range(0, int(sizes[group[0]]), BLOCK):
                live = int(np.searchsorted(-sizes[group], -a, side="left"))
                count = np.minimum(BLOCK, sizes[group[:live]] - a)
                base = np.cumsum(count) - count
                text = np.repeat(np.arange(live), count)
                here = np.arange(len(text)) + np.repeat(starts[group[:live]] + a - base, count)
                sign = signs.take(here)
                owner, node, bit, slot = self.decisions(sign, before.take(here))
                whose = text.take(owner)
                own = (whose << LIST_BITS) + (node & (1 << LIST_BITS) - 1)
                past = seen.take(own).view(np.float32).reshape(-1, 2).T
                inputs, cell = self.inputs(node, bit, slot, kind.take(whose), *past, learnt is not None)
                if learnt is None:
                    cell = cell + whose * LIST_GATES
                odds, part = np.zeros(len(node), np.float32), np.empty(len(node), np.float32)
                for row, weight in zip(inputs, w):
                    odds += np.multiply(row, np.take(weight, cell, out=part, mode="clip"), out=part)
                np.clip(odds, -30, 30, out=odds)
                side = 2 * bit.astype(np.float32) - 1
                against = np.exp(odds * -side)  # of the bit that is there
                out[here] = -np.bincount(owner, np.log(1 + against), minlength=len(here))
                off = side * against / (1 + against)
                many = len(w[0]) if learnt is not None else live * LIST_GATES
                for row, weight, square in zip(inputs, w, squares):
                    grad = np.bincount(cell, off * row, minlength=many).astype(np.float32)
                    square[:many] += grad * grad
                    weight[:many] += np.float32(RATE) * grad / np.sqrt(square[:many])
                np.add.at(seen.view(np.float32), own << 1 | bit, np.float32(1))
                heard[:live] += np.add.reduceat(self.class_logs.take(sign, axis=0), base)
                kind[:live] = 1 + heard[:live].argmax(axis=1)
        return out


def first_code_weights() -> np.ndarray:
    start = np.full((LIST_GATES, LIST_INPUTS), 0.2, np.float32)
    start[:, 0] = 0.8
    return start


def first_weights() -> np.ndarray:
    start = np.full((EXPERTS, GATES, len(TABLE_BITS) + 1), 0.3)
    start[..., -1] = 0
    return start


MIXED_INPUTS = len(TABLE_BITS) + len(TEXT_BITS) + 2  # with the text's own counts and a constant


def first_text_weights() -> np.ndarray:
    start = np.full((GATES, MIXED_INPUTS), 0.2, np.float32)
    start[:, -1] = 0
    return start


def sent(context, *parts):
    """A broadcast of a model's parts, deflated: most slots of a table hold small counts."""
    return context.broadcast((uuid.uuid4().hex, zlib.compress(pickle.dumps(parts, 5), 1)))


def received(shared, own: bool = False, kind=MixModel):
    """The model of ``sent``, kept in the Python worker with its log odds (those for learning
    with ``own``) in place of its counts."""
    key, data = shared.value

    def build():
        model = kind(*pickle.loads(zlib.decompress(data)))
        if kind is WordCode:
            if model.pairs is not None:
                model.tabulate(own)
                model.pairs = None
            return model
        model.tabulate(own)
        model.counts, model.text_counts = [], []
        return model

    return kept(("language model", key, own), build)


def received_both(shared, listing) -> MixModel:
    """The spelling model with the words' code (none without ``listing``), kept together."""
    def build():
        model = MixModel(*pickle.loads(zlib.decompress(shared.value[1])))
        model.tabulate(False)
        model.counts, model.text_counts = [], []
        if listing:
            model.code = WordCode(*pickle.loads(zlib.decompress(listing.value[1])))
            model.code.tabulate(False)
            model.code.pairs = None
        return model

    return kept(("language model", shared.value[0], False), build)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words and the end of the text."""
    return [*text.lower().split(), END_BYTES]


def text_class(text: bytes) -> int:
    """Which of CLASSES a text counts for: by its commonest letter beyond ASCII, 0 for none."""
    flat = np.frombuffer(text, np.uint8)
    high = np.flatnonzero(flat >= 0xC0)
    high = high[high + 1 < len(flat)]
    if not len(high):
        return 0
    letters = flat[high].astype(np.int64) * 256 + flat[high + 1]
    common = int(np.bincount(letters).argmax())
    return 1 + common * 2654435761 % (1 << 32) * (CLASSES - 1) // (1 << 32)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, count, c0 .. ) over all texts: lower-cased words and one end a text; the count of
    all texts and of each class of texts."""
    bound_batches(docs.sparkSession)

    def run(batches):
        held: list[dict[bytes, int]] = [{} for _ in range(CLASSES)]

        def rows():
            for k, own in enumerate(held):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(own), pa.binary()).cast(pa.string()),
                     pa.array(np.full(len(own), k)), pa.array(list(own.values()), pa.int64())],
                    names=["word", "class", "count"])
                own.clear()

        for batch in batches:
            for part in slices(batch, text):
                for t in raw_texts(part, text):
                    own = held[text_class(t)]
                    for w in t.lower().split():
                        own[w] = own.get(w, 0) + 1
                    own[END_WORD.encode()] = own.get(END_WORD.encode(), 0) + 1
                if sum(map(len, held)) > HELD_WORDS:
                    yield from rows()
        yield from rows()

    parts = docs.select(text).mapInArrow(run, "word string, class long, count long")
    return parts.groupBy("word").agg(F.sum("count").alias("count"), *(
        F.sum(F.when(F.col("class") == k, F.col("count")).otherwise(0)).alias(f"c{k}")
        for k in range(CLASSES)))


def _batches(vocabulary: DataFrame, schema: str, start, step, finish) -> DataFrame:
    """Rows made per task from batches of (words, counts): ``finish`` of the state that
    ``start`` makes and ``step`` changes."""
    def run(batches):
        state = start()
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                step(state, raw_texts(part, "word"), part.column("count").to_numpy())
        yield from finish(state)

    return vocabulary.mapInArrow(run, schema)


def listed_words(vocabulary: DataFrame, listed: int) -> tuple[WordCode, DataFrame]:
    """A code of the ``listed`` commonest words seen LISTED_LEAST times, and the other words."""
    top = (vocabulary.where(F.col("count") >= LISTED_LEAST).orderBy(F.desc("count"), "word")
           .limit(listed).select("word", *COUNTS).toArrow())
    words = raw_texts(top, "word")
    counts = np.stack([top[c].to_numpy() for c in COUNTS], axis=1).astype(np.float64)
    total = vocabulary.agg(*(F.sum(c) for c in COUNTS)).first()
    other = np.array([t or 0 for t in total]) - counts.sum(axis=0)
    rest = F.col("count") < LISTED_LEAST
    if len(words) == listed:
        least = int(counts[-1, 0])
        rest = (F.col("count") < least) | (
            (F.col("count") == least) & (F.col("word") > words[-1].decode()))
    return WordCode(words, np.concatenate([counts, other[None]])), vocabulary.where(rest)


def fit(vocabulary: DataFrame, docs: DataFrame | None = None, text: str = "text",
        listed: int = LISTED) -> MixModel:
    """Symbol code, context counts and mixing weights from all counted words, and those across
    words from all texts of ``docs`` (none: no counts).

    The ``listed`` commonest words get a code of their own, whose bits are mixed at their place
    in a text; spelling is then counted and learnt from the other words. With none listed, all
    words are spelt at their place.

    Contexts inside a word get from counted words all counts that their texts would give. The
    tables have fixed sizes (2 ** TABLE_BITS slots) and are summed by slot before the driver
    gets them. Each task mixes its words online; tasks' weights are averaged by words seen.
    """
    spark = vocabulary.sparkSession
    listing = None
    if listed:
        listing, vocabulary = listed_words(vocabulary, listed)

    def tally(state, words, counts):
        end = np.array([w == END_BYTES for w in words])
        state[START * SYMBOLS + END] += counts[end].sum()
        words, counts = [w for w in words if w != END_BYTES], counts[~end]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(sizes) - 1
        flat = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
        flat[last] = SPACE
        past = np.roll(flat, 1)
        past[last - sizes + 1] = START
        state += np.bincount(past * SYMBOLS + flat, np.repeat(counts, sizes),
                             minlength=len(state)).astype(np.int64)

    def tallied(state):
        at = np.flatnonzero(state)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(state[at])], names=["pair", "n"])

    seen = _batches(vocabulary, "pair long, n long",
                    lambda: np.zeros((START + 1) * SYMBOLS, np.int64), tally, tallied)
    pairs = np.zeros((START + 1) * SYMBOLS, np.int64)
    for pair, n in seen.groupBy("pair").sum("n").collect():  # at most that many rows
        pairs[pair] = n
    model = MixModel(codes_after(pairs.reshape(START + 1, SYMBOLS)))
    paths = model.paths

    def slots():
        return MixModel(paths), [np.zeros((1 << b, 2)) for b in TABLE_BITS]

    def add(state, words, counts):
        code, tables = state
        for a in range(0, len(words), WORD_SLICE):
            bits = code.bits(words[a:a + WORD_SLICE])
            weight = counts[a:a + WORD_SLICE][bits.word].astype(np.float64)
            for k, table_ in enumerate(tables):
                some = np.flatnonzero(weight >= RARE) if k == len(tables) - 1 else slice(None)
                np.add.at(table_.reshape(-1), bits.slots[k][some] << 1 | bits.bit[some], weight[some])

    def filled(state):
        for k, table_ in enumerate(state[1]):
            at = np.flatnonzero(table_.any(axis=1))
            for a in range(0, len(at), 1 << 16):
                part = at[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), k)), pa.array(part),
                     pa.array(table_[part, 0]), pa.array(table_[part, 1])],
                    names=["k", "slot", "n0", "n1"])

    sums = (_batches(vocabulary, "k long, slot long, n0 double, n1 double", slots, add, filled)
            .groupBy("k", "slot").agg(F.sum("n0").cast("float").alias("n0"),
                                      F.sum("n1").cast("float").alias("n1"))
            .select(F.col("k").cast("tinyint").alias("k"), F.col("slot").cast("int").alias("slot"),
                    "n0", "n1"))
    got = sums.toArrow()  # at most the sum of the table sizes: under four million small rows
    own = got["k"].to_numpy()
    for k, width in enumerate(TABLE_BITS):
        pick = own == k
        zeros, ones = np.zeros(1 << width, np.float32), np.zeros(1 << width, np.float32)
        at = got["slot"].to_numpy()[pick]
        zeros[at], ones[at] = got["n0"].to_numpy()[pick], got["n1"].to_numpy()[pick]
        model.counts.append((zeros, ones))
    del got
    shared = sent(spark.sparkContext, paths, model.counts)

    def begin():
        return {"model": received(shared, own=True), "w": first_weights(),
                "squares": np.zeros_like(first_weights()), "n": 0}

    def learn(state, words, counts):
        for a in range(0, len(words), WORD_SLICE):
            part = slice(a, a + WORD_SLICE)
            state["model"].learn(words[part], counts[part], state["w"], state["squares"])
        state["n"] += len(words)

    def learnt(state):
        flat = state["w"].ravel() * state["n"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), state["n"]))],
            names=["i", "w", "n"])

    mean = dict(_batches(vocabulary, "i long, w double, n long", begin, learn, learnt)
                .groupBy("i").agg(F.sum("w") / F.greatest(F.sum("n"), F.lit(1))).collect())
    start = first_weights()
    model.weights = np.array([mean.get(i, 0.0) for i in range(start.size)], np.float32).reshape(
        start.shape) if mean else start.astype(np.float32)
    shared.destroy()
    if listing is None:
        fit_texts(model, docs, text)
    else:
        fit_code(listing, docs, text)
        model.code = listing
    return model


def fit_code(code: WordCode, docs: DataFrame | None, text: str = "text") -> None:
    """Counts of the words' code after each word, then its weights, from whole texts.

    A task fills a table of fixed size from about TASK_BYTES of text; Spark sums them by slot.
    Weights learn online over all texts of a task and are averaged by texts seen.
    """
    code.pairs = tuple(np.zeros((2, 1 << PAIR_BITS), np.float32))
    if docs is None:
        return
    context = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    nbytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    docs = docs.select(F.col(text).alias("text"))
    large = docs.coalesce(int(nbytes // TASK_BYTES) + 1)
    shared = sent(context, code.words, code.counts)

    def tally(batches):
        own, table_ = received(shared, kind=WordCode), np.zeros((1 << PAIR_BITS, 2), np.uint32)
        for batch in batches:
            for part in slices(batch, "text", LEARN_BYTES):
                signs, sizes = own.read(raw_texts(part, "text"))
                before = own.before(signs, sizes)
                for a in range(0, len(signs), WORD_SLICE):
                    _, _, bit, slot = own.decisions(signs[a:a + WORD_SLICE], before[a:a + WORD_SLICE])
                    np.add.at(table_.reshape(-1), slot << 1 | bit, np.uint32(1))
        at = np.flatnonzero(table_.any(axis=1))
        for a in range(0, len(at), 1 << 16):
            some = at[a:a + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(table_[some].view(np.int64).reshape(-1))],
                names=["slot", "both"])

    zeros, ones = F.expr("both & 4294967295"), F.expr("shiftrightunsigned(both, 32)")
    got = (large.mapInArrow(tally, "slot int, both long").groupBy("slot")
           .agg(F.sum(zeros).cast("float").alias("n0"), F.sum(ones).cast("float").alias("n1"))
           .toArrow())  # at most the size of the table
    at = got["slot"].to_numpy()
    for name, table_ in zip(("n0", "n1"), code.pairs):
        table_[at] = got[name].to_numpy()
    del got
    shared.destroy()
    shared = sent(context, code.words, code.counts, code.pairs)

    def learn(batches):
        own, n = received(shared, True, WordCode), 0
        w = np.ascontiguousarray(first_code_weights().T)
        state = {"w": w, "squares": np.full_like(w, FIRST_SQUARES)}
        for batch in batches:
            for part in slices(batch, "text", LEARN_BYTES):
                signs, sizes = own.read(raw_texts(part, "text"))
                own.place_logs(signs, sizes, state)
                n += len(sizes)
        flat = w.T.ravel().astype(np.float64) * n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), n))],
            names=["i", "w", "n"])

    mean = dict(docs.mapInArrow(learn, "i long, w double, n long").groupBy("i")
                .agg(F.sum("w") / F.greatest(F.sum("n"), F.lit(1)), F.sum("n"))
                .where("`sum(n)` > 0").drop("sum(n)").collect())
    shared.destroy()
    if mean:
        code.weights = np.array([mean[i] for i in range(code.weights.size)],
                                np.float32).reshape(code.weights.shape)


def fit_texts(model: MixModel, docs: DataFrame | None, text: str = "text") -> None:
    """Counts of the contexts across words, then weights of all predictors, from whole texts.

    A task fills tables of fixed size from about TASK_BYTES of text; Spark sums them by slot.
    Weights learn online over all texts of a task and are averaged by texts seen.
    """
    model.text_counts = [(np.zeros(1 << b, np.float32), np.zeros(1 << b, np.float32))
                         for b in TEXT_BITS]
    model.text_weights = first_text_weights()
    if docs is None:
        return
    context = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    paths, inside = model.paths, len(TABLE_BITS)
    nbytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    docs = docs.select(F.col(text).alias("text"))
    large = docs.coalesce(int(nbytes // TASK_BYTES) + 1)

    def tally(batches):
        code, tables = MixModel(paths), [np.zeros((1 << b, 2), np.int32) for b in TEXT_BITS]
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [words_of(t) for t in raw_texts(part, "text")]
                words = [w for t in texts for w in t]
                before = [w for t in texts for w in (b"", *t[:-1])]
                for a in range(0, len(words), SLICE):
                    bits = code.bits(words[a:a + SLICE], before[a:a + SLICE])
                    for k, own in enumerate(tables):
                        np.add.at(own.reshape(-1), bits.slots[inside + k] << 1 | bits.bit, np.int32(1))
        for k, own in enumerate(tables):
            at = np.flatnonzero(own.any(axis=1))
            for a in range(0, len(at), 1 << 16):
                some = at[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), k, np.int8)), pa.array(some.astype(np.int32)),
                     *(pa.array(own[some, b].astype(np.float32)) for b in (0, 1))],
                    names=["k", "slot", "n0", "n1"])

    got = (large.mapInArrow(tally, "k tinyint, slot int, n0 float, n1 float").groupBy("k", "slot")
           .agg(F.sum("n0").cast("float").alias("n0"), F.sum("n1").cast("float").alias("n1"))
           .toArrow())  # at most the sum of the table sizes
    for k, pair in enumerate(model.text_counts):
        pick = got["k"].to_numpy() == k
        at = got["slot"].to_numpy()[pick]
        pair[0][at], pair[1][at] = got["n0"].to_numpy()[pick], got["n1"].to_numpy()[pick]
    del got
    shared = sent(context, paths, model.counts, model.weights, model.text_counts)

    def learn(batches):
        own, n = received(shared, own=True), 0
        start = first_text_weights()
        state = {"w": start, "squares": np.full_like(start, FIRST_SQUARES)}
        for batch in batches:
            for part in slices(batch, "text", LEARN_BYTES):
                texts = [words_of(t) for t in raw_texts(part, "text")]
                own.text_logs(texts, state)
                n += len(texts)
        flat = state["w"].ravel().astype(np.float64) * n
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), n))],
            names=["i", "w", "n"])

    mean = dict(docs.mapInArrow(learn, "i long, w double, n long").groupBy("i")
                .agg(F.sum("w") / F.greatest(F.sum("n"), F.lit(1)), F.sum("n"))
                .where("`sum(n)` > 0").drop("sum(n)").collect())
    shared.destroy()
    if mean:
        model.text_weights = np.array([mean[i] for i in range(model.text_weights.size)],
                                      np.float32).reshape(model.text_weights.shape)


def counted_logs(counts: np.ndarray, totals: np.ndarray, distinct: int,
                 spelt: np.ndarray) -> np.ndarray:
    """Log probabilities of words by their counts: over all texts, then in each class of texts,
    drawn towards those over all. ``counts`` has a column for each, ``totals`` their sums. A new
    word takes the share of first sightings among all words, times its spelling's probability.
    """
    total = max(totals[0], 1)
    known = total / (total + distinct)
    share = counts[:, 0] / total
    pull = 500 + 0.05 * totals[1:]
    own = (counts[:, 1:] + pull * share[:, None]) / (totals[1:] + pull)
    every = np.concatenate([share[:, None], own], axis=1) * known
    new = np.log(max(distinct, 1) / (total + max(distinct, 1))) + spelt
    return np.where(every > 0, np.log(np.maximum(every, 1e-300)), new[:, None])


def mixed_logs(counts: np.ndarray, at: np.ndarray, logs: np.ndarray,
               main: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each text of ``counts`` words at places ``at``.

    The parties are the columns of ``logs`` (by word counts, and spelt by the mixed bit
    predictors) and a cache of the text's own words. With ``main``, the logs of each place by
    the text's mixed bits, that party comes first and begins with FIRST_SHARE. Shares of the
    parties are constant over BLOCK words and then follow what each made of them; a little is
    dealt out evenly, so a party can come back. All texts advance together.
    """
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(at)) - first[owner]
    order = np.argsort(owner * (len(logs) + 1) + at, kind="stable")
    key = (owner * (len(logs) + 1) + at)[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    seen = np.empty(len(at), np.int64)
    seen[order] = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
    plain = logs[at]
    cache = np.log((seen + CACHE * np.exp(plain[:, 0])) / (nth + CACHE))
    first_party = [] if main is None else [main[:, None]]
    plain = np.concatenate([*first_party, plain, cache[:, None]], axis=1, dtype=logs.dtype)
    parties = plain.shape[1]
    shares = np.full((len(counts), parties), (1 - FIRST_SHARE) / (parties - 1))
    shares[:, 0] = FIRST_SHARE
    out = np.zeros(len(counts))
    turn = np.argsort(-counts, kind="stable")
    for a in range(0, int(counts.max(initial=0)), BLOCK):
        live = turn[:np.searchsorted(-counts[turn], -a, side="left")]
        size = np.minimum(BLOCK, counts[live] - a)
        base = np.cumsum(size) - size
        rows = plain[np.arange(size.sum()) + np.repeat(first[live] + a - base, size)]
        top = rows.max(axis=1)
        own = np.repeat(shares[live].astype(rows.dtype), size, axis=0)
        chance = np.einsum("tp,tp->t", np.exp(rows - top[:, None]), own)
        out[live] += np.add.reduceat(top + np.log(chance), base, dtype=np.float64)
        worth = np.add.reduceat(rows, base, axis=0, dtype=np.float64)
        worth = shares[live] * np.exp(worth - worth.max(axis=1, keepdims=True)) + 1e-300
        worth /= worth.sum(axis=1, keepdims=True)
        shares[live] = (1 - SHARE) * worth + SHARE / parties
    return out


def score(docs: DataFrame, vocabulary: DataFrame, model: MixModel, totals: list[int],
          distinct: int, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, bits_per_byte) of whole texts.

    Texts go to chunks of about ``chunk_bytes`` by hash. Only a chunk's distinct words meet
    the counted words (a join the planner may split), and come back to the chunk's texts.
    Null texts are empty ones; repeated rows come back as often; other columns are dropped.
    """
    context, code = docs.sparkSession.sparkContext, model.code
    shared = sent(context, model.paths, model.counts, model.weights, model.text_counts,
                  model.text_weights)
    listing = code and sent(context, code.words, code.counts, code.pairs, code.weights)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = size // chunk_bytes + 1
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).alias("chunk"))
    bound_batches(docs.sparkSession)

    def own_words(group: pa.Table) -> pa.Table:
        words = {END_WORD.encode()}
        for t in raw_texts(group, "text"):
            words.update(t.lower().split())
        words = pa.array(list(words), pa.binary()).cast(pa.string())
        chunk = group["chunk"][0].as_py()
        return pa.table({"chunk": pa.array(np.full(len(words), chunk)), "word": words})

    needed = keyed.groupBy("chunk").applyInArrow(own_words, "chunk long, word string")
    known = needed.join(vocabulary.select("word", *COUNTS), "word", "left").select(
        "chunk", "word", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))
    sums = np.array(totals, np.float64)
    whole = np.log10(totals[0] + 0.1 * (distinct + 1))

    def judge(group: pa.Table, words: pa.Table) -> pa.Table:
        index = WordIndex()
        names = raw_texts(words, "word")
        index.place = {w: n for n, w in enumerate(names)}
        end = index.place[END_WORD.encode()]
        texts = [t.lower() for t in raw_texts(group, "text")]
        at, counts, new = index.look_up(texts)
        if new:
            raise ValueError("a text has words its chunk did not ask for")
        at = np.insert(at, np.cumsum(counts), end)
        counts = counts + 1
        first = np.cumsum(counts) - counts
        seen = words["count"].to_numpy()
        base = np.log10(seen + 0.1) - whole
        new = np.flatnonzero(seen == 0)
        own = received_both(shared, listing)
        spelt = np.zeros(len(names))
        spelt[new] = own.word_logs([names[k] for k in new])[:, -1]
        by_class = np.stack([words[c].to_numpy() for c in COUNTS], axis=1)
        logs = counted_logs(by_class, sums, distinct, spelt).astype(np.float32)
        if own.code:
            signs = own.code.signs(names)
            rest = np.where(signs == own.code.other, own.code.rest_logs(seen, distinct, spelt), 0)
            main = own.code.place_logs(signs[at], counts) + rest[at]
        else:
            main = own.text_logs([words_of(t) for t in texts])
        part = first // MIXED_WORDS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(counts)]
        runs = [(a, b, slice(first[a], first[b - 1] + counts[b - 1])) for a, b in zip(edges, edges[1:])]
        result = np.concatenate([mixed_logs(counts[a:b], at[run], logs, main[run])
                                 for a, b, run in runs]) / np.log(10)
        sizes = np.fromiter(map(len, names), np.int64, len(names)) + 1
        nbytes = np.add.reduceat(sizes[at], first)
        return pa.table({
            "doc_id": group["doc_id"], "n_tokens": pa.array(counts),
            "n_known": pa.array(np.add.reduceat((seen > 0)[at], first, dtype=np.int64)),
            "base_score": pa.array(np.add.reduceat(base[at], first)), "score": pa.array(result),
            "bits_per_byte": pa.array(-result * np.log2(10) / nbytes)})

    return keyed.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        judge, "doc_id long, n_tokens long, n_known long, base_score double, score double, "
               "bits_per_byte double")


def op7_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = docs.where(remainder("doc_id", 10) != 0)
    vocabulary = stored(word_counts(taught), "words")
    distinct, *totals = vocabulary.agg(F.count("*"), *(F.sum(c) for c in COUNTS)).first()
    totals = [t or 0 for t in totals]
    scored = score(docs, vocabulary, fit(vocabulary, taught), totals, distinct)
    return scored.select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(totals[0]).cast("long").alias("train_tokens"), "base_score", "score",
        "bits_per_byte")
