"""SentencePiece segmentations sampled without replacement, and their decoding.

A text's lattice has a node between any two characters and an edge for every vocabulary piece that fits; a character that
no piece covers has an edge of its byte pieces.  A model of merges scores a piece by its rank, which is no probability;
here rank r gets the weight of Zipf's law, (r + shift)^-exponent.  Pieces never reach over the start of a word, so the
lattice is a chain of word lattices; summing weights backwards gives every edge its probability given its node.

Gumbel top-k: were every segmentation's log-probability perturbed by Gumbel noise of its own, the k largest would be a
sample of k distinct segmentations without replacement.  The search finds them without listing all: a subtree's greatest
perturbed value is a Gumbel variable of its mass, which is known, so a subtree can be drawn as a whole and split only when
it comes first.  Splitting walks down one path: the child drawn in proportion to its mass inherits the value, the rest of
the children get one value together, drawn below it, and wait.  That is A-star search with an exact bound.  Of the waiting
subtrees only the k best can ever come up, and no more are kept.

The k + 1st value is the threshold of the sample: a segmentation of log-probability p is included with probability
1 - exp(-exp(p - threshold)), which is its inclusion score.  Random numbers depend on the row's key and the seed alone: they
are hashes of these, the number of the segmentation, the word and the piece.

All lattices of a part of the rows are built at once, and so are the walks: words are drawn apart from each other, so every
word of every text makes its next step together, and only the subtrees that wait are kept text by text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import lean, slices

WORD = re.compile("▁*[^▁]+|▁+")
SAMPLES = "row_key string, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
#: What a character is shifted by in a key of the trie, and the golden ratio of the hash.
CHARACTER, GOLDEN = 21, 0x9E3779B97F4A7C15
#: Siblings are looked at until a walk's log-probability has fallen by the first.  log(-log(u)) is above minus the second for
#: every u below 1 (-36.8, and some for rounding), so what comes later has at least the difference.
REACH, EASIEST = 64.0, 38.0


def _hash(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The ``n``-th number of the stream that begins at ``x`` (splitmix64)."""
    z = np.asarray(n).astype(np.uint64) * np.uint64(GOLDEN) + x
    shifted = np.empty_like(z)
    for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= np.right_shift(z, np.uint64(bits), out=shifted)
        z *= np.uint64(factor)
    z ^= np.right_shift(z, np.uint64(31), out=shifted)
    return z


def _uniform(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Between 0 and 1, neither included."""
    return ((_hash(x, n) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


class Vocabulary:
    def __init__(self, path: str, shift: float = 2.7, exponent: float = 1.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        special = [i for i in range(size) if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)]
        self.byte, self.weight = {}, np.zeros(size)
        pieces: dict[str, int] = {}
        for i in sorted(set(range(size)).difference(special)):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            else:
                pieces[piece], self.weight[i] = i, -exponent * math.log(-self.model.get_score(i) + shift)
        self.rare = -exponent * math.log(size + shift)  # of a byte
        self.longest = max(map(len, pieces))
        self.names = [self.model.id_to_piece(i) for i in range(size)]
        self.value = {i: b for b, i in self.byte.items()}
        self._plant(pieces)
        self.known = Known(self)
        # Bytes of every piece for decoding, then the same without the first one; and whether a piece by itself is text that
        # begins with a space or a letter.
        spelt = [bytes([self.value[i]]) if i in self.value else name.replace("▁", " ").encode() for i, name in enumerate(self.names)]
        self.spelling = pa.array(spelt + [x[1:] for x in spelt], pa.large_binary())
        self.raw = np.array([self.value.get(i, 0) >= 128 for i in range(size)])
        self.plain = np.array([b[:1] < b"\x80" and b != b"" for b in spelt])

    def _plant(self, pieces: dict[str, int]) -> None:
        """The pieces as a trie: a table that gives a state and a character the next state, by open addressing."""
        states, ends = {}, [-1]
        for piece, i in pieces.items():
            at = 0
            for c in piece:
                at = states.setdefault(at << CHARACTER | ord(c), len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        self.ends = np.array(ends, np.int32)
        bits = (4 * len(states)).bit_length()
        self.slots, self.keys, self.next = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, values = np.fromiter(states, np.int64), np.fromiter(states.values(), np.int32)
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.next[slot] = key, value

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(GOLDEN)) >> self.slots).astype(np.int64)

    def step(self, state: np.ndarray, character: np.ndarray) -> np.ndarray:
        """The states after a character, -1 where no piece goes on like that."""
        key = state.astype(np.int64) << CHARACTER | character
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.next[slot], np.int32(-1))
        look = np.nonzero((there != key) & (there >= 0))[0]
        while len(look):
            slot[look] = (slot[look] + 1) % len(self.keys)
            there = self.keys[slot[look]]
            same = there == key[look]
            out[look[same]] = self.next[slot[look[same]]]
            look = look[~same & (there >= 0)]
        return out

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        marked = "▁" + text.replace(" ", "▁")
        if "▁▁" in marked or marked[-1] == "▁":
            return WORD.findall(marked)
        return ["▁" + w for w in marked[1:].split("▁")]

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """``words`` of every text: each word's place among the distinct words, these, and how many words each text has."""
        spaced = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring(spaced, "▁")).as_py():
            spaced = pc.replace_substring(spaced, "▁", " ")
        spaced = pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(" ", spaced, ""))
        _, borders, data = spaced.buffers()
        borders = np.frombuffer(borders, np.int32)[spaced.offset : spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int32)
        blank = np.frombuffer(data or b"", np.uint8)[: borders[-1]] == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[borders[:-1][borders[1:] > borders[:-1]]] = True
        begins[: borders[0]] = False
        at = np.append(np.nonzero(begins)[0], borders[-1]).astype(np.int32)
        every = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data or pa.py_buffer(b"")).dictionary_encode()
        return every.indices.to_numpy(), pc.replace_substring(every.dictionary, " ", "▁"), np.diff(np.searchsorted(at[:-1], borders))

    def chain(self, text: str | None) -> Chain:
        return Chain(self, self.words(text))

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The ids of edges as ``Lattices.piece`` has them, and how many each has, None for one each."""
        at = np.nonzero(edges < 0)[0]
        if not len(at):
            return edges, None
        points, which = np.unique(-1 - edges[at].astype(np.int64), return_inverse=True)
        spelt = [[self.byte[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in points.tolist()]
        n = np.ones(len(edges), np.int64)
        n[at] = np.array([len(s) for s in spelt])[which]
        out = np.repeat(edges, n)
        starts = (np.cumsum(n) - n)[at]
        for k in range(4):
            more = np.array([s[k] if k < len(s) else -1 for s in spelt], np.int32)[which]
            out[starts[more >= 0] + k] = more[more >= 0]
        return out, n

    def decode(self, ids: list[int]) -> str:
        """The text whose segmentation this is; bytes that aren't valid UTF-8 become U+FFFD."""
        out = b"".join(bytes([self.value[i]]) if i in self.value else self.names[i].encode() for i in ids)
        return out.decode("utf-8", "replace").replace("▁", " ")[1:]

    def decode_lists(self, lists: pa.Array) -> pa.Array:
        """``decode`` of every list, null for null.  Lists with bytes of longer characters are decoded one by one."""
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        some, starts = n > 0, ends - n
        odd = np.zeros(len(n), bool)
        odd[np.searchsorted(ends, np.nonzero(self.raw[flat])[0], side="right")] = True
        odd[some] |= ~self.plain[flat[starts[some]]]
        cut = flat.copy()
        cut[starts[some]] += len(self.names)  # without the first character
        spelt = self.spelling.take(pa.array(cut))
        _, past, data = spelt.buffers()
        data = np.frombuffer(data or b"", np.uint8)
        offsets = np.frombuffer(past, np.int64, len(cut) + 1)[np.concatenate([[0], ends])] if len(cut) else np.zeros(len(n) + 1, np.int64)
        kind = pa.large_string() if offsets[-1] >= 2**31 else pa.string()
        null = pc.is_null(lists)
        if not odd.any():
            buffers = [None, pa.py_buffer(offsets.astype(np.int64 if kind == pa.large_string() else np.int32)), pa.py_buffer(data)]
            return pc.if_else(null, pa.scalar(None, kind), pa.Array.from_buffers(kind, len(n), buffers)).cast(pa.string())
        whole = data.tobytes()
        each = [self.decode(flat[s:e].tolist()) if o else whole[a:b].decode() for o, s, e, a, b in zip(odd.tolist(), starts.tolist(), ends.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())]
        return pa.array([None if x else t for x, t in zip(null.to_pylist(), each)], pa.string())


class Chain(NamedTuple):
    """A text's words, each a lattice of its own."""

    vocabulary: Vocabulary
    words: list[str]


class Lattices:
    """The lattices of distinct words.  Nodes are numbered by their distance from the end of their word, so that the nodes
    whose followers are done stand together; the edges of a node follow each other, the longest first.

    ``starts``: a word's first node; ``first``: where a node's edges begin; ``to`` (-1: the word ends), ``piece`` (of bytes
    -1 - the character),
    ``logp``, ``past`` (probability of the node's edges up to this) and ``rest`` (log-probability of all its others) of edges."""

    def __init__(self, own: Vocabulary, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(chars))
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        number = np.empty(len(chars), np.int32)
        number[order] = np.arange(len(chars), dtype=np.int32)
        self.starts = number[ends - sizes]
        left = left[order]
        found, count = [], np.zeros(len(chars), np.int32)
        node, at, state = np.arange(len(chars), dtype=np.int32), order, np.zeros(len(chars), np.int32)
        for n in range(1, own.longest + 1):
            long = np.searchsorted(left[node], n)  # nodes stay in order
            node, at, state = node[long:], at[long:], own.step(state[long:], chars[at[long:] + n - 1])
            if n == 1:
                bare = np.ones(len(chars), bool)
                bare[node[(state >= 0) & (own.ends[state] >= 0)]] = False
                raw = np.nonzero(bare)[0]
                byte = chars[order[raw]]
                width = 1 + (byte >= 0x80) + (byte >= 0x800) + (byte >= 0x10000)
                found.append((raw.astype(np.int32), self._after(number, order[raw], left[raw], 1), (-1 - byte).astype(np.int32), width * own.rare))
            on = state >= 0
            node, at, state = node[on], at[on], state[on]
            if not len(node):
                break
            piece = own.ends[state]
            has = piece >= 0
            found.append((node[has], self._after(number, at[has], left[node[has]], n), piece[has], own.weight[piece[has]]))
        for part in found:
            count[part[0]] += 1  # a step meets a node once
        self.first = np.concatenate([[0], np.cumsum(count)])
        m = int(self.first[-1])
        self.to, self.piece, self.logp = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m)
        slot = self.first[1:].copy()
        while found:
            of, to, piece, w = found.pop(0)
            s = slot[of] - 1
            slot[of] = s
            self.to[s], self.piece[s], self.logp[s] = to, piece, w
        mass = np.zeros(len(chars) + 1)  # the last is where words end
        borders = np.concatenate([[0], np.nonzero(np.diff(left))[0] + 1, [len(left)]]) if len(left) else [0]
        for a, b in zip(borders[:-1], borders[1:]):
            x, y = self.first[a], self.first[b]
            own_edges = self.logp[x:y]
            own_edges += mass[self.to[x:y]]
            mass[a:b] = np.logaddexp.reduceat(own_edges, self.first[a:b] - x)
        self.logp -= np.repeat(mass[:-1], count)
        p = np.exp(self.logp)
        self.past, self.rest = p.copy(), np.zeros(m)
        many, k = np.nonzero(count > 1)[0], 1
        while len(many):
            e, z = self.first[many] + k, self.first[many + 1] - 1 - k
            self.past[e] += self.past[e - 1]
            self.rest[z] = self.rest[z + 1] + p[z + 1]
            k += 1
            many = many[count[many] > k]
        p[1:] = self.past[:-1]
        p[self.first[:-1]] = 0.0
        self.rest += p
        with np.errstate(divide="ignore"):
            np.log(self.rest, out=self.rest)
        self.past[self.first[1:] - 1] = 2.0  # rounded or not, the last edge ends the node

    @staticmethod
    def _after(number: np.ndarray, at: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
        """The node ``n`` characters on."""
        inside = left > n
        return np.where(inside, number[np.where(inside, at + n, 0)], np.int32(-1))

    def walk(self, node: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From every node to the end of its word: the edges drawn, one walk after the other, and how many each has."""
        steps, n = [], 0
        active = np.arange(len(node))
        count = np.zeros(len(node), np.int64)
        while len(active):
            u = _uniform(base, 2 * n)
            e = self.first[node]
            wrong = np.nonzero(self.past[e] < u)[0]
            while len(wrong):
                e[wrong] += 1
                wrong = wrong[self.past[e[wrong]] < u[wrong]]
            steps.append((active, e))
            n += 1
            count[active] = n
            node = self.to[e]
            on = node >= 0
            active, node, base = active[on], node[on], base[on]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for k, (who, e) in enumerate(steps):
            out[begin[who] + k] = e
        return out, count


class Known:
    """Lattices of frequent words, kept between the parts of the rows.  What they give doesn't depend on which those are."""

    #: Parts that words are counted over, parts until they are counted again, characters of the words that are kept, and bytes
    #: of distinct words above which a part stands alone.
    RECENT, AGAIN, ROOM, LONG = 8, 32, 600_000, 2 << 20

    def __init__(self, own: Vocabulary):
        self.own, self.parts = own, 0
        self.words, self.kept = pa.array([], pa.string()), Lattices(own, [])
        self.recent: list[pa.Array] = []
        self.room: dict[str, np.ndarray] = {}

    def meet(self, words: pa.Array | list[str]) -> tuple[Lattices, np.ndarray]:
        """Lattices of distinct words (and of others), and the nodes where theirs begin."""
        if not isinstance(words, pa.Array) or words.nbytes > self.LONG:  # of one very long text: nothing is held beside it
            made = Lattices(self.own, words if isinstance(words, list) else words.to_numpy(zero_copy_only=False).tolist())
            return made, made.starts
        self.recent = [*self.recent[1 - self.RECENT :], words]
        self.parts += 1
        if self.parts % self.AGAIN == 4:
            self._keep()
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        new = at < 0
        made, kept = Lattices(self.own, words.filter(pa.array(new)).to_numpy(zero_copy_only=False).tolist()), self.kept
        nodes = np.int32(len(kept.first) - 1)
        made.to[made.to >= 0] += nodes
        starts = np.empty(len(words), np.int32)
        starts[new], starts[~new] = made.starts + nodes, kept.starts[at[~new]]
        both = Lattices.__new__(Lattices)
        both.first = self._join("first", kept.first, made.first[1:] + kept.first[-1])
        for name in ("to", "piece", "logp", "past", "rest"):
            setattr(both, name, self._join(name, getattr(kept, name), getattr(made, name)))
        return both, starts

    def _join(self, name: str, kept: np.ndarray, more: np.ndarray) -> np.ndarray:
        n = len(kept)
        if name not in self.room or len(self.room[name]) < n + len(more):
            self.room[name] = np.empty((n + len(more)) * 5 // 4, kept.dtype)
            self.room[name][:n] = kept
        self.room[name][n : n + len(more)] = more
        return self.room[name][: n + len(more)]

    def _keep(self) -> None:
        """Words that more than one of the last parts has, the most frequent ones first."""
        words, counts = pa.chunked_array(self.recent).value_counts().flatten()
        words, counts = words.filter(pc.greater(counts, 1)), counts.filter(pc.greater(counts, 1))
        order = np.argsort(-counts.to_numpy(), kind="stable")
        fits = np.cumsum(pc.utf8_length(words).to_numpy()[order], dtype=np.int64) <= self.ROOM
        self.words, self.room = words.take(pa.array(order[fits])), {}
        self.kept = Lattices(self.own, self.words.to_numpy(zero_copy_only=False).tolist())


class Sample(NamedTuple):
    pieces: np.ndarray
    log_prob: float
    perturbed: float
    inclusion: float


def _numbered(words: list[str]) -> tuple[np.ndarray, pa.Array | list[str]]:
    """Every word's place among the distinct words, and these."""
    try:
        every = pa.array(words, pa.string()).dictionary_encode()
        return every.indices.to_numpy(), every.dictionary
    except UnicodeEncodeError:  # half of a pair that makes a character
        places: dict[str, int] = {}
        return np.array([places.setdefault(w, len(places)) for w in words], np.int64), list(places)


def sample(own: Vocabulary, texts: list[list[str]], seeds: list[int], k: int) -> list[list[Sample]]:
    """For each text, as words, up to ``k`` distinct segmentations, best first; their ``pieces`` are for ``Vocabulary.ids``."""
    return draw(own, *_numbered([w for words in texts for w in words]), np.array([len(words) for words in texts], np.int64), seeds, k)


def draw(own: Vocabulary, numbers: np.ndarray, distinct: pa.Array | list[str], sizes: np.ndarray, seeds: list[int], k: int) -> list[list[Sample]]:
    """``sample`` for texts whose words are numbered, ``sizes`` of them in each."""
    lat, starts = own.known.meet(distinct)
    starts, texts = starts[numbers], range(len(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    seed = _hash(np.array(seeds, np.uint64), 1)
    found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    # Waiting subtrees, best first: (value, segmentation it left, number of the piece, log-mass of the node, edges taken).
    waiting: list[list[tuple]] = [[] for _ in texts]
    roots = (-np.log(-np.log(_uniform(seed, 0)))).tolist()
    none = np.zeros(0, np.int64)
    for turn in range(k):
        # Texts, values, log-masses, edges so far, and where the words that are drawn anew begin.
        jobs, nodes, places, extra = [], [], [], []
        own_seed = _hash(seed, turn + 1)
        first, second = (_uniform(own_seed, -n).tolist() for n in (1, 2))
        for d in range(len(texts)):
            a, b = int(bounds[d]), int(bounds[d + 1])
            if not turn:
                jobs.append((d, roots[d], 0.0, none))
            elif waiting[d]:
                value, s, t, logm, taken = waiting[d].pop(0)
                path = found[d][s][0]
                n = int(np.searchsorted(lat.first, path[t], side="right"))
                x, y = int(lat.first[n - 1]), int(lat.first[n])
                p = np.exp(lat.logp[x:y]).tolist()
                free = [e for e in range(x, y) if e not in taken]
                u, at = first[d] * sum(p[e - x] for e in free), 0.0
                for pick in free:
                    at += p[pick - x]
                    if at >= u:
                        break
                rest = [p[e - x] for e in free if e != pick]
                if rest:
                    other = -float(np.logaddexp(-value, math.log(-math.log(second[d])) - logm - math.log(max(sum(rest), 1e-300))))
                    extra.append((d, (other, turn, t, logm, (*taken, pick))))
                jobs.append((d, value, logm + float(lat.logp[pick]), np.append(path[:t], pick)))
                a += int(np.count_nonzero(lat.to[path[:t]] < 0))
                if lat.to[pick] >= 0:
                    nodes.append(lat.to[pick : pick + 1])
                    places.append(np.array([a], np.int64))
                a += 1
            else:
                continue
            nodes.append(starts[a:b])
            places.append(np.arange(a, b))
            jobs[-1] += (sum(map(len, nodes[-2:])) if turn and lat.to[jobs[-1][3][-1]] >= 0 else b - a,)
        if not jobs:
            break
        of = np.array([j[0] for j in jobs])
        words = np.array([j[4] for j in jobs], np.int64)
        place = np.concatenate(places) - np.repeat(bounds[of], words)
        base = _hash(np.repeat(own_seed[of], words), place)
        edges, count = lat.walk(np.concatenate(nodes), base)
        ends = np.concatenate([[0], np.cumsum(count)])
        cuts = ends[np.concatenate([[0], np.cumsum(words)])]
        logp = lat.logp[edges]
        run, stops = np.empty(len(edges)), []
        for (_, _, logm, _, _), a, b in zip(jobs, cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                np.cumsum(logp[a:b], out=run[a:b])
                run[a:b] += logm
            # Where the walk is this unlikely no sibling comes up any more, as a rule; that is checked below.
            stops.append(min(b, b - int(np.searchsorted(run[a:b][::-1], logm - REACH)) + 1))
        # Each edge's siblings as one subtree: its value, drawn below that of the walk.
        word = np.repeat(np.arange(len(count), dtype=np.int32), count)

        def siblings(forks: np.ndarray) -> tuple[np.ndarray, ...]:
            rest = lat.rest[edges[forks]]
            some = rest > -np.inf
            forks, rest, of_word = forks[some], rest[some], word[forks[some]]
            u = _uniform(base[of_word], 2 * (forks - ends[of_word]) + 1)
            before = run[forks] - logp[forks]
            # A value grows with this number, so the best are chosen by it.
            return forks, before, np.log(-np.log(u)) - before - rest

        sizes = np.array(stops) - cuts[:-1]
        every = siblings(np.repeat(np.array(stops) - np.cumsum(sizes), sizes) + np.arange(sizes.sum()))
        xs, ys = np.searchsorted(every[0], cuts[:-1]).tolist(), np.searchsorted(every[0], stops).tolist()
        room = k - turn  # subtrees that can still come up, and one for the threshold
        for (d, value, logm, so_far, _), a, b, stop, x, y in zip(jobs, cuts[:-1].tolist(), cuts[1:].tolist(), stops, xs, ys):
            forks, before, below = (part[x:y] for part in every)
            best = np.argpartition(below, room)[:room] if y - x > room else np.arange(y - x)
            if stop < b and (y - x < room or below[best].max() > REACH - EASIEST - logm):
                forks, before, below = siblings(np.arange(a, b))
                best = np.argpartition(below, room)[:room] if len(forks) > room else np.arange(len(forks))
            for f in best.tolist():
                e = int(forks[f])
                waiting[d].append((-float(np.logaddexp(-value, below[f])), turn, len(so_far) + e - a, float(before[f]), (int(edges[e]),)))
            path = edges[a:b] if not len(so_far) else np.concatenate([so_far, edges[a:b]])
            found[d].append((path, float(run[b - 1]) if b > a else logm, value))
        for d, entry in extra:
            waiting[d].append(entry)
        for d in of.tolist():
            waiting[d].sort(reverse=True)
            del waiting[d][room:]
    out = []
    for own_found, others in zip(found, waiting):
        threshold = others[0][0] if others else -math.inf
        out.append([Sample(lat.piece[path], p, v, -math.expm1(-math.exp(min(p - threshold, 700.0)))) for path, p, v in own_found])
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def top_segmentations(chain: Chain, k: int, seed: int) -> list[tuple[tuple[int, ...], float, float, float]]:
    """Up to ``k`` distinct segmentations as (ids, log-probability, perturbed value, inclusion score), best first."""
    return [(tuple(chain.vocabulary.ids(x.pieces)[0].tolist()), *x[1:]) for x in sample(chain.vocabulary, [chain.words], [seed], k)[0]]


def sample_segmentations(rows: DataFrame, model_path: str, k: int = 3, seed: int = 1, key_col: str = "row_key", text_col: str = "text", out_col: str | None = None) -> DataFrame:
    """``(row_key, sample, ids, log_prob, perturbed, inclusion)``: for every row up to ``k`` distinct segmentations of its
    whole text, numbered from 1 in the order of their perturbed values.

    A text with fewer segmentations gives all it has, each with the inclusion score 1.  A null or empty text has one, the
    empty one.  Rows that repeat a key and a text give the same rows again; a null key is a key.  An empty table gives no
    rows; other columns are ignored.  With ``out_col`` every row has the text that ``decode`` makes of its ids, too, without
    their moving to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        names = ["row_key", "sample", "ids", "log_prob", "perturbed", "inclusion", *([out_col] if out_col else [])]
        for b in slices(batches, 1, 1 << 20):
            keys = b.column(0).to_pylist()
            seeds = [xxhash.xxh64_intdigest("" if key is None else key, seed) for key in keys]
            of = draw(own, *own.numbered(b.column(1)), seeds, k)
            rows = [x for found in of for x in found]
            ids, n = own.ids(np.concatenate([x.pieces for x in rows]) if rows else np.zeros(0, np.int32))
            ends = np.cumsum([0, *(len(x.pieces) for x in rows)])
            if n is not None:
                ends = np.concatenate([[0], np.cumsum(n)])[ends]
            columns = [
                pa.array([key for key, found in zip(keys, of) for _ in found], pa.string()),
                pa.array([m + 1 for found in of for m in range(len(found))], pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                *(pa.array([x[f] for x in rows], pa.float64()) for f in (1, 2, 3)),
            ]
            if out_col:
                columns.append(own.decode_lists(columns[2]))
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = f"{SAMPLES}, `{out_col}` string" if out_col else SAMPLES
    return rows.select(F.col(key_col).cast("string").alias("row_key"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), kinds)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row's ids; null ids give null.  A "▁" in a text decodes as a space, as in the library.  An input column of that name is replaced."""
    rows = rows.drop(out_col)
    place, schema = rows.columns.index(ids_col), rows.withColumn(out_col, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < whole.num_rows:  # parts of about half a million ids, or one row
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, side="right")))
                b = whole.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*b.columns, own.decode_lists(b.column(place))], [*b.schema.names, out_col])
                at = to

    return rows.mapInArrow(lean(run), schema)
