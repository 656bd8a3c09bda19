"""Sampled SentencePiece segmentations by Gumbel top-k without replacement, and decoding.

A text's lattice holds every way to cover it with pieces of the vocabulary; a
character that no piece covers is the pieces of its bytes. A piece's
probability falls with its rank in the vocabulary. The best ``SAMPLES`` leaves
of the perturbed lattice are distinct segmentations, sampled without
replacement. They are found by A* search: a leaf splits what remains into the
groups of segmentations that leave its path at each piece; a group's bound, a
Gumbel of the group's total mass below the leaf's own, is exactly the best perturbed
score within it, so the group with the largest bound holds the next sample,
which is drawn only then. The best bound left over is the threshold that gives
each sample its inclusion probability.

No piece crosses the mark that stands for a space, so the lattice falls into
parts, whose backward sums each worker keeps for parts met again, until there
are more than ``NODES`` nodes, when it begins anew. Parts longer than ``LONG`` characters, such as junk without a space, go from their end
to their start in blocks, each with its few edges only. Substrings are sought by a hash and then compared
with the piece. Paths are drawn for all parts of a batch at once, and the last few one by one. Random
numbers are a hash of row key, round and place, so results do not depend on
batches, partitions or lost executors.

Defined results: a null or empty text has one segmentation, of no pieces; a
text with fewer segmentations than asked has just those; a literal mark U+2581
decodes to a space, as in the library; rows with the same id and text get the
same samples; a null id is a key of its own; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SAMPLES = 2
SEED = 11
SHIFT = 10.0
NODES = 2_500_000
LONG = 2048
PREFIX = 3
FEW = 4
GUMBEL = 37.0  # above -log(-log(u)) of every u that ``uniform`` gives
WINDOW = 448  # pieces whose bounds are computed at once
ROWS = 32
MARK = "▁"
_U = np.uint64
_GOLD, _C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _hash(piece: str) -> int:
    """The polynomial of a string's code points that ``Lattice`` computes for all substrings at once."""
    return sum((ord(c) + 1) * pow(int(_BASE), i, 1 << 64) for i, c in enumerate(piece)) & 0xFFFFFFFFFFFFFFFF


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of counters."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


def counter(base, number: int, by: np.uint64):
    """base + number * by, wrapping around."""
    return base + _U((number * int(by)) & 0xFFFFFFFFFFFFFFFF)


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) of hashed counters."""
    return ((mixed(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Places:
    """Places of 64-bit hashes in an array of them, sought from where those begin that share their first bits once scrambled."""

    def __init__(self, hashes: np.ndarray, bits: int = 18):
        scrambled = hashes * _C1
        self.order, self.shift, self.last = np.argsort(scrambled), _U(64 - bits), len(hashes) - 1
        self.sought = scrambled[self.order]
        first = self.sought >> self.shift
        self.begin = np.minimum(np.searchsorted(first, np.arange(1 << bits, dtype=_U)), self.last).astype(np.int32)
        self.steps = int(np.bincount(first.astype(np.int64)).max()) - 1

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are there, and the place of each that is."""
        h = hashes * _C1
        place = self.begin[h >> self.shift]
        there = self.sought[place]
        for _ in range(self.steps):
            place = np.minimum(place + (there < h), self.last)
            there = self.sought[place]
        return there == h, self.order[place]


class Lattice:
    """Conditional distributions of pieces at the nodes of text parts, as one sorted array.

    The edges of node n have keys in (n, n + 1], their cumulative probabilities
    added to n, so that one search of n + u draws an edge.
    """

    def __init__(self, path: str, nodes: int = NODES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        total = math.log(sum(1 / (r + SHIFT) for r in range(len(plain) + 256)))
        self.pieces = {model.id_to_piece(i): (i, -math.log(r + SHIFT) - total) for r, i in enumerate(plain)}
        self.longest = max(map(len, self.pieces))
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_cost = -math.log(len(plain) + SHIFT) - total
        self.raw = [b""] * size
        for p, (i, _) in self.pieces.items():
            self.raw[i] = p.encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.raw_sizes = np.array([len(r) for r in self.raw])
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.size, self.limit = size, nodes
        self.by_length, self.sought = {}, {}
        for n in sorted({len(p) for p in self.pieces}):
            some = sorted((_hash(p), i, cost) for p, (i, cost) in self.pieces.items() if len(p) == n)
            hashes, ids, costs = (np.array(x, t) for x, t in zip(zip(*some, strict=True), (_U, np.int64, np.float64), strict=True))
            letters = np.array([[ord(c) for c in model.id_to_piece(i)] for i in ids.tolist()], np.uint32)
            self.by_length[n] = hashes, ids, costs, letters
            self.sought[n] = Places(hashes)
        masks: dict[int, int] = {}
        for p in self.pieces:
            if len(p) > PREFIX:
                masks[_hash(p[:PREFIX])] = masks.get(_hash(p[:PREFIX]), 0) | 1 << len(p)
        masks = masks or {0: 0}
        self.prefixes = Places(np.array(sorted(masks), _U))
        self.prefix_lengths = np.array([masks[h] for h in sorted(masks)], np.int64)
        self._clear()

    def _clear(self) -> None:
        self.starts: dict[str, int] = {}
        self.nodes = 0
        self.keys, self.logs, self.targets, self.items = array("d"), array("d"), array("i"), array("i")
        self.firsts = array("i", [0])
        self.spelt: list[bytes] = []
        self.single = np.arange(self.size)
        self.spelt_at: dict[str, int] = {}

    def _fallback(self, char: str) -> tuple[int, float]:
        """The item of a character that is spelt by bytes."""
        if char not in self.spelt_at:
            self.spelt_at[char] = self.size + len(self.spelt)
            self.spelt.append(np.asarray([self.byte_ids[b] for b in char.encode("utf-8", "replace")], "<u2").tobytes())
        at = self.spelt_at[char]
        return at, self.byte_cost * (len(self.spelt[at - self.size]) // 2)

    def _matches(self, text: str, left: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """How many pieces begin at each of the first characters, and for each length, the shortest first, (characters,
        how many shorter ones begin there, log probabilities, items); ``left``: characters to the part's end."""
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = letters.astype(_U) + _U(1)
        power, inverse = np.full(len(codes), _BASE), np.full(len(codes), _INVERSE)
        power[:1] = inverse[:1] = 1
        power, inverse = np.cumprod(power), np.cumprod(inverse)
        sums = np.r_[_U(0), np.cumsum(codes * power)]
        at = np.flatnonzero(left >= PREFIX)
        h = (sums[at + PREFIX] - sums[at]) * inverse[at]
        hit, place = self.prefixes.find(h)
        lengths = np.zeros(len(left), np.int64)
        lengths[at] = np.where(hit, self.prefix_lengths[place], 0)
        count, found = np.zeros(len(left), np.int32), []
        for n, (_, ids, costs, spelt) in self.by_length.items():
            at = np.flatnonzero((left >= n) & ((lengths >> n) & 1 == 1) if n > PREFIX else left >= n)
            h = (sums[at + n] - sums[at]) * inverse[at]
            hit, place = self.sought[n].find(h)
            at, place = at[hit], place[hit]
            for i in range(n):  # the same hash is the same piece only if every letter is
                same = letters[at + i] == spelt[place, i]
                if not same.all():
                    at, place = at[same], place[same]
            logs, items = costs[place], ids[place]
            if n == 1 and len(at) < len(left):
                bare = np.setdiff1d(np.arange(len(left)), at, assume_unique=True)
                spelt_items, spelt_logs = zip(*(self._fallback(text[i]) for i in bare.tolist()), strict=True)
                at, logs, items = np.r_[at, bare], np.r_[logs, spelt_logs], np.r_[items, spelt_items]
            found.append((n, at, count[at], logs, items))
            count[at] += 1
        return count, found

    def _found(self, text: str, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same pieces as tables: log probability (-inf: none) and item of the piece of each length at each character."""
        logs = np.full((len(left), self.longest), -np.inf)
        items = np.zeros((len(left), self.longest), np.int64)
        for n, at, _, some, which in self._matches(text, left)[1]:
            logs[at, n - 1], items[at, n - 1] = some, which
        return logs, items

    @staticmethod
    def _laid(found: list[tuple], firsts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each edge's log probability, item, node and length, a node's from its place in ``firsts`` on, shortest first."""
        logs, items = np.empty(total), np.empty(total, np.int64)
        nodes, lengths = np.empty(total, np.int64), np.empty(total, np.int64)
        for n, at, before, some, which in found:
            to = firsts[at] + before
            logs[to], items[to], nodes[to], lengths[to] = some, which, at, n
        return logs, items, nodes, lengths

    def _enter(self, count: np.ndarray, odds: np.ndarray, logs: np.ndarray, items: np.ndarray, nodes: np.ndarray, lengths: np.ndarray, left: np.ndarray, first: int) -> None:
        """Append edges, in the order of their nodes, of nodes from ``first`` on; each node's ``odds`` are a distribution."""
        ends = np.cumsum(count)
        sums = np.r_[0.0, np.cumsum(odds)]
        keys = np.clip(sums[1:] - sums[ends - count][nodes], 0.0, 1.0)
        keys[ends - 1] = 1.0
        target = np.where(lengths < left[nodes], first + nodes + lengths, -1)
        for held, more in ((self.keys, first + nodes + keys), (self.logs, np.minimum(logs, 0.0)), (self.targets, target), (self.items, items)):
            held.frombytes(more.astype(held.typecode, copy=False).tobytes())
        self.firsts.frombytes((self.firsts[-1] + ends).astype("i").tobytes())
        self.nodes += len(left)

    def _add_long(self, part: str) -> None:
        """Enter one long part: backward sums node by node in blocks, scaled so that they stay within a double's range."""
        n, block, scaled = len(part), 1 << 14, [0.0] * self.longest
        scaled[0] = 1.0  # sums of the nodes that follow, relative to the first of them
        kept = []
        for lo in range((n - 1) // block * block, -1, -block):
            left = n - lo - np.arange(min(block, n - lo))
            count, found = self._matches(part[lo : lo + len(left) + self.longest], left)
            ends = np.cumsum(count)
            logs, items, nodes, lengths = self._laid(found, ends - count, int(ends[-1]))
            edges, slots, odds = np.r_[0, ends].tolist(), (lengths - 1).tolist(), np.exp(logs).tolist()
            share = [0.0] * len(odds)
            for i in range(len(left) - 1, -1, -1):
                a, b = edges[i], edges[i + 1]
                each = [odds[k] * scaled[slots[k]] for k in range(a, b)]
                total = sum(each)
                share[a:b] = [x / total for x in each]
                scaled = [1.0, *[x / total for x in scaled[:-1]]]
            share = np.array(share)
            kept.append((count, share, np.log(np.maximum(share, 1e-300)), items, nodes, lengths, left))
        begin = self.nodes
        for at, edges in enumerate(reversed(kept)):
            self._enter(*edges, begin + at * block)
        self.starts[part] = begin

    def _add(self, new: list[str]) -> None:
        """Enter parts of text: their nodes' edges, by backward sums of all parts at once."""
        for part in new:
            if len(part) > LONG:
                self._add_long(part)
        new = [p for p in new if len(p) <= LONG]
        if not new:
            return
        sizes = np.array([len(p) for p in new])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(new)), sizes)
        left = ends[owner] - np.arange(ends[-1])
        count, found = self._matches("".join(new), left)
        order = np.argsort(left, kind="stable")  # edges lie in this order for the sums, those nearest their part's end first
        many = count[order].astype(np.int64)
        begin = np.cumsum(many) - many
        placed = np.empty(len(left), np.int64)
        placed[order] = begin
        logs, items, nodes, lengths = self._laid(found, placed, int(many.sum()))
        target = nodes + owner[nodes] + lengths  # a slot more for each part's end, whose sum is 0
        beta, slot, odds = np.zeros(ends[-1] + len(new)), order + owner[order], np.empty(len(logs))
        groups = np.r_[0, np.cumsum(np.bincount(left)[1:])]
        for lo, hi in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            if lo == hi:
                continue
            a, b = int(begin[lo]), int(begin[hi - 1] + many[hi - 1])
            at, each = begin[lo:hi] - a, many[lo:hi]
            v = logs[a:b] + beta[target[a:b]]
            top = np.maximum.reduceat(v, at)
            mass = np.exp(v - np.repeat(top, each))
            total = np.add.reduceat(mass, at)
            odds[a:b] = mass / np.repeat(total, each)
            beta[slot[lo:hi]] = top = top + np.log(total)
            logs[a:b] = v - np.repeat(top, each)
        by_node = np.repeat(placed - (np.cumsum(count) - count), count) + np.arange(len(logs))
        first = self.nodes
        self._enter(count, *(x[by_node] for x in (odds, logs, items, nodes, lengths)), left, first)
        self.starts.update(zip(new, (first + ends - sizes).tolist(), strict=True))

    def parts(self, texts: list[str]) -> list[np.ndarray]:
        """First nodes of each text's parts."""
        if self.nodes > self.limit:
            self._clear()
        split = [_parts(t) for t in texts]
        new = list({p for ps in split for p in ps}.difference(self.starts))
        for at in range(0, len(new), 8192):
            self._add(new[at : at + 8192])
        get = self.starts.__getitem__
        return [np.fromiter(map(get, ps), np.int64, len(ps)) for ps in split]

    def view(self) -> Tables:
        return Tables(*(np.frombuffer(a, t) if len(a) else np.empty(0, t) for a, t in ((self.keys, np.float64), (self.logs, np.float64), (self.targets, np.int32), (self.items, np.int32), (self.firsts, np.int32))))

    def ids(self, items: np.ndarray) -> bytes:
        """16-bit piece ids of a path's items."""
        if len(self.single) != self.size + len(self.spelt):
            self.single = np.r_[np.arange(self.size), [int.from_bytes(b, "little") if len(b) == 2 else -1 for b in self.spelt]].astype(np.int64)
        ids = self.single[items]
        if not len(ids) or ids.min() >= 0:
            return ids.astype("<u2").tobytes()
        return b"".join(self.spelt[i - self.size] if i >= self.size else i.to_bytes(2, "little") for i in items.tolist())

    def decode(self, ids: bytes) -> str:
        """The text of 16-bit piece ids."""
        which = np.frombuffer(ids, "<u2")
        sizes = self.raw_sizes[which]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.raw_starts[which] - (ends - sizes), sizes)
        return self.raw_bytes[at].tobytes().decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


def _parts(text: str) -> list[str]:
    """The text with marks for its spaces, cut before each run of marks."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return [MARK + w for w in words]
    out, marks = [], ""
    for w in words:
        marks += MARK
        if w:
            out.append(marks + w)
            marks = ""
    return [*out, marks] if marks else out


class Tables:
    def __init__(self, keys, logs, targets, items, firsts):
        self.keys, self.logs, self.targets, self.items, self.firsts = keys, logs, targets, items, firsts

    def edge(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that u falls to, by halving the node's own few edges."""
        low, high, sought = self.firsts[nodes].astype(np.int64), self.firsts[nodes + 1].astype(np.int64) - 1, nodes + u
        while (low < high).any():
            mid = (low + high) >> 1
            above = self.keys[mid] <= sought
            low, high = np.where(above, mid + 1, low), np.where(above, high, mid)
        return low

    def draw(self, nodes: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each node to its part's end: all edges in order, and where each path starts among them."""
        found, active, now = [], np.arange(len(nodes)), nodes
        count = np.zeros(len(nodes), np.int64)
        step = 0
        while len(active) > FEW:
            u = uniform(counter(salts[active], step, _C1))
            edge = self.edge(now, u)
            found.append((active, edge))
            count[active] += 1
            now = self.targets[edge].astype(np.int64)
            going = now >= 0
            active, now = active[going], now[going]
            step += 1
        singles = [(who, step, self._walk(int(node), int(salts[who]), step)) for who, node in zip(active.tolist(), now.tolist(), strict=True)]
        for who, _, path in singles:
            count[who] += len(path)
        at = np.r_[0, np.cumsum(count)]
        edges = np.empty(at[-1], np.int64)
        for who, begin, path in singles:
            edges[at[who] + begin : at[who + 1]] = path
        for step, (who, edge) in enumerate(found):
            edges[at[who] + step] = edge
        return edges, at

    def _walk(self, node: int, salt: int, step: int) -> list[int]:
        """The rest of one path from its ``step`` on, drawn in blocks of random numbers."""
        out: list[int] = []
        firsts, keys, targets = self.firsts, self.keys, self.targets
        while node >= 0:
            many = min(1 << 16, max(16, len(out)))
            numbers = uniform(_U(salt) + np.arange(step + len(out), step + len(out) + many, dtype=_U) * _C1).tolist()
            for u in numbers:
                lo = int(firsts[node])
                edge = lo + int(keys[lo : firsts[node + 1] - 1].searchsorted(node + u, side="right"))
                out.append(edge)
                node = int(targets[edge])
                if node < 0:
                    break
        return out

    def other(self, node: int, barred: set[int], u: float) -> int:
        """An edge of a node that is none of the barred ones."""
        lo, hi = self.firsts[node], self.firsts[node + 1]
        edges = np.array([e for e in range(lo, hi) if e not in barred])
        p = np.exp(self.logs[edges])
        return int(edges[min(np.searchsorted(np.cumsum(p), u * p.sum(), side="right"), len(edges) - 1)])


class Leaf:
    """A segmentation, and the bounds of the groups that leave it at each of its pieces.

    A group's mass is at most the path's probability up to its piece, and no Gumbel is above ``GUMBEL``, so the best
    bound lies among the first pieces: ``bounds`` are those from ``begin`` to ``stop``, further ones are computed only
    while one of them can be better."""

    def __init__(self, tables: Tables, edges: np.ndarray, at: np.ndarray, score: float, begin: int, barred: set[int], salt: np.uint64):
        self.edges, self.at, self.score, self.begin, self.barred, self.salt = edges, at, score, begin, barred, salt
        self.logs = tables.logs[edges]
        self.log_prob = float(self.logs.sum())
        self.gone = float(np.exp(tables.logs[sorted(barred)]).sum()) if barred and len(edges) else None
        self.stop, self.before = begin, float(self.logs[:begin].cumsum()[-1]) if begin else 0.0
        self.bounds = np.empty(0)

    def best(self) -> tuple[float, int]:
        bound = self.bounds.max(initial=-np.inf)
        while self.stop < len(self.edges) and bound <= self.before + GUMBEL:
            extend([self])
            bound = self.bounds.max(initial=-np.inf)
        return (float(bound), self.begin + int(self.bounds.argmax())) if len(self.bounds) else (-np.inf, -1)

    def used(self, j: int) -> None:
        """The group that leaves at piece ``j`` is a leaf of its own."""
        self.bounds[j - self.begin] = -np.inf


def extend(leaves: list[Leaf]) -> None:
    """Bounds of some further pieces of each leaf, computed for leaves with about as many at once, a row for each."""
    todo = [(min(max(WINDOW, leaf.stop - leaf.begin), len(leaf.edges) - leaf.stop), leaf) for leaf in leaves]
    todo.sort(key=lambda x: x[0])
    for at in range(0, len(todo), ROWS):
        many, some = zip(*todo[at : at + ROWS], strict=True)
        _extend(some, many)


def _extend(leaves: tuple[Leaf, ...], many: tuple[int, ...]) -> None:
    width = many[-1]
    before = np.zeros((len(leaves), width + 1))
    for row, leaf, n in zip(before, leaves, many, strict=True):
        row[0], row[1 : n + 1] = leaf.before, leaf.logs[leaf.stop : leaf.stop + n]
    left = 1 - np.exp(before[:, 1:])
    for row, leaf in zip(left, leaves, strict=True):
        if width and leaf.stop == leaf.begin and leaf.gone is not None:
            row[0] = 1 - leaf.gone
    before = before.cumsum(axis=1)
    place = np.array([leaf.stop for leaf in leaves], _U)[:, None] + np.arange(width, dtype=_U)
    noise = uniform(np.array([leaf.salt for leaf in leaves], _U)[:, None] + place * _GOLD)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        mass = np.where(left > 1e-12, before[:, :-1] + np.log(np.maximum(left, 1e-300)), -np.inf)
        bounds = mass - np.log(np.exp(np.minimum(mass - np.array([[leaf.score] for leaf in leaves]), 700.0)) - np.log(noise))
    bounds[~np.isfinite(mass)] = -np.inf
    for leaf, row, sums, n in zip(leaves, bounds, before, many, strict=True):
        leaf.bounds = np.concatenate((leaf.bounds, row[:n])) if len(leaf.bounds) else row[:n].copy()
        leaf.stop, leaf.before = leaf.stop + n, float(sums[n])


def sample(lattice: Lattice, texts: list[str], keys: np.ndarray, k: int = SAMPLES) -> list[list[tuple[bytes, float, float, float]]]:
    """For each text (ids, log probability, perturbed score, log inclusion probability) of up to ``k`` segmentations."""
    starts = lattice.parts(texts)
    tables = lattice.view()
    many = np.array([len(s) for s in starts])
    owner = np.repeat(np.arange(len(texts)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    edges, at = tables.draw(np.concatenate(starts) if len(starts) else np.empty(0, np.int64), mixed(keys[owner] + place.astype(_U) * _GOLD))
    ends = np.r_[0, np.cumsum(many)]
    salts = [mixed(counter(keys ^ _U(0xA5A5A5A5), r, _C2)) for r in range(k + 1)]  # of scores, then of each round's bounds
    first = uniform(salts[0])
    leaves: list[list[Leaf]] = []
    for d in range(len(texts)):
        part = at[ends[d] : ends[d + 1] + 1]
        own = edges[part[0] : part[-1]]
        score = -math.log(-math.log(float(first[d])))
        leaves.append([Leaf(tables, own, part - part[0], score, 0, set(), salts[1][d])])
    if leaves:
        extend([own[0] for own in leaves])
    for r in range(1, k):
        chosen = []
        for d, own in enumerate(leaves):
            (bound, j), leaf = max(((leaf.best(), leaf) for leaf in own), key=lambda x: x[0][0])
            if len(own) == r and bound > -np.inf:
                old = int(leaf.edges[j])
                barred = (leaf.barred if j == leaf.begin else set()) | {old}
                new = tables.other(math.ceil(tables.keys[old]) - 1, barred, float(uniform(mixed(counter(keys[d : d + 1] ^ _U(0xA5A5A5A5), 2 * r + 10_000, _C2)))[0]))
                unit = int(np.searchsorted(leaf.at, j, side="right")) - 1
                rest = starts[d][unit + 1 :]
                inner = int(tables.targets[new])
                chosen.append((d, leaf, j, bound, barred, new, unit, np.concatenate(([inner], rest)) if inner >= 0 else rest, inner >= 0))
        if not chosen:
            break
        lengths = [len(c[7]) for c in chosen]
        drawn = np.concatenate([mixed(counter(keys[c[0] : c[0] + 1], r, _C1) + np.arange(n, dtype=_U) * _GOLD) for c, n in zip(chosen, lengths, strict=True)])
        edges, at = tables.draw(np.concatenate([c[7] for c in chosen]), drawn)
        begin = 0
        for (d, leaf, j, bound, barred, new, unit, _, inside), n in zip(chosen, lengths, strict=True):
            part = at[begin : begin + n + 1]
            begin += n
            whole = np.concatenate([leaf.edges[:j], [new], edges[part[0] : part[-1]]])
            tail = part - part[0] + j + 1
            marks = np.concatenate((leaf.at[: unit + 1], tail[1:] if inside else tail))
            leaf.used(j)
            leaves[d].append(Leaf(tables, whole, marks, bound, j, barred | {new}, salts[r + 1][d]))
        extend([leaves[c[0]][-1] for c in chosen])
    out = []
    for own in leaves:
        threshold = max(leaf.best()[0] for leaf in own)
        rows = []
        for leaf in own:
            x = leaf.log_prob - threshold
            rows.append((lattice.ids(tables.items[leaf.edges]), leaf.log_prob, leaf.score, x if x < -30 else 0.0 if x > 5 else math.log(-math.expm1(-math.exp(x)))))
        out.append(rows)
    return out


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One lattice for each worker process and vocabulary."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def row_keys(ids: list, seed: int = SEED) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(repr(i).encode(), seed) for i in ids], _U)


def encoded(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, path: str | None = None, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, sample, n_pieces, log_prob, log_inclusion, ids) of up to ``k`` segmentations of every row.

    ``digest``: instead of the ids, the unsigned CRC-32 of them as 32-bit integers and whether they decode to the text.
    """
    path = path or vocabulary()
    ending = "ids_crc32 long, decoded boolean" if digest else "ids binary"

    def run(batches):
        from .tokens import slices

        model = lattice(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(batch.column(1), 1 << 20):
                rows = []
                for doc_id, text, found in zip(ids[a:b], texts[a:b], sample(model, texts[a:b], row_keys(ids[a:b], seed), k), strict=True):
                    plain = text.replace(MARK, " ") if digest else ""
                    for s, (raw, log_prob, _, inclusion) in enumerate(found):
                        last = (zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()), model.decode(raw) == plain) if digest else (raw,)
                        rows.append((doc_id, s, len(raw) // 2, log_prob, inclusion, *last))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), *((pa.int64(), pa.bool_()) if digest else (pa.binary(),))]
                names = ["doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", *(x.split()[0] for x in ending.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, {ending}")


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of a column of 16-bit piece ids; null ids stay null."""
    path = path or vocabulary()
    at = rows.columns.index(ids)
    plain = rows.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)))

    def run(batches):
        model = lattice(path)
        for batch in batches:
            texts = [None if r is None else model.decode(r) for r in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "out"])

    from pyspark.sql import types as T

    made = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("out", T.StringType())])).toDF(*rows.columns, f"{out}\x00")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != out]
    return made.select(*kept, F.col(f"`{out}\x00`").alias(out))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), digest=True)
