"""Segmentation lattices over a fixed public vocabulary, in numpy, many words at a time.

Texts are handled as UTF-8 bytes in which every space, and the start of the text, is the
byte 0xFF (it never occurs in UTF-8 and stands for the vocabulary's word mark). Pre-tokens
start at each mark and around each line feed, so pieces never cross them. Those of over 40
bytes are cut further, but only where no piece of the vocabulary crosses, so that no segmentation
is lost; what is long even then has a node per byte beside the trie. Substrings are compared by
64-bit polynomial hashes. Characters that are no piece are spelt by byte pieces.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = 0xFF
#: Bytes of the longest pre-tokens that share a trie; longer ones are whole as well, but share no prefixes.
CUT = 40
#: Bytes of text that one step of the numpy code takes at a time; a worker needs some hundred times as much.
BLOCK = 1_000_000
_RNG = np.random.default_rng(17)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SIZE_BITS = 18
_STIR = np.uint64(0xD6E8FEB86659FD93)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _powers_of.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers_of[base] = np.multiply.accumulate(steps)
    return have[:n]


class Hashes:
    """Prefix hashes of a byte buffer; `of(a, b)` hashes the bytes from a to b."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODE[data] * _powers(_BASE, len(data)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(data) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.back[a]


def stir(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces of a SentencePiece model with a cuckoo table from hash to id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.raw: list[bytes] = [b""] * self.size
        self.rank = np.full(self.size, self.size, dtype=np.float64)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        keys: dict[int, int] = {}
        for i in range(self.size):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
                continue
            raw = sp.id_to_piece(i).encode().replace("▁".encode(), b"\xff")
            if b"\xff" in raw[1:] or sp.get_score(i) < -1e8:
                continue
            self.raw[i], self.rank[i] = raw, -sp.get_score(i)
            data = np.frombuffer(raw, dtype=np.uint8)
            keys[int(Hashes(data).of(np.array([0]), np.array([len(data)]))[0])] = i
        self.lengths = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.longest = int(max(len(self.raw[i]) for i in keys.values()))
        self._build(keys)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - _SIZE_BITS)
        return (h * np.uint64(_BASE)) >> shift, (h * _STIR) >> shift

    def _build(self, keys: dict[int, int]) -> None:
        self.table = np.zeros(1 << _SIZE_BITS, dtype=np.uint64)
        self.ids = np.full(1 << _SIZE_BITS, -1, dtype=np.int32)
        first, second = (s.astype(int).tolist() for s in self._slots(np.array(list(keys), dtype=np.uint64)))
        places = {h: (a, b) for h, a, b in zip(keys, first, second, strict=True)}
        held: dict[int, int] = {}
        for h in keys:
            now, at = h, places[h][0]
            for _ in range(500):
                now, held[at] = held.get(at), now
                if now is None:
                    break
                a, b = places[now]
                at = b if at == a else a
            else:
                raise ValueError("the vocabulary does not fit its table")
        for at, h in held.items():
            self.table[at], self.ids[at] = h, keys[h]
        # Most hashes that are looked up are no piece's; a megabyte of flags tells nearly all of these.
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[np.array(list(keys), dtype=np.uint64) >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        out = np.full(len(h), -1, dtype=np.int32)
        some = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        h = h[some]
        a, b = self._slots(h)
        out[some] = np.where(self.table[a] == h, self.ids[a], np.where(self.table[b] == h, self.ids[b], np.int32(-1)))
        return out

    def zipf_log_probabilities(self) -> np.ndarray:
        """The public model holds merge ranks, not probabilities: by Zipf's law, the piece
        of rank r gets a share in proportion to 1 / (r + 2.7); bytes share one percent."""
        usable = self.rank < self.size
        p = np.where(usable, 1 / (self.rank + 2.7), 0)
        p = 0.99 * p / p.sum()
        p[self.byte_ids] = 0.01 / 256
        with np.errstate(divide="ignore"):
            return np.log(p)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and their offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches cut so that texts take `limit` bytes at most, or are one text. At the end, a
    worker gives the memory that it freed back, since it lives on beside the next stages."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Pretokens:
    """Pre-tokens of many texts: marked buffer, starts, ends and the text each is of. With a
    vocabulary, long ones are cut where none of its pieces crosses."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary | None = None):
        texts = len(offsets) - 1
        marks = offsets[:-1] + np.arange(texts)
        self.data = np.empty(len(data) + texts, dtype=np.uint8)
        inner = np.ones(len(self.data), dtype=bool)
        inner[marks] = False
        self.data[inner] = data
        self.data[marks] = MARK
        self.data[self.data == 0x20] = MARK
        self.bounds = offsets + np.arange(texts + 1)
        begin = (self.data == MARK) | (self.data == 0x0A)
        begin[1:] |= self.data[:-1] == 0x0A
        self.starts = np.flatnonzero(begin)
        sizes = np.diff(np.append(self.starts, len(self.data)))
        if vocab is not None and len(sizes) and sizes.max() > CUT:
            self._cut(begin, sizes, vocab)
        self.ends = np.append(self.starts[1:], len(self.data))
        self.text = np.searchsorted(self.bounds, self.starts, side="right") - 1

    def _cut(self, begin: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> None:
        """Inside long ones, start anew at each character's start that no piece crosses."""
        place, _, depth = _bytes_of(self.starts[sizes > CUT], sizes[sizes > CUT])
        flat = self.data[place]
        hashes, change = Hashes(flat), np.zeros(len(flat) + 1, dtype=np.int32)
        for n in range(2, vocab.longest + 1):
            last = np.flatnonzero(depth >= n)
            last = last[vocab.find(hashes.of(last + 1 - n, last + 1)) >= 0]
            change[last + 2 - n] += 1
            change[last + 1] -= 1
        free = (np.cumsum(change)[:-1] == 0) & ((flat & 0xC0) != 0x80)
        begin[place[free]] = True
        self.starts = np.flatnonzero(begin)

    def blocks(self, limit: int = BLOCK) -> Iterator[slice]:
        """Ranges of pre-tokens of about `limit` bytes."""
        at = 0
        while at < len(self.starts):
            end = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + limit, side="right")))
            yield slice(at, end)
            at = end


def _bytes_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte of these ranges: its place, its range, and its number there from 1."""
    begins, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    depth = np.arange(total) - np.repeat(begins, sizes) + 1
    return np.repeat(starts, sizes) + depth - 1, np.repeat(np.arange(len(sizes)), sizes), depth


class Trie:
    """The distinct pre-tokens of a block as a trie, built depth by depth.

    Words are sorted, so a node is a run of words with a common prefix. `levels` leads each
    node to those that end where one of its last pieces begins; every value computed on
    nodes is computed once per shared prefix. `inverse` leads from occurrences to words.

    Words of over CUT bytes come last and share no nodes but the root: `chain` has their edges by
    depth, and sums over them are logs, since they may leave the range of a number.
    """

    def __init__(self, vocab: Vocabulary, tokens: Pretokens, block: slice):
        starts, ends = tokens.starts[block], tokens.ends[block]
        low = int(starts[0])
        data = tokens.data[low : int(ends[-1])]
        hashes = Hashes(data).of(starts - low, ends - low)
        _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        first, sizes = starts[index] - low, (ends - starts)[index]
        short, long = np.flatnonzero(sizes <= CUT), np.flatnonzero(sizes > CUT)
        width = int(sizes[short].max(initial=1))
        inside = np.arange(width) < sizes[short][:, None]
        padded = np.zeros((len(short), width), dtype=np.uint8)
        padded[inside] = data[_bytes_of(first[short], sizes[short])[0]]
        sort = np.argsort(padded.reshape(-1).view(f"S{width}"), kind="stable")
        order = np.concatenate([short[sort], long])
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.inverse, self.sizes = place[inverse], sizes[order]
        self.vocab, self.words, self.short = vocab, len(order), len(short)
        own = self.sizes[: self.short]
        self._grow(padded[sort][inside[sort]], np.cumsum(own) - own, width)
        self._lengthen(data, first[long], sizes[long])

    def _unknown(self, flat: np.ndarray, hashes: Hashes) -> np.ndarray:
        """Marks the bytes of characters that are no piece."""
        kinds = np.ones(256, dtype=np.int64)
        kinds[0x80:0xC0], kinds[0xC0:0xE0], kinds[0xE0:0xF0], kinds[0xF0:0xF8] = 0, 2, 3, 4
        size, out = kinds[flat], np.zeros(len(flat), dtype=bool)
        for n in (1, 2, 3, 4):
            at = np.flatnonzero(size == n)
            at = at[at + n <= len(flat)]
            lost = at[self.vocab.find(hashes.of(at, at + n)) < 0]
            for i in range(n):
                out[lost + i] = True
        return out

    def _grow(self, flat: np.ndarray, starts: np.ndarray, width: int) -> None:
        hashes = Hashes(flat)
        unknown = self._unknown(flat, hashes)
        path = [np.zeros(self.short, dtype=np.int32)]
        self.terminal = np.zeros(self.words, dtype=np.int64)
        self.levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        nodes, live = 1, np.arange(self.short)
        for depth in range(1, width + 1):
            live = live[self.sizes[live] >= depth]
            at = starts[live]
            prefix = hashes.of(at, at + depth)
            new = np.ones(len(live), dtype=bool)
            new[1:] = prefix[1:] != prefix[:-1]
            node = np.full(self.short, -1, dtype=np.int32)
            node[live] = nodes + np.cumsum(new) - 1
            heads = live[new]
            at = starts[heads] + depth
            level = []
            for n in range(1, min(depth, self.vocab.longest) + 1):
                ids = self.vocab.find(hashes.of(at - n, at))
                if n == 1:
                    # Inside a character a prefix may be shared by known and unknown ones; a known one's last byte has no way on.
                    spelt = np.logical_or.reduceat(unknown[starts[live] + depth - 1], np.flatnonzero(new)) if len(live) else ids < -1
                    ids = np.where(spelt, self.vocab.byte_ids[flat[at - 1]], ids)
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    level.append((nodes + hit, path[depth - n][heads[hit]], ids[hit]))
            self.levels.append(level)
            path.append(node)
            nodes += len(heads)
            done = live[self.sizes[live] == depth]
            self.terminal[done] = node[done]
        self.nodes = self.shared = nodes

    def _lengthen(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """A node per byte of the long words. In `chain`, 0 is the root and i + 1 the node after byte i; edges are in order
        of depth, node and length, `heads` are each node's first ones, `runs` their numbers, and `depths` ranges of edges and nodes."""
        place, _, depth = _bytes_of(starts, sizes)
        flat = data[place]
        hashes = Hashes(flat)
        unknown = self._unknown(flat, hashes)
        parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))]
        for n in range(1, self.vocab.longest + 1 if len(flat) else 1):
            last = np.flatnonzero(depth >= n)
            ids = self.vocab.find(hashes.of(last + 1 - n, last + 1))
            if n == 1:
                ids = np.where(unknown, self.vocab.byte_ids[flat], ids)
            hit = ids >= 0
            parts.append((last[hit], np.full(int(hit.sum()), n), ids[hit]))
        last, n, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((n, last, depth[last]))
        last, n, piece = last[order], n[order], piece[order]
        self.chain = last + 1, np.where(depth[last] == n, 0, last + 1 - n), piece
        self.heads = np.flatnonzero(np.diff(last, prepend=-1))
        self.runs = np.diff(self.heads, append=len(last))
        turns = np.flatnonzero(np.diff(depth[last], prepend=0))
        groups = np.searchsorted(self.heads, turns)
        ranges = [np.append(x, n).tolist() for x, n in ((turns, len(last)), (groups, len(self.heads)))]
        self.depths = [(low, high, g, h) for (low, high), (g, h) in zip(*map(itertools.pairwise, ranges), strict=True)]
        self.chain_ends = np.cumsum(sizes)
        self.terminal = np.concatenate([self.terminal[: self.short], self.nodes - 1 + self.chain_ends])
        self.nodes += len(flat)

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """Sums over all segmentations of prefixes of words up to CUT bytes: `weights` (pieces x models)
        are probabilities; the result is (nodes x models)."""
        total = np.zeros((self.shared, weights.shape[1]))
        total[0] = 1
        for level in self.levels:
            for node, source, piece in level:
                total[node] += total[source] * weights[piece]
        return total

    def chain_sums(self, weights: np.ndarray) -> np.ndarray:
        """Logs of these sums for the root and the nodes of longer words."""
        logs = np.full((self.nodes - self.shared + 1, weights.shape[1]), -np.inf)
        logs[0] = 0
        node, source, piece = self.chain
        with np.errstate(divide="ignore"):
            log_weights = np.log(weights) if self.depths else weights
            for low, high, g, h in self.depths:
                heads = self.heads[g:h]
                at, own = heads - low, logs[source[low:high]] + log_weights[piece[low:high]]
                top = np.maximum(np.maximum.reduceat(own, at), -1e300)
                own -= top.repeat(self.runs[g:h], axis=0)
                logs[node[heads]] = top + np.log(np.add.reduceat(np.exp(own), at))
        return logs

    def log_ends(self, weights: np.ndarray, total: np.ndarray | None = None, logs: np.ndarray | None = None) -> np.ndarray:
        """Logs of the sums over all segmentations of each word (words x models), from what `forward` and `chain_sums` gave."""
        total = self.forward(weights) if total is None else total
        logs = self.chain_sums(weights) if logs is None else logs
        return np.concatenate([np.log(np.maximum(total[self.terminal[: self.short]], 1e-300)), logs[self.chain_ends]])

    def best(self, log_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node the best segmentation's score and number of pieces (of equal scores,
        the fewest)."""
        score, count = np.full(self.nodes, -np.inf), np.zeros(self.nodes, dtype=np.int64)
        score[0] = 0
        for level in self.levels:
            for node, source, piece in level:
                new, n = score[source] + log_weights[piece], count[source] + 1
                gain = new - score[node]
                take = (gain > 1e-9) | ((np.abs(gain) <= 1e-9) & (n < count[node]))
                score[node[take]], count[node[take]] = new[take], n[take]
        # Of longer words, the root and the nodes after each byte.
        far, pieces = np.full(self.nodes - self.shared + 1, -np.inf), np.zeros(self.nodes - self.shared + 1, dtype=np.int64)
        far[0] = 0
        node, source, piece = self.chain
        for low, high, g, h in self.depths:
            heads = self.heads[g:h]
            at, runs = heads - low, self.runs[g:h]
            new, n = far[source[low:high]] + log_weights[piece[low:high]], pieces[source[low:high]] + 1
            near = new >= np.repeat(np.maximum.reduceat(new, at), runs) - 1e-9
            fewest = np.minimum.reduceat(np.where(near, n, np.iinfo(np.int64).max), at)
            chosen = near & (n == np.repeat(fewest, runs))
            far[node[heads]] = np.maximum.reduceat(np.where(chosen, new, -np.inf), at)
            pieces[node[heads]] = fewest
        score[self.shared :], count[self.shared :] = far[1:], pieces[1:]
        return score, count
