"""Distinct sampled segmentations by Gumbel top-k without replacement.

Texts are segmented over the lattice of a public SentencePiece vocabulary (see `lattice`;
piece probabilities follow Zipf's law over the model's ranks). The law of a text's
segmentation is the product over its pre-tokens. A perturbed A-star search draws the k
segmentations of largest Gumbel-perturbed log probability, which are k draws without
replacement: the frontier holds sets of segmentations, "as this sample before pre-token
i, another choice there, anything after", with their exact log mass and, given the
parent's, the truncated Gumbel maximum; the best set is opened, its best member is drawn by
forward filtering and backward sampling, and the rest is cut into such sets again.

Random numbers are functions of the row key, so a task that runs again repeats them.
`inclusion` is 1 - exp(-exp(log_probability - kappa)), kappa being the largest perturbed
value left in the frontier (1 if nothing is left). Decoding joins the pieces' bytes. The other choice at a
pre-token comes from the law given all that was taken there, without rejection.

Null and empty texts have the initial mark as their only pre-token, hence few or one
segmentation; a text with fewer than k gives fewer rows. Rows that repeat a key and text
repeat their samples. An empty table gives no rows; other columns are ignored. Memory
follows the block of texts, a megabyte and a half or one text. Runs without spaces keep all their segmentations.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import lattice as L
from weftgraph.sources.ship import ship

_GOLD = 0x9E3779B97F4A7C15
SLICE = 1_500_000


def uniforms(seeds: np.ndarray, *counters) -> np.ndarray:
    """In (0, 1), by counter: the same seeds and counters give the same numbers."""
    x = seeds
    for c in counters:
        x = L.stir(x ^ (np.atleast_1d(c).astype(np.uint64) * np.uint64(_GOLD) + np.uint64(0x2545F4914F6CDD1D)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Sampler:
    """Draws segmentations of the words of a block's trie, backwards from their ends."""

    def __init__(self, trie: L.Trie, log_p: np.ndarray):
        p = np.exp(log_p + 2.0 * trie.vocab.lengths)
        alpha, logs = trie.forward(p[:, None]), trie.chain_sums(p[:, None])
        self.log_p, self.log_z = log_p, trie.log_ends(p[:, None], alpha, logs)[:, 0] - 2.0 * trie.sizes
        alpha, logs = alpha[:, 0], logs[:, 0]
        node, source, piece = far = trie.chain
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.exp(logs[source] + np.log(p[piece]) - logs[node])
        parts = [e for level in trie.levels for e in level]
        if parts:
            node, source, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
            with np.errstate(invalid="ignore", divide="ignore"):
                share = np.concatenate([alpha[source] * p[piece] / alpha[node], share])
            node, source = (np.concatenate([x, np.where(y > 0, y + (trie.shared - 1), 0)]) for x, y in zip((node, source), far[:2], strict=True))
            piece = np.concatenate([piece, far[2]])
        some = np.flatnonzero(share > 0)
        some = some[np.argsort(node[some], kind="stable")]
        node, self.source, self.piece, self.share = node[some], source[some], piece[some], share[some]
        share = self.share
        head = np.ones(len(node), dtype=bool)
        head[1:] = node[1:] != node[:-1]
        row = np.cumsum(head) - 1
        self.first, self.row_of = np.flatnonzero(head), np.full(trie.nodes, -1, dtype=np.int64)
        self.row_of[node[head]] = np.arange(len(self.first))
        self.last = np.append(self.first[1:], len(node)) - 1
        sums = np.cumsum(share)
        key = sums - (sums[self.first] - share[self.first])[row] + row
        # Where an edge's part of its node begins; the first one's takes all that is below.
        self.low = np.append(-np.inf, key[:-1])
        self.low[self.first] = -np.inf
        self.terminal, self.sizes = trie.terminal, trie.sizes

    def draw(self, words: np.ndarray, seeds: np.ndarray, counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For occurrences of words: pieces in order, their number per occurrence, and log
        probabilities given the word."""
        n = len(words)
        at, live, step = self.terminal[words].astype(np.int64), np.arange(n), 0
        counts, score = np.zeros(n, dtype=np.int64), np.zeros(n)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        base = L.stir(seeds ^ np.uint64((counter * _GOLD + 1) % 2**64)) if n else seeds
        while len(live):
            u = ((L.stir(base[live] + np.uint64(step * _GOLD % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            row = self.row_of[at[live]]
            # Edges of a node go from short to long pieces, and long ones mostly have the largest share.
            edge, x = self.last[row], row + u
            on = np.flatnonzero(self.low[edge] > x)
            while len(on):
                edge[on] -= 1
                on = on[self.low[edge[on]] > x[on]]
            piece = self.piece[edge]
            score[live] += self.log_p[piece]
            counts[live] += 1
            at[live] = self.source[edge]
            drawn.append((live, piece))
            live = live[at[live] > 0]
            step += 1
        ends, out = np.cumsum(counts), np.empty(int(counts.sum()), dtype=np.int32)
        for back, (of, piece) in enumerate(drawn):
            out[ends[of] - 1 - back] = piece
        return out, counts, np.minimum(score - self.log_z[words], 0.0)


class Sample:
    """One segmentation of a text: pieces, pieces per pre-token, log probability per pre-token."""

    def __init__(self, pieces: np.ndarray, counts: np.ndarray, scores: np.ndarray, value: float):
        self.pieces, self.counts, self.scores, self.value = pieces, counts, scores, value

    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)


class Region:
    """Segmentations that equal `sample` before a pre-token from `start` on and differ there;
    at `start` itself all choices in `taken` are excluded, `log_taken` being their mass."""

    def __init__(self, sample: Sample, start: int, taken: list[bytes], mass_taken: float, bound: float, u: np.ndarray):
        self.sample, self.start, self.taken, self.mass_taken = sample, start, taken, mass_taken
        before = np.concatenate([[0.0], np.cumsum(sample.scores)])[start:-1]
        own = np.exp(sample.scores[start:])
        own[0] = mass_taken
        with np.errstate(divide="ignore"):
            mass = before + np.log(np.where(own >= 1 - 1e-12, 0.0, 1 - own))
        some = np.isfinite(mass)
        self.best = np.full(len(mass), -np.inf)
        phi = mass[some]
        self.best[some] = phi - np.log(np.exp(np.minimum(phi - bound, 700)) - np.log(u[some]))

    def top(self) -> tuple[float, int]:
        i = int(np.argmax(self.best))
        return float(self.best[i]), self.start + i


def sample_block(vocab: L.Vocabulary, log_p: np.ndarray, tokens: L.Pretokens, keys: np.ndarray, k: int) -> list[list[tuple[Sample, float]]]:
    """Per text, samples in order of their perturbed value, with inclusion scores."""
    n = len(tokens.bounds) - 1
    trie = L.Trie(vocab, tokens, slice(0, len(tokens.starts)))
    sampler = Sampler(trie, log_p)
    words, owner = trie.inverse, tokens.text
    first = np.searchsorted(owner, np.arange(n + 1))
    place = np.arange(len(words)) - first[owner]
    seeds = L.stir(keys[owner] ^ L.stir(place.astype(np.uint64) + np.uint64(77)))
    pieces, counts, scores = sampler.draw(words, seeds, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    top = -np.log(-np.log(uniforms(keys, 1)))
    found: list[list[Sample]] = []
    frontier: list[list[Region]] = []
    spread = uniforms(seeds, 2)
    for d in range(n):
        a, b = first[d], first[d + 1]
        s = Sample(pieces[ends[a] : ends[b]], counts[a:b], scores[a:b], float(top[d]))
        found.append([s])
        frontier.append([Region(s, 0, [s.pieces[: s.counts[0]].tobytes()], float(np.exp(s.scores[0])), s.value, spread[a:b])])
    for turn in range(1, k):
        chosen: list[tuple[int, Region, int, float]] = []
        for d in range(n):
            if len(found[d]) < turn:
                continue
            region = max(frontier[d], key=lambda r: r.top()[0])
            value, i = region.top()
            if value > -np.inf:
                chosen.append((d, region, i, value))
        if not chosen:
            break
        spans = [np.arange(first[d] + i + 1, first[d + 1]) for d, _, i, _ in chosen]
        at = np.concatenate(spans)
        new, new_counts, new_scores = sampler.draw(words[at], seeds[at], turn)
        new_ends = np.concatenate([[0], np.cumsum(new_counts)])
        spread, low = uniforms(seeds, 2 + turn), 0
        for (d, region, i, value), span in zip(chosen, spans, strict=True):
            s, high = region.sample, low + len(span)
            old = s.ends()
            begin = int(old[i - 1]) if i else 0
            here = s.pieces[begin : old[i]].tobytes()
            head = i == region.start
            taken = region.taken if head else [here]
            own, own_score = _other(sampler, words[first[d] + i], seeds[first[d] + i], turn, taken)
            t = Sample(
                np.concatenate([s.pieces[:begin], own, new[new_ends[low] : new_ends[high]]]),
                np.concatenate([s.counts[:i], [len(own)], new_counts[low:high]]),
                np.concatenate([s.scores[:i], [own_score], new_scores[low:high]]),
                value,
            )
            region.best[i - region.start] = -np.inf
            mass = (region.mass_taken if head else float(np.exp(s.scores[i]))) + float(np.exp(own_score))
            frontier[d].append(Region(t, i, [*taken, own.tobytes()], mass, value, spread[first[d] + i : first[d + 1]]))
            found[d].append(t)
            low = high
    out = []
    for d in range(n):
        kappa = max(r.top()[0] for r in frontier[d])
        out.append([(s, 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(s.scores.sum() - kappa, 700.0))))) for s in found[d]])
    return out


def _other(sampler: Sampler, word: int, seed: np.uint64, turn: int, taken: list[bytes]) -> tuple[np.ndarray, float]:
    """A segmentation of one word by the law given that it is none of `taken`.

    Going backwards, an edge's share is lessened by those of the taken ones that go on through it, so one
    draw per piece suffices, however much of the mass is taken. Off their paths shares are as they were.
    """
    node = int(sampler.terminal[word])
    # Of each taken one still agreed with: its pieces not yet compared, and the mass of these.
    live = []
    for raw in taken:
        own, at, mass = np.frombuffer(raw, dtype=np.int32).tolist(), node, []
        for piece in reversed(own):
            row = sampler.row_of[at]
            low = int(sampler.first[row])
            edge = low + sampler.piece[low : int(sampler.last[row]) + 1].tolist().index(piece)
            mass.append(float(sampler.share[edge]))
            at = int(sampler.source[edge])
        left = np.cumprod(mass[::-1])[::-1].tolist()
        live.append((own[::-1], left))
    pieces: list[int] = []
    score, most = 0.0, int(sampler.sizes[word])
    base = L.stir(np.full(most, seed ^ np.uint64(((1000 + turn) * _GOLD + 1) % 2**64), dtype=np.uint64))
    drawn = uniforms(base, np.arange(most)).tolist()
    while node > 0:
        step = len(pieces)
        row = sampler.row_of[node]
        low, high = int(sampler.first[row]), int(sampler.last[row]) + 1
        weights, here = sampler.share[low:high].tolist(), sampler.piece[low:high].tolist()
        for own, left in live:
            weights[here.index(own[step])] -= left[step]
        sums = list(accumulate(max(w, 0.0) for w in weights))
        u = drawn[step] * sums[-1]
        edge = low + min(bisect_right(sums, u), high - low - 1)
        piece = int(sampler.piece[edge])
        live = [(own, left) for own, left in live if own[step] == piece]
        pieces.append(piece)
        score += float(sampler.log_p[piece])
        node = int(sampler.source[edge])
    return np.array(pieces[::-1], dtype=np.int32), min(score - float(sampler.log_z[word]), 0.0)


def decode(vocab: L.Vocabulary, pieces: np.ndarray) -> bytes:
    """The text's UTF-8 bytes."""
    sizes = vocab.lengths[pieces]
    at = np.repeat(vocab.offsets[pieces] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    data = vocab.flat[at]
    return np.where(data == L.MARK, np.uint8(0x20), data).tobytes()[1:]


def _spell_back(vocab: L.Vocabulary, pieces: np.ndarray, counts: np.ndarray, tokens: L.Pretokens, of: np.ndarray) -> np.ndarray:
    """Whether each sample's pieces (`counts` of them, of text `of`) spell its text, for all samples of a block at once."""
    sizes = vocab.lengths[pieces]
    spelt = np.add.reduceat(sizes, np.cumsum(counts) - counts)
    wanted = np.diff(tokens.bounds)[of]
    good = spelt == wanted
    at = np.repeat(vocab.offsets[pieces] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    begins = np.cumsum(spelt) - spelt
    # Of a sample of another length, only as much as there is can be compared; it is wrong anyway.
    place = np.repeat(tokens.bounds[of] - begins, spelt) + np.arange(int(spelt.sum()))
    same = vocab.flat[at] == tokens.data[np.minimum(place, len(tokens.data) - 1)]
    return good & np.logical_and.reduceat(same, begins)


def sample_segmentations(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, seed: int = 5, model: str | None = None) -> DataFrame:
    """Per row and rank (1 to k at most): key, rank, n_pieces, log_probability, perturbed,
    inclusion, pieces_crc32, exact (decoding gives the text back) and pieces."""
    ship(df.sparkSession)
    path = model or L.default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = L.vocabulary(path)
        log_p = vocab.zipf_log_probabilities()
        for batch in L.slices(batches, "text", SLICE):
            tokens = L.Pretokens(*L.text_buffers(batch.column("text")), vocab)
            keys = batch.column("seed").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found = [(d, rank, t, inclusion) for d, samples in enumerate(sample_block(vocab, log_p, tokens, keys, k)) for rank, (t, inclusion) in enumerate(samples, 1)]
            ids = [np.ascontiguousarray(t.pieces, dtype="<i4") for _, _, t, _ in found]
            every = np.concatenate(ids)
            exact = _spell_back(vocab, every, np.array([len(x) for x in ids]), tokens, np.array([d for d, *_ in found]))
            rows = [(d, rank, len(x), float(t.scores.sum()), t.value, inclusion, zlib.crc32(x)) for (d, rank, t, inclusion), x in zip(found, ids, strict=True)]
            at, *columns = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(every, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array(exact), listed], names)

    names = ["key", "rank", "n_pieces", "log_probability", "perturbed", "inclusion", "pieces_crc32", "exact", "pieces"]
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, rank int, n_pieces bigint, log_probability double, perturbed double, inclusion double, pieces_crc32 bigint, exact boolean, pieces array<int>"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(seed)).alias("seed")).mapInArrow(run, schema).withColumnRenamed("key", key)
