"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Words are runs of letters and digits (and all non-ASCII characters), lower-cased; shingles
are five words (a shorter text is one shingle of all its words). All shingles of a text
weigh the same, however often they occur, since links are verified on sets. ProbMinHash:
every shingle is a Poisson process of rate 1 whose seed is its hash; arrivals fall on one of
100 registers, each keeping its first; a text's shingles stop arriving once they are later
than all registers. Two registers agree with the Jaccard similarity of the sets. 20 bands of
5 registers give candidates (a pair of similarity 0.8 is missed with probability 0.0004).

Texts with the same words collapse to the one of smallest key first, so copies are never
paired. In each bucket, every member is paired with the bucket's smallest, and with all
members of its block; a bucket of up to 8 is one block, a larger one is cut into blocks of
about 6 by a hash that differs from band to band. Pairs whose ends are linked already are
skipped. A pair is a link when the exact Jaccard similarity of the shingle sets (as 32-bit
hashes) is 0.8 or more; classes are the connected components of links.

Where a large bucket still holds more than one component after that, its members go through
an exact join: shingles are ordered by rarity (frequency over these texts in 2^22 hash
buckets, graded in powers of two), a text's first n - ceil(0.8 n) + 1 shingles are its
prefix, and texts of different components that share a prefix shingle are verified if they
pass the length and position filters and a parity filter: of 256 bits, each holds whether an
odd number of shingles falls on it, and bits that differ can't outnumber the shingles that
one side lacks. So no link inside a bucket is lost, and pairs within a component are never
built.

Null or empty texts, texts without words, and rows with a null key are in classes of their
own. Rows that repeat a key are judged by their texts; those with the same text share a class, and
class_id is the smallest key of the class. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import lattice as L
from weftgraph.llm.components import components
from weftgraph.sources.ship import ship
from weftgraph.sources.tables import materialise, release

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 20, 5
SMALL_BUCKET, BLOCK_SIZE = 8, 6
PARITIES = ("p0", "p1", "p2", "p3")
#: Hash buckets in which shingle frequencies are counted for the rarity order.
GRADED = 1 << 22
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    return np.array([pow(base, i + 1, 2**64) for i in range(n)], dtype=np.uint64)


class Shingles:
    """Distinct shingles of the texts of a column: text and hash, sorted by text."""

    def __init__(self, column: pa.Array):
        data, offsets = L.text_buffers(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
        n = self.texts = len(offsets) - 1
        inside = _WORD[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begin[heads] = inside[heads]
        starts = np.flatnonzero(begin)
        stop = np.append(np.flatnonzero(~inside), len(data))
        ends = stop[np.searchsorted(stop, starts)]
        text = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.minimum(ends, offsets[text + 1])
        words = L.stir(L.Hashes(data).of(starts, ends)) if len(starts) else np.zeros(0, np.uint64)
        self.words = np.bincount(text, minlength=n)
        first = np.concatenate([[0], np.cumsum(self.words)])
        #: Two hashes of each text's whole word sequence.
        place = np.arange(len(words)) - first[text]
        self.whole = []
        for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * L._powers(base, int(self.words.max(initial=0)) + 1)[place])])
            self.whole.append(L.stir(sums[first[1:]] - sums[first[:-1]] + self.words.astype(np.uint64)))
        factors = _powers(WORDS, 0xDA942042E4DD58B5)
        room = np.minimum(self.words[text] - place, WORDS)
        keep = (room == WORDS) | (place == 0)
        at, room = np.flatnonzero(keep), room[keep]
        hashes = np.zeros(len(at), dtype=np.uint64)
        for j in range(WORDS):
            some = room > j
            hashes[some] += words[at[some] + j] * factors[j]
        hashes, text = L.stir(hashes), text[at]
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        self.text, self.hash = text[new], hashes[new]
        self.sizes = np.bincount(self.text, minlength=n)


def prob_min_hash(s: Shingles, registers: int) -> np.ndarray:
    """(texts x registers): the shingle that arrives first in each register."""
    first = np.full(s.texts * registers, np.inf)
    found = np.zeros(s.texts * registers, dtype=np.uint64)
    time, live, turn = np.zeros(len(s.hash)), np.arange(len(s.hash)), 0
    while len(live):
        turn += 1
        drawn = L.stir(s.hash[live] + np.uint64(turn * int(_STEP) % 2**64))
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        now = time[live] - np.log(uniform)
        time[live] = now
        at = s.text[live] * registers + (L.stir(drawn ^ _STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, now)
        won = first[at] == now
        found[at[won]] = s.hash[live[won]]
        owner = s.text[live]
        some = owner[np.concatenate([[True], owner[1:] != owner[:-1]])]
        latest = np.zeros(s.texts)
        latest[some] = first.reshape(-1, registers)[some].max(axis=1)
        live = live[now < latest[owner]]
    return found.reshape(-1, registers)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, two hashes of the word sequence, number of shingles and band hashes (none without words)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _powers(ROWS, 0xDA942042E4DD58B5)
        for batch in L.slices(batches, "text"):
            s = Shingles(batch.column("text"))
            bands = (prob_min_hash(s, BANDS * ROWS).reshape(-1, BANDS, ROWS) * factors).sum(axis=2, dtype=np.uint64)
            bands = L.stir(bands + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)
            some = s.words > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(s.whole[0].view(np.int64)), pa.array(s.whole[1].view(np.int64)), pa.array(s.sizes), _lists(bands[some].reshape(-1), some * BANDS, pa.int64())],
                ["id", "k1", "k2", "n", "bands"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, k1 bigint, k2 bigint, n bigint, bands array<bigint>")


def shingle_sets(df: DataFrame) -> DataFrame:
    """id and the distinct shingles' 32-bit hashes, of columns id and text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in L.slices(batches, "text"):
            s = Shingles(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists((s.hash >> np.uint64(32)).astype(np.uint32).view(np.int32), s.sizes, pa.int32())], ["id", "shingles"])

    return df.select("id", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have this Jaccard similarity or more.

    Pairs and sets grow with the corpus, so neither is ever broadcast.
    """
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def prefixes(sets: DataFrame, grades: np.ndarray, threshold: float) -> DataFrame:
    """Prefix tokens of (id, label, shingles): token, id, label, n, pos and four words of parities. `grades` has one entry per bucket."""
    shared = sets.sparkSession.sparkContext.broadcast(grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((tokens, shared.value[tokens & (GRADED - 1)], owner))
            place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = place < (sizes - np.ceil(sizes * threshold - 1e-9) + 1)[owner]
            bits = np.bincount(owner * 256 + ((tokens.astype(np.int64) * 40503) >> 8 & 255), minlength=len(sizes) * 256) & 1
            words = np.packbits(bits.astype(np.uint8).reshape(-1, 64), axis=1).view(np.int64).reshape(-1, 4)
            at = owner[keep]
            rows = pa.array(at)
            columns = [pa.array(tokens[order][keep]), batch.column("id").take(rows), batch.column("label").take(rows), pa.array(sizes[at]), pa.array(place[keep]), *(pa.array(words[at, i]) for i in range(4))]
            yield pa.RecordBatch.from_arrays(columns, ["token", "id", "label", "n", "pos", *PARITIES])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "label", "shingles").mapInArrow(run, f"token int, id {kind}, label {kind}, n bigint, pos bigint, {', '.join(f'{p} bigint' for p in PARITIES)}")


def unsettled_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame | None:
    """Pairs that may be linked among members of large buckets with several components, by
    the prefix filter; None if there are no such buckets. At each token the members of its largest component meet
    those of the others only, so a family of near copies never meets itself."""
    named = members.where("large").join(labels.withColumnRenamed("node", "id"), "id", "left").select("band", "id", F.coalesce("label", "id").alias("label"))
    named = materialise(named, "named")
    # Written before the join, so that its exchanges are the join's own and a hot band can be split.
    open_bands = materialise(named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band"), "open-bands")
    texts = materialise(named.join(open_bands.hint("merge"), "band", "left_semi").select("id", "label").distinct(), "unsettled")
    release(named, open_bands)
    if not texts.limit(1).count():
        return None
    own = materialise(texts.join(sets.hint("merge"), "id"), "unsettled-sets")
    found = own.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(GRADED - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(GRADED)
    counts[found.column("b").to_numpy()] = found.column("n").to_numpy()
    grades = np.minimum(np.floor(np.log2(np.maximum(counts, 1))), 60).astype(np.int8)
    tokens = materialise(prefixes(own, grades, threshold), "prefixes")
    release(texts, own)
    groups = tokens.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = groups.groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("token", "main")
    largest = materialise(largest, "main-labels")
    mixed = materialise(tokens.join(largest.hint("merge"), "token"), "mixed-prefixes")
    release(tokens, largest)
    a, b = mixed.where("label <> main").alias("a"), mixed.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - 1e-9)
    apart = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITIES), F.lit(0))
    fits = (na >= threshold * nb) & (nb >= threshold * na) & (F.least(na - F.col("a.pos"), nb - F.col("b.pos")) >= needed) & (apart <= na + nb - 2 * needed)
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
    met = a.join(b.hint("merge"), (F.col("a.token") == F.col("b.token")) & (F.col("a.label") != F.col("b.label")) & once & fits)
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def classes(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """id, class_id, kept and n, for a table in which a key stands for one text."""
    made = materialise(signatures(df, key, text), "signatures")
    worded = made.where("n > 0 AND id IS NOT NULL")
    texts = materialise(worded.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "texts")
    reps = worded.join(texts.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", F.explode("bands").alias("band"))
    reps = materialise(reps.dropDuplicates(["id", "band"]), "bands")
    buckets = materialise(reps.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1"), "buckets")
    members = reps.join(buckets, "band").select("band", "id", "n", "least", F.when(F.col("size") <= SMALL_BUCKET, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("size") / BLOCK_SIZE))).alias("block"), (F.col("size") > SMALL_BUCKET).alias("large"))
    members = materialise(members, "members")
    release(reps, buckets)
    candidates = members.select("id").distinct()
    chosen = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(candidates.hint("merge"), "id", "left_semi")
    sets = materialise(shingle_sets(chosen).dropDuplicates(["id"]), "sets")
    led = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    known = components(verified(led, sets, threshold))
    x, y = members.alias("x"), members.alias("y")
    near = (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id"))
    alike = (F.col("x.n") >= threshold * F.col("y.n")) & (F.col("y.n") >= threshold * F.col("x.n"))
    met = x.join(y, near & alike).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    la = known.select(F.col("node").alias("a"), F.col("label").alias("ca"))
    lb = known.select(F.col("node").alias("b"), F.col("label").alias("cb"))
    apart = met.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    whole = components(verified(apart, sets, threshold), known)
    rest = unsettled_pairs(members, whole, sets, threshold)
    if rest is not None:
        whole = components(verified(rest, sets, threshold), whole)
    release(members, sets)
    of_rep = texts.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("class_id"))
    of_rep = materialise(of_rep, "classes")
    found = worded.select("id", "n", "k1", "k2").join(of_rep, ["k1", "k2"]).select("id", "n", "class_id")
    found = found.union(made.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("class_id")))
    return found.select("id", "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "n")


def repeats(df: DataFrame, key: str) -> bool:
    return bool(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count())


def by_row(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """`classes` of a table in which a key may stand for several texts: id has the key and the text's hash."""
    row = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("raw")))
    return classes(df.select(row.alias("row"), F.col(text).alias("text")), "row", "text", threshold)


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id (the smallest key of the class), kept (it is that one) and n_shingles."""
    if repeats(df, key):
        found = by_row(df, key, text, threshold)
        return found.select(F.col("id.key").alias(key), F.col("class_id.key").alias("class_id"), "kept", F.col("n").alias("n_shingles"))
    return classes(df, key, text, threshold).select(F.col("id").alias(key), "class_id", "kept", F.col("n").alias("n_shingles"))


def without_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df` that are the first of their class. Where keys repeat, a row is known by its key and its text's
    hash, so that another text of the same key stays."""
    if not repeats(df, key):
        gone = materialise(classes(df, key, text, threshold).where("NOT kept").select(F.col("id").alias("_gone")), "near-copies")
        return df.join(gone.hint("merge"), df[key] == gone["_gone"], "left_anti")
    gone = materialise(by_row(df, key, text, threshold).where("NOT kept").select(F.col("id.key").alias("_gone"), F.col("id.raw").alias("_raw")).distinct(), "near-copies")
    return df.join(gone.hint("merge"), (df[key] == gone["_gone"]) & (F.xxhash64(df[text]) == gone["_raw"]), "left_anti")
