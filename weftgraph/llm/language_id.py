"""Language identification by unigrams marginalised over all segmentations.

Per language, piece probabilities over the fixed public vocabulary are estimated from a
bounded number of labelled texts (`sample` per language, chosen by a hash of the key) with
add-`alpha` smoothing. A text's likelihood in a language is the product over its
pre-tokens of the sum over all segmentations, by the forward algorithm on a trie of the
block's distinct pre-tokens. The score is the posterior of the winner under equal priors.

Texts that are null or have no letter get "und" and score 0. Ties go to the language
first in alphabetical order. Without labels every text gets "und". A row without a key is
not held out. One row per input row, repeated or not; an empty table gives no rows; input
columns named like output columns are replaced. Very long texts are scored whole, a block
of pre-tokens at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftgraph.llm import lattice as L
from weftgraph.sources.ship import ship

#: Scaling per byte that keeps products of probabilities in range.
SCALE = 2.0


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class LanguageModel:
    """Languages in order and log probabilities (pieces x languages)."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000, alpha: float = 0.1, seed: int = 11, model: str | None = None) -> LanguageModel:
    """Learns from rows of `df` with a language and a text. What reaches the driver is bounded by
    vocabulary x languages."""
    ship(df.sparkSession)
    path = model or L.default_model()
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = found.setdefault(name, np.zeros(sp.get_piece_size(), dtype=np.int64))
                for line in body.split("\n"):
                    np.add.at(own, sp.encode(line), 1)
        for name, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "piece", "n"])

    pieces = rows.where(chosen).select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, piece int, n bigint")
    vocab, names = L.vocabulary(path), sorted(sizes)
    seen = np.zeros((vocab.size, len(names)))
    for r in pieces.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
        seen[r["piece"], names.index(r["lang"])] += r["n"]
    log_p = np.log((seen + alpha) / (seen.sum(axis=0) + alpha * vocab.size)) if names else seen
    return LanguageModel(names, log_p)


def predict(df: DataFrame, fitted: LanguageModel, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """All columns of `df` with lang_pred and score; texts stay where they are read."""
    ship(df.sparkSession)
    path = model or L.default_model()
    df = df.drop("lang_pred", "score")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((fitted.languages, fitted.log_p))
    kept = df.columns
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = shared.value
        vocab = L.vocabulary(path)
        weights = np.exp(log_p + SCALE * vocab.lengths[:, None])
        for batch in L.slices(batches, names_in[place]):
            n = batch.num_rows
            total = np.zeros((n, max(1, len(names))))
            if names:
                tokens = L.Pretokens(*L.text_buffers(batch.column(place)), vocab)
                for block in tokens.blocks():
                    trie = L.Trie(vocab, tokens, block)
                    words = trie.log_ends(weights) - SCALE * trie.sizes[:, None]
                    words = words[trie.inverse]
                    for k in range(len(names)):
                        total[:, k] += np.bincount(tokens.text[block], words[:, k], n)
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            known = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool) & bool(names)
            said = np.where(known, np.array([*names, "und"], dtype=object)[np.where(known, best, -1)], "und")
            columns = [*batch.columns[:-1], pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # Inside, columns go by place, so that none of the input's names can clash.
    names_in = [f"c{i}" for i in range(len(kept))]
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names_in, strict=True)), letters.alias("letters")).mapInArrow(run, schema)
