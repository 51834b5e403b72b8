"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

Each block of texts puts its distinct pre-tokens in a trie (see `lattice`); the best
segmentation's score and length are computed once per node, so shared prefixes are scored
once, and terminals hold the counts that all occurrences look up. Nothing is shuffled, and
memory is bounded by the block. Piece scores follow Zipf's law over the model's ranks.

Null and empty texts have one pre-token, the initial mark, like every text's start; the
result keeps one row per input row, repeated or not. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import lattice as L
from weftgraph.sources.ship import ship


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """key, n_bytes, n_pretokens, n_tokens and the segmentation's log probability."""
    ship(df.sparkSession)
    path = model or L.default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = L.vocabulary(path)
        scores = vocab.zipf_log_probabilities()
        for batch in L.slices(batches, "text"):
            tokens = L.Pretokens(*L.text_buffers(batch.column("text")), vocab)
            n = batch.num_rows
            counts, scored = np.zeros(n), np.zeros(n)
            for block in tokens.blocks():
                trie = L.Trie(vocab, tokens, block)
                score, count = trie.best(scores)
                owner = tokens.text[block]
                counts += np.bincount(owner, count[trie.terminal][trie.inverse], n)
                scored += np.bincount(owner, score[trie.terminal][trie.inverse], n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(tokens.bounds) - 1), pa.array(np.bincount(tokens.text, minlength=n)), pa.array(counts.astype(np.int64)), pa.array(np.round(scored, 6))],
                ["key", "n_bytes", "n_pretokens", "n_tokens", "log_probability"],
            )

    kind = df.schema[key].dataType.simpleString()
    made = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes bigint, n_pretokens bigint, n_tokens bigint, log_probability double")
    return made.withColumnRenamed("key", key)
