"""Token counts by a whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that come out as one token are proved
whole-token words.  The proved table is bounded by the vocabulary.  Workers count pre-tokens found in
it directly and run the merges only for the rest, each once while it stays in the worker's memory of
at most ``MEMORY_WORDS`` words (emptied when full, so its size never follows the input).

One narrow pass without shuffle.  Cases: a null or empty text has 0 tokens; texts are whole whatever
their length; null ids stay; repeated rows are counted each on its own; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.pretokens import splitter

MEMORY_WORDS = 600_000
#: Characters whose pre-tokens are held at once.
BLOCK_CHARS = 1 << 20

_known: dict[str, dict[str, int]] = {}
_proved: dict[str, dict[str, int]] = {}


def _lengths(vocab_path: str, words: set[str]) -> dict[str, int]:
    """Token counts of at least ``words``."""
    if vocab_path not in _proved:
        _proved[vocab_path] = dict.fromkeys(splitter(vocab_path).single_words(), 1)
        _known[vocab_path] = dict(_proved[vocab_path])
    known = _known[vocab_path]
    rest = [w for w in words if w not in known]
    if rest:
        if len(known) + len(rest) > MEMORY_WORDS:
            known = _known[vocab_path] = dict(_proved[vocab_path])
            rest = [w for w in words if w not in known]
        known.update(zip(rest, map(len, splitter(vocab_path).encode_words(rest))))
    return known


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(vocab_path).split
        for batch in batches:
            texts, counts, held, chars = batch.column("text"), [], [], 0

            def flush() -> None:
                n = _lengths(vocab_path, set().union(*held)).__getitem__
                counts.extend(sum(map(n, words)) for words in held)
                held.clear()

            for text in texts:
                text = text.as_py() or ""
                held.append(split(text))
                chars += len(text)
                if chars > BLOCK_CHARS:
                    flush()
                    chars = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_bytes")],
                names=["doc_id", "n_tokens", "n_bytes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
