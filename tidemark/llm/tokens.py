"""Operator 7: token counts of whole texts by rank-synchronous array merging (see ``bpe``).

Texts are cut where no piece of the model can reach across: before a run of spaces and at line ends.
Distinct pre-tokens of a batch are merged together; a bounded memo keeps the counts of those seen before.

Null text counts as empty (0 bytes, 0 tokens).  Repeated rows and repeated ids give one row each.  Other
columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe import piece_model
from tidemark.llm.common import memo

_PRETOKEN = re.compile("▁*[^▁\n]+|▁+|\n")
#: Entries of the memo of a worker; it is emptied when full, which changes no result.
MEMO = 400_000
_memo: dict[str, dict[str, int]] = memo()


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, as the library gives them without begin, end or added special tokens."""
    model, seen = piece_model(path), _memo.setdefault(path, {})
    parts = [_PRETOKEN.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    new = list(set().union(*parts).difference(seen))
    if len(seen) + len(new) > MEMO:
        seen.clear()
        new = list(set().union(*parts))
    seen.update(zip(new, model.counts(new)))
    get = seen.__getitem__
    return [sum(map(get, p)) for p in parts]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = count_tokens(texts, path)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
