"""Which texts of a bounded set occur inside which documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most characters of needles in a block.
BLOCK_CHARS = 4_000_000


def contained(docs: DataFrame, needles: DataFrame, id_col: str, text: str, needle_id: str, needle: str) -> DataFrame:
    """(id_col, needle_id) pairs with needle inside text. Needles are shipped in bounded blocks, one automaton and one scan for each."""
    rows = docs.select(id_col, text)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, {needle_id} {dict(needles.dtypes)[needle_id]}"
    out, block, size = docs.sparkSession.createDataFrame([], schema), [], 0

    def search(block: list) -> DataFrame:
        def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, t in block:
                automaton.add_word(t, [*automaton.get(t, []), i])
            automaton.make_automaton()
            for pdf in stream:
                found = [(d, i) for d, t in zip(pdf[id_col], pdf[text], strict=True) if t for i in sorted({i for _, ids in automaton.iter(t) for i in ids})]
                yield pd.DataFrame(found, columns=[id_col, needle_id])

        return rows.mapInPandas(run, schema)

    for i, t in needles.filter(F.length(needle) > 0).select(needle_id, needle).toLocalIterator():
        block.append((i, t))
        size += len(t)
        if size >= BLOCK_CHARS:
            out, block, size = out.unionByName(search(block)), [], 0
    return out.unionByName(search(block)) if block else out
