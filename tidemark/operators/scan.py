"""Ordered scans: per-key sequential logic that no aggregate can express, in bounded memory.

Rows are dealt by key and sorted within partitions; a Python pass then sees them in order and carries the
current key's state from one Arrow batch to the next, so a key of any length costs one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (state or None, rows of one key in order) -> (state, result rows as a list of tuples)
Step = Callable[[Any, pd.DataFrame], tuple[Any, list[tuple]]]


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str, finish: Callable[[tuple, Any], list[tuple]] | None = None) -> DataFrame:
    """Applies ``step`` to each key's rows in order; ``finish`` gives rows at the end of a key."""
    keys = list(keys)
    names = [part.strip().split()[0].strip("`") for part in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for part in parts:
            if not len(part):
                continue
            out: list[tuple] = []
            mark = part[keys].astype(object).where(part[keys].notna(), None)
            changed = (mark != mark.shift()).any(axis=1) & ~(mark.isna() & mark.shift().isna()).all(axis=1)
            changed.iloc[0] = True
            for _, rows in part.groupby(changed.cumsum().to_numpy(), sort=False):
                key = tuple(mark.loc[rows.index[0]])
                if key != current:
                    if current is not None and finish:
                        out += finish(current, state)
                    current, state = key, None
                state, made = step(state, rows)
                out += made
            yield pd.DataFrame(out, columns=names)
        if current is not None and finish:
            yield pd.DataFrame(finish(current, state), columns=names)

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)
