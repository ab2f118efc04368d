"""Order-dependent steps over many small groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def per_group(df: DataFrame, keys: list[str], each: Callable[[pd.DataFrame], pd.DataFrame], schema: str, alone: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """``each`` applied to every group; ``alone``, if given, to all rows at once that are single in their group.

    Groups are streamed in sorted batches: a task holds a batch and the group that spans its end, and a group costs no
    round trip of its own. Keys have no nulls.
    """

    def whole(part: pd.DataFrame) -> list[pd.DataFrame]:
        number = (part[keys] != part[keys].shift()).any(axis=1).cumsum()
        size = number.map(number.value_counts())
        out = []
        if alone is not None:
            single = size == 1
            if single.any():
                out.append(alone(part[single]))
            part, number = part[~single], number[~single]
        out += [each(g) for _, g in part.groupby(number, sort=False)]
        return out

    def run(batches):
        held: list[pd.DataFrame] = []  # batches that end in the group that goes on
        for batch in batches:
            if not len(batch):
                continue
            last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1)
            if last.all() and held and (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
                held.append(batch)
                continue
            done = pd.concat([*held, batch[~last]], ignore_index=True) if held else batch[~last]
            if last.all() and held:
                done = pd.concat(held, ignore_index=True)
            held = [batch[last]] if last.any() else []
            if len(done) and (out := whole(done)):
                yield pd.concat(out, ignore_index=True)
        if held and (out := whole(pd.concat(held, ignore_index=True))):
            yield pd.concat(out, ignore_index=True)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
