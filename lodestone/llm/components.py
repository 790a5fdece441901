"""Connected components over a table of links, by label spreading with pointer jumping; nothing is gathered anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored

#: Links that one local pass contracts together.
CHUNK = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star for each local component of every CHUNK links, centred on its smallest id."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def star(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(parts)
        ids, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(pairs.shape)
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[at[:, 0]], label[at[:, 1]])
            new = label.copy()
            np.minimum.at(new, at[:, 0], low)
            np.minimum.at(new, at[:, 1], low)
            np.minimum.at(new, label[at[:, 0]], low)
            np.minimum.at(new, label[at[:, 1]], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        move = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[label[move]]), pa.array(ids[move])], schema=schema)

    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            n += b.num_rows
        if n >= CHUNK:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (i, j) between places of ids."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (i, j, label[i], label[j]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            move = np.flatnonzero(label != np.arange(len(ids)))
            return ids[label[move]], ids[move]
        label = new


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that can be reached. Ids without a link are not listed."""
    links = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "a long, b long"), "links")
    both = links.union(links.select("b", "a")).distinct()
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        # what a label hears from its holders goes to the label itself as well: its tree is hooked under a smaller one
        heard = labels.join(near, labels.id == near.a).select("id", "component", "m")
        told = heard.select("id", "m").union(heard.where("m < component").select(F.col("component"), "m")).groupBy("id").agg(F.min("m").alias("m"))
        step = labels.join(told, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        up = step.select(F.col("id").alias("parent"), F.col("component").alias("top"))
        new = stored(step.join(up, step.component == up.parent, "left").select("id", F.least("component", F.coalesce("top", "component")).alias("component"), "was"), "labels")
        if not new.where("component < was").limit(1).count():
            return new.select("id", "component")
        labels = new.select("id", "component")
