"""Embeddings joined to their labels, their moments, and a two-dimensional map of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semantic_join(embeddings: DataFrame, gold: DataFrame) -> DataFrame:
    """Inner join on `review_id`; the labelled side is cut to the columns it adds.

    No side is broadcast by hint: both grow with the data. Stored in tables bucketed
    on `review_id`, the join needs no shuffle.
    """
    labels = gold.select("review_id", "assunto", "sentimento")
    return embeddings.join(labels, "review_id")


def moments(joined: DataFrame, vector: str = "embedding") -> DataFrame:
    """Moments of all vectors in one pass: per place i the count, the sum and the sums of products with all places.

    Rows: i, n, total, products. Every task adds up its own vectors in matrix products and sends one
    row per place, so what meets in a place grows with the tasks, not with the rows. Missing vectors
    are left out; vectors of different lengths are an error.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, products = 0, None
        for batch in batches:
            listed = batch.column(0).drop_null()
            if not len(listed):
                continue
            lengths = np.diff(listed.offsets.to_numpy())
            width = int(lengths[0]) if products is None else len(products) - 1
            if (lengths != width).any():
                raise ValueError(f"vectors of length {width} and of other lengths")
            ones = np.ones((len(listed), 1))
            rows = np.hstack([ones, listed.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)])
            count += len(listed)
            products = rows.T @ rows if products is None else products + rows.T @ rows
        if products is not None:
            width = len(products) - 1
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(width), pa.int32()), "n": pa.array([count] * width, pa.int64()),
                "total": pa.array(products[0, 1:]),
                "products": pa.array(list(products[1:, 1:]), pa.list_(pa.float64()))})

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.array(p) for p in table["products"].to_pylist()]
        if len({len(p) for p in parts}) > 1:
            raise ValueError("vectors of different lengths")
        return pa.table({
            "i": table["i"].slice(0, 1), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()),
            "total": pa.array([sum(table["total"].to_pylist())]),
            "products": pa.array([np.sum(parts, axis=0)], pa.list_(pa.float64()))})

    schema = "i int, n long, total double, products array<double>"
    return joined.select(vector).mapInArrow(add_up, schema).groupBy("i").applyInArrow(merge, schema)


def principal_axes(joined: DataFrame, k: int = 2, vector: str = "embedding") -> list[list[float]]:
    """The k directions along which the vectors vary most.

    Only the d x d matrix of the moments comes to the driver: its size is the vectors' width, not the
    number of rows. Each axis is turned so that its largest loading is positive, which fixes the
    sign the decomposition leaves open.
    """
    rows = moments(joined, vector).orderBy("i").collect()
    if not rows or rows[0].n < 2:
        raise ValueError("principal axes need at least two vectors")
    n, total = rows[0].n, np.array([r.total for r in rows])
    covariance = (np.array([r.products for r in rows]) - np.outer(total, total) / n) / (n - 1)
    values, vectors = np.linalg.eigh(covariance)
    axes = vectors[:, np.argsort(values)[::-1][:k]]
    return (axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])).T.tolist()


def along(vector: str, axis: list[float]) -> Column:
    """Dot product of a vector column and fixed loadings, in the JVM."""
    loadings = F.array(*map(F.lit, axis))
    products = F.zip_with(vector, loadings, lambda x, w: x.cast("double") * w)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def semantic_map(
    joined: DataFrame, vector: str = "embedding", names: tuple[str, ...] = ("x", "y")
) -> DataFrame:
    """Project every review on the first principal components of all vectors. Points are not centred.

    `joined` is read once to fit the axes and once where the result is read.
    """
    axes = principal_axes(joined, len(names), vector)
    return joined.withColumns({name: along(vector, axis) for name, axis in zip(names, axes)})
