"""Matrix queries over the embeddings as 8 x 8 matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.session import table

QUERIES, ORACLE = {}, {}
M8 = "with m as (select vec_id id, list_transform(range(8), lambda i: (embedding::double[])[i * 8 + 1 : i * 8 + 8]) m from embeddings)"
FLAT = " select id, r, generate_subscripts(v, 1)::int - 1 c, round(unnest(v), 5) v from (select id, generate_subscripts(o, 1)::int - 1 r, unnest(o) v from x)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def _m(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), K.reshape(F.col("embedding").cast("array<double>"), 8).alias("m"))


def _cells(df, col):
    r = df.select("id", F.posexplode(col).alias("r", "v"))
    return r.select("id", "r", F.posexplode("v").alias("c", "v")).withColumn("v", F.round("v", 5))


@query(M8 + ", x as (select id, list_transform(m[3:6], lambda r: r[2:4]) o from m)" + FLAT)
def matrix_crop(s, d):
    return _cells(_m(s, d), K.crop(F.col("m"), 1, 2, 3, 4))


@query(M8 + ", x as (select id, list_transform(m, lambda r: list_transform(r, lambda v: case when v >= 0.1 then 255.0::double else 0.0::double end)) o from m)" + FLAT)
def matrix_threshold(s, d):
    return _cells(_m(s, d), K.threshold(F.col("m"), 0.1))


@query(M8 + ", x as (select id, list_transform(range(12), lambda i: list_transform(range(5), lambda j: m[(i * 8 // 12) + 1][(j * 8 // 5) + 1])) o from m)" + FLAT)
def matrix_resize_nn(s, d):
    return _cells(_m(s, d), K.resize_nearest(F.col("m"), 5, 12))


@query(M8 + ", x as (select id, list_transform(range(10), lambda i: list_transform(range(12), lambda j: m[least(greatest(i - 1, 0), 7) + 1][least(greatest(j - 2, 0), 7) + 1])) o from m)" + FLAT)
def pad_edge(s, d):
    return _cells(_m(s, d), K.pad_edge(F.col("m"), 1, 2))


KERNEL = np.array([[1.0, 2.0, 0.5], [0.0, -1.0, 3.0], [0.25, 1.5, -2.0]])
_k = [f"{KERNEL[a, b]}::double * m[i + {a + 1}][j + {b + 1}]" for a in range(3) for b in range(3)]


@query(M8 + f", x as (select id, list_transform(range(6), lambda i: list_transform(range(6), lambda j: {' + '.join(_k)})) o from m)" + FLAT)
def conv_valid(s, d):
    return _cells(_m(s, d), K.convolve(F.col("m"), KERNEL))


_f = [f"case when i >= {a} and j >= {b} then {KERNEL[a, b]}::double * m[i - {a} + 1][j - {b} + 1] else 0 end" for a in range(3) for b in range(3)]


@query(M8 + f", x as (select id, list_transform(range(8), lambda i: list_transform(range(8), lambda j: {' + '.join(_f)})) o from m)" + FLAT)
def conv_fft(s, d):
    return _cells(_m(s, d), K.convolve(F.col("m"), KERNEL, "fft"))


@query()
def matrix_lanczos(s, d):
    def up(x: np.ndarray) -> np.ndarray:
        """A stack of grey images resampled as the channels of one."""
        grey = (np.clip(x, -1, 1) * 127 + 128).astype(np.uint8)
        return K.resize_lanczos(grey.transpose(1, 2, 0), 16, 16).astype(float).transpose(2, 0, 1)

    return _cells(_m(s, d), K.on_matrices(F.col("m"), up))
