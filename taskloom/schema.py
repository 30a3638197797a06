"""Schemas and enumerations of tasks and accesses."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

_LONGS = ("handle", "a", "b", "x0", "x1", "y0", "y1")
ACCESSES = StructType(
    [StructField("domain_id", LongType()), StructField("task_id", LongType()), StructField("seq", LongType()), StructField("acc_idx", IntegerType()), StructField("type", StringType())]
    + [StructField(n, LongType()) for n in _LONGS]
    + [StructField("mode", IntegerType()), StructField("concurrency", StringType()), StructField("device", IntegerType()), StructField("bytes", LongType())]
)
EDGES = StructType([StructField("domain_id", LongType()), StructField("pred", LongType()), StructField("succ", LongType()), StructField("kind", StringType())])

# Names and numbers of the enumerations.
MODE = {"R": 1, "W": 2, "RW": 3, "V": 4, "VR": 5, "VW": 6, "D": 8}
CONCURRENCY = {"SEQUENTIAL": 1, "COMMUTATIVE": 2, "CONCURRENT": 4}
ACCESS_TYPE = {"HANDLE": 0, "SEGMENT": 1, "BLAS_MATRIX": 2, "NULL": 3}
SCOPE = {"NONUNIFIED": 0, "UNIFIED": 1}
DRIVER = {"HOST": 0, "CUDA": 1, "ZE": 2, "CL": 3, "HIP": 4, "SYCL": 5}
HOST = 0
