"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op7_positional
from .fingerprints import op9_canonical
from .htmltext import op6_hostpaths
from .jaccard import op8_pigeonhole
from .langid import op1_kneserney
from .packing import op4_largeitem
from .pii import op3_boosting
from .quality import op5_bradleyterry
from .sharding import op10_ring
from .urlfilter import OP2_SQL, op2_rangejoin

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_kneserney": op1_kneserney,
        "op2_rangejoin": op2_rangejoin,
        "op3_boosting": op3_boosting,
        "op4_largeitem": op4_largeitem,
        "op5_bradleyterry": op5_bradleyterry,
        "op6_hostpaths": op6_hostpaths,
        "op7_positional": op7_positional,
        "op8_pigeonhole": op8_pigeonhole,
        "op9_canonical": op9_canonical,
        "op10_ring": op10_ring,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_rangejoin": OP2_SQL}
