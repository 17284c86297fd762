"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op2_suffix, op4_substring, op8_licenses, op9_urls
from tessera.llm.op1_minhash import op1_minhash_dedup
from tessera.llm.op2_suffix import op2_suffix_array_dedup
from tessera.llm.op3_mixing import op3_source_mixing
from tessera.llm.op4_substring import op4_substring_dedup
from tessera.llm.op5_packing import op5_packing
from tessera.llm.op6_neighbours import op6_nearest_neighbours
from tessera.llm.op7_quality import op7_quality_classifier
from tessera.llm.op8_licenses import op8_license_scan
from tessera.llm.op9_urls import op9_url_filter
from tessera.llm.op10_media import op10_media_columns


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_suffix_array_dedup, op3_source_mixing, op4_substring_dedup, op5_packing, op6_nearest_neighbours, op7_quality_classifier, op8_license_scan, op9_url_filter, op10_media_columns)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": op2_suffix.SQL, "op4_substring_dedup": op4_substring.SQL, "op8_license_scan": op8_licenses.sql(), "op9_url_filter": op9_urls.SQL}
