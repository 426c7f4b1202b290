"""Pairs of binary codes at Hamming distance 1, and what finding them costs, on Spark."""

from .operators.formatting import format_keys, format_pairs
from .operators.groups import (emits_histogram, group_sizes, groups, key_volume, partition_sizes,
                               size_histogram)
from .operators.keys import keyed
from .operators.pairs import pairs
from .operators.records import code_counts, record_pair_counts, record_pairs
from .plans.cost import COST_SCHEMA, cost_profile, cost_profiles
from .plans.strategy import STRATEGIES, Strategy, strategy
from .plans.timing import TIMING_SCHEMA, timing_profile, timing_summary
from .session import configure, shared_folder, shuffle_partitions
from .sources.buckets import bucket_of, stored_pairs, write_codes
from .sources.reports import append_report, read_report
from .sources.text import read_bitstrings, scan_bitstrings, write_bitstrings
from .sources.universe import bit_universe, payload_length, with_payload

__all__ = [
    "COST_SCHEMA", "STRATEGIES", "Strategy", "TIMING_SCHEMA", "append_report", "bit_universe",
    "bucket_of", "code_counts", "configure", "cost_profile", "cost_profiles", "emits_histogram",
    "format_keys", "format_pairs", "group_sizes", "groups", "key_volume", "keyed", "pairs",
    "partition_sizes", "payload_length", "read_bitstrings", "read_report", "record_pair_counts",
    "record_pairs", "scan_bitstrings", "shared_folder", "shuffle_partitions", "size_histogram",
    "stored_pairs", "strategy", "timing_profile", "timing_summary", "with_payload",
    "write_bitstrings", "write_codes",
]
