"""Registered queries against DuckDB; all of them with VOCARIUM_ALL=1, else one per family."""

import os

import pytest

import __spark_entry__ as entry
import check
from tests.conftest import FOLDER

FEW = (
    "bm25_search", "knn_search", "rrf_merge", "chunk_utterances", "chunk_diff", "filter_only_search", "inventory_sync",
    "reconcile_index", "folder_path", "chunk_set_hash", "vector_sample", "lease_assignment", "listing_union_dedupe",
    "term_normalise", "normalise_utterances", "words_in_chunk", "distribute_words", "swap_duplicate", "delete_video_cascade",
    "retry_backoff", "publish_generation", "dq_folder_cycles", "dq_task_payload", "stream_task_state", "stream_late_events",
)
NAMES = list(entry.queries()) if os.environ.get("VOCARIUM_ALL") else FEW


@pytest.fixture(scope="module")
def duck():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, duck, name):
    problem, _ = check.compare(spark, duck, FOLDER, name, entry.queries(), entry.oracle_sql())
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
