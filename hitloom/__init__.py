"""Search-result analytics on Spark DataFrames."""

from hitloom.functions.dates import parse_result_date, strip_date_prefix
from hitloom.functions.html import (
    body_text_length,
    main_text,
    render_blocks,
    text_blocks,
    page_metadata,
    page_published,
    page_title,
    sanitize_html,
)
from hitloom.functions.keys import cache_key, page_key, result_key
from hitloom.functions.lookups import map_locale, time_range_code
from hitloom.functions.text import (
    decode_entities,
    ellipsize,
    longest_of,
    merge_shadow_text,
    quote_bangs,
    truncate_text,
)
from hitloom.functions.urls import absolute_url, normalize_url, query_escape, url_host
from hitloom.operators.attach import attach_pages, pick_snapshot
from hitloom.operators.cache import (
    cache_stats,
    cached_and_fresh,
    delete_entries,
    live_entries,
    lookup_results,
    page_entries,
    one_row_entries,
    purge_all,
    purge_expired,
    result_entries,
    mark_cached,
    split_cached,
    storable_pages,
    upsert_entries,
)
from hitloom.operators.extract import extract_hits, page_status, search_warnings, warnings
from hitloom.operators.merge import (
    merge_hits,
    pages_for_limit,
    position_lists,
    rank_results,
    union_hits,
    within_page_limit,
    within_query_limits,
)
from hitloom.operators.records import result_cards, results_json, to_records
from hitloom.operators.requests import plan_requests, select_engines
from hitloom.operators.rules import DEFAULT_RULES, Rule
from hitloom.operators.sanitize import sanitize, strip_html
from hitloom.operators.status import classify_status, health_summary
from hitloom.plans.run import (
    attach_text,
    answer_queries,
    run_search,
    search_cached,
    search_hits,
    search_pages,
)
from hitloom.session import tune
from hitloom.sources.cache_log import append_entries, purge_log, read_log
from hitloom.sources.ndjson import read_records, write_records
from hitloom.sources.tables import (
    clear_cache,
    commit_version,
    read_cache,
    read_result_pages,
    read_snapshots,
    save_result_pages,
    save_snapshots,
)
from hitloom.streaming.late import finished, late_pages, stream_late_pages, write_heartbeats
from hitloom.streaming.stages import (
    stream_attach_pages,
    stream_cache_upkeep,
    stream_sanitize,
)
