"""hitweave: search-results analytics on Spark.

Plain ``DataFrame -> DataFrame`` functions; see README.md for the operator map.
"""

from hitweave.operators.feedback import (constraint_audit, feedback_rejects, feedback_rollup,  # noqa: F401
                                         feedback_upsert, results_replace)
from hitweave.operators.filters import (blocklist_filter, clean_queries, content_filter,  # noqa: F401
                                        date_distribution, page_dates, page_stats, time_window)
from hitweave.operators.merge import format_results, merge_dedup, merge_rank, result_counts, stored_order  # noqa: F401
from hitweave.operators.ordinal import ordinal  # noqa: F401
from hitweave.operators.snapshots import (snapshot_invalidate, snapshot_purge, snapshot_read,  # noqa: F401
                                          snapshot_reuse, snapshot_write)
from hitweave.operators.tfidf import Index, feature_importance, feature_importance_map, tfidf_rank  # noqa: F401
from hitweave.plans.answer import answer_requests  # noqa: F401
from hitweave.plans.search import search_hits  # noqa: F401
from hitweave.session import build_session, checkpoint_root, materialize, prepare  # noqa: F401
from hitweave.sources.landed import (attach_pages, read_blocklist, read_responses, result_page,  # noqa: F401
                                     scan_items, valid_items)
from hitweave.streaming.feedback_stream import start_feedback_stream, results_from_stream  # noqa: F401

__version__ = "0.1.0"
