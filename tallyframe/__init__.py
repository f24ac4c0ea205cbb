"""Ledger analytics on Spark DataFrames.

Public entry points (all ``DataFrame -> DataFrame`` unless noted):

* reports: ``monthly_matrix``, ``annual_matrix``, ``summary``, ``category_stats``, ``category_share``,
  ``pending_merchants``, ``freshness``
* listings: ``ledger_page``, ``deposit_list``
* matching: ``refund_pairs``, ``apply_pairing``, ``merge_candidates``, ``reimbursement_match``
* extraction: ``digest_extract``, ``alert_normalise``, ``alert_route``, ``mail_route``
* commands: ``apply_edits``, ``split_apply``, ``merge_apply``, ``apply_command_table``
* advice: ``advice_pick``, ``classify_apply``, ``suggestion_upsert``; ``run_classifier`` for a caller's model
* notify: ``notify_queue``, ``notify_digest``
* streaming: ``start_ingest``, ``process_batch``, ``notify_step``, ``current_ledger``
* session: ``build_session``; SQL functions: ``register_sql_functions``
"""
from .functions.sql import register_sql_functions  # noqa: F401
from .operators.advice import advice_pick, classify_apply, suggestion_upsert  # noqa: F401
from .operators.classify import run_classifier  # noqa: F401
from .operators.commands import apply_command_table, apply_edits, merge_apply, split_apply  # noqa: F401
from .operators.extract import alert_normalise, alert_route, digest_extract, mail_route  # noqa: F401
from .operators.listing import deposit_list, ledger_page  # noqa: F401
from .operators.matching import apply_pairing, merge_candidates, refund_pairs, reimbursement_match  # noqa: F401
from .operators.notify import notify_digest, notify_queue  # noqa: F401
from .operators.reports import (annual_matrix, category_share, category_stats, freshness,  # noqa: F401
                                monthly_matrix, pending_merchants, summary)
from .session import build_session  # noqa: F401
from .streaming.ingest import current_ledger, notify_step, process_batch, start_ingest  # noqa: F401
