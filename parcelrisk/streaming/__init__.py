"""Structured Streaming: labels refreshed as new events arrive, and withdrawn
as events close."""

from parcelrisk.streaming.label_refresh import (  # noqa: F401
    address_index, label_refresh_stream, new_positives,
)
from parcelrisk.streaming.label_state import (  # noqa: F401
    compact_labels, label_withdrawal_stream, labelled_addresses, labelled_entities, status_changes,
)
