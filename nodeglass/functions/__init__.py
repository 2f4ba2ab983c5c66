from nodeglass.functions.identity import decode_serial_number
from nodeglass.functions.status import (
    code_flag, display_status, http_label, is_alert_line, map_label, risk_level, status_mismatch,
)
from nodeglass.functions.load import (
    coalesced_load, effective_load, fallback_load, load_version, null_if_nan, resolved_load, window_id,
)
from nodeglass.functions.display import (
    iso_timestamp, latency_bar_pct, log_message, ms_text, rotation_timer, round2, sync_status,
    window_progress,
)
