"""Text and figures shown by the reports and exports."""

from pyspark.sql import functions as F

from nodeglass import settings as S


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def round2(value):
    """Two decimals, zero when missing."""
    return F.round(F.coalesce(_col(value).cast("double"), F.lit(0.0)), 2)


def ids_to_rotation(max_log_id, window=S.WINDOW):
    """Logs left before the layout rotates; a full window at a boundary."""
    return F.lit(window).cast("long") - _col(max_log_id) % window


def rotation_timer(max_log_id, window=S.WINDOW):
    return F.format_string(S.ROTATION_TIMER, ids_to_rotation(max_log_id, window))


def sync_status(active_column):
    return F.concat(_col(active_column), F.lit(S.SYNC_SUFFIX))


def log_message(code="http_response_code", latency="response_time_ms"):
    return F.format_string(S.LOG_MESSAGE, _col(code), _col(latency))


def iso_timestamp(ts, default=None):
    """ISO text of ``ts``; ``default`` (the current time) where it is missing."""
    ts = _col(ts)
    filled = F.coalesce(ts, F.current_timestamp() if default is None else default)
    return F.date_format(filled, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def ms_text(value):
    """Number with its unit; whole numbers are shown without decimals."""
    return F.concat(F.regexp_replace(_col(value).cast("string"), r"\.0$", ""), F.lit("ms"))


def latency_bar_pct(avg_latency, full_scale=250.0):
    return F.least(F.lit(100.0), F.coalesce(_col(avg_latency), F.lit(0.0)) / full_scale * 100)


def window_progress(max_log_id, window=S.WINDOW, warn_below=500):
    """Columns ``remaining``, ``progress``, ``progress_pct`` and ``near_rotation``."""
    remaining = ids_to_rotation(max_log_id, window)
    progress = (F.lit(window) - remaining) % window
    return [
        remaining.alias("remaining"),
        progress.alias("progress"),
        F.least(F.lit(100.0), progress / F.lit(float(window)) * 100).alias("progress_pct"),
        (remaining < warn_below).alias("near_rotation"),
    ]
