"""Which load column is live, and the load it gives.

Version 1 of the log layout fills ``load_val``, version 2 fills ``l_v1``.
"""

from pyspark.sql import functions as F

from nodeglass import settings as S


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def window_id(log_id="log_id", window=S.WINDOW):
    """Number of the tumbling count window a log id falls in."""
    return F.call_function("div", _col(log_id), F.lit(window).cast("long"))


def load_version(log_id="log_id", mode="cyclic", window=S.WINDOW):
    """Layout version of a log id.

    ``cyclic`` switches at every window; ``step`` switches once, at the first
    window boundary. The two agree below ``2 * window``.
    """
    log_id = _col(log_id)
    if mode == "cyclic":
        return (window_id(log_id, window) % 2 + 1).cast("int")
    if mode == "step":
        return F.when(log_id >= window, 2).otherwise(1)
    raise ValueError(f"mode must be 'cyclic' or 'step', not {mode!r}")


def effective_load(version, load_val="load_val", l_v1="l_v1"):
    """Strict: only the live column counts, a missing value stays missing."""
    return F.when(_col(version) == 2, _col(l_v1)).otherwise(_col(load_val))


def fallback_load(version, load_val="load_val", l_v1="l_v1"):
    """The live column, falling back to ``load_val``."""
    return F.coalesce(F.when(_col(version) == 2, _col(l_v1)), _col(load_val))


def coalesced_load(load_val="load_val", l_v1="l_v1", fill=S.LOAD_FILL):
    """Ignores the rotation: the first value present, else ``fill``."""
    return F.coalesce(_col(load_val), _col(l_v1), F.lit(fill))


def resolved_load(policy="effective", mode="cyclic", window=S.WINDOW):
    """Load before filling, under one of the two scoring policies."""
    if policy == "effective":
        return effective_load(load_version("log_id", mode, window))
    if policy == "coalesce":
        return F.coalesce(F.col("load_val"), F.col("l_v1"))
    raise ValueError(f"policy must be 'effective' or 'coalesce', not {policy!r}")


def null_if_nan(value):
    value = _col(value)
    return F.when(~F.isnan(value), value)
