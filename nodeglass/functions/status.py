"""Status, risk and flag expressions."""

from pyspark.sql import functions as F

from nodeglass import settings as S


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def http_label(code="http_response_code"):
    """Five labels; a code outside the known ones is UNKNOWN."""
    code = _col(code)
    return (
        F.when(code == S.HEALTHY_CODE, "HEALTHY")
        .when(code == S.PARTIAL_CODE, "PARTIAL")
        .when(code == S.THROTTLED_CODE, "THROTTLED")
        .when(code >= S.SERVER_ERROR_FROM, "CRITICAL")
        .otherwise("UNKNOWN")
    )


def map_label(code="http_response_code"):
    """The city map's four labels: every other code is CRITICAL."""
    code = _col(code)
    return (
        F.when(code == S.HEALTHY_CODE, "HEALTHY")
        .when(code == S.PARTIAL_CODE, "PARTIAL")
        .when(code == S.THROTTLED_CODE, "THROTTLED")
        .otherwise("CRITICAL")
    )


def risk_level(avg_latency, hits, limits=None):
    """Risk from the unrounded average latency or the anomaly hits."""
    avg_latency, hits = _col(avg_latency), _col(hits)
    level = F
    for name, above, at_least in limits or S.RISK_LIMITS:
        level = level.when((avg_latency > above) | (hits >= at_least), name)
    return level.otherwise("LOW")


def code_flag(value, code="http_response_code"):
    """1 where the code equals ``value``, else 0."""
    return F.coalesce((_col(code) == value).cast("int"), F.lit(0))


def display_status(infected="is_infected"):
    return F.when(_col(infected), "INFECTED").otherwise(S.CLAIMED_STATUS)


def is_alert_line(code="http_response_code"):
    """Log lines the console highlights."""
    return http_label(code) != "HEALTHY"


def status_mismatch(json_status="json_status", code="http_response_code"):
    """The device claims to be fine and the HTTP code says otherwise."""
    return (_col(json_status) == S.CLAIMED_STATUS) & (_col(code) != S.HEALTHY_CODE)
