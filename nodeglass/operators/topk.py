"""Ordering, pages and quotas."""

from pyspark.sql import Window, functions as F

from nodeglass import settings as S
from nodeglass.operators.numbering import number_rows
from nodeglass.operators.windows import newest_folder

# Pages up to here are taken by a bounded top-k; deeper ones by row number.
SHALLOW = 100_000


def page(df, order, skip, limit, tiebreak=None):
    """Rows ``skip`` .. ``skip + limit`` by ``order`` (ascending).

    Deep pages are cut from a distributed numbering, since a top-k would hold
    everything before the page in one place.
    """
    keys = [order] + ([tiebreak] if tiebreak else [])
    if skip < 0 or limit < 1:
        raise ValueError("skip must be >= 0 and limit >= 1")
    if skip + limit <= SHALLOW:
        return df.orderBy(*keys).offset(skip).limit(limit)
    numbered = number_rows(df, "_row", 0, keys)
    wanted = (F.col("_row") >= skip) & (F.col("_row") < skip + limit)
    return numbered.filter(wanted).drop("_row").orderBy(*keys)


def page_after(df, key, last, limit):
    """Next page by key: the filter reaches the scan, however deep the page."""
    return df.filter(F.col(key) > last).orderBy(key).limit(limit)


def registry_page(nodes, skip=0, limit=100):
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    return page(nodes.select("node_uuid", "user_agent", "serial_number", "is_infected"), "node_uuid", skip, limit)


def anomaly_page(anomalies, skip=0, limit=200):
    """Most anomalous first."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1..1000")
    return page(anomalies, "anomaly_score", skip, limit, "log_id")


def latest_logs(logs, count):
    """Newest first. In a stored log table the newest folder is usually enough."""
    newest = newest_folder(logs)
    enough = newest is not logs and newest.select("log_id").limit(count).count() == count
    return (newest if enough else logs).orderBy(F.desc("log_id")).limit(count)


def table_view(df, key, steps=1, step_size=50):
    """The first rows a table shows after ``steps`` loads."""
    return df.orderBy(key).limit(steps * step_size)


def stratified_top(df, quotas=None, stratum="risk_level", by="avg_response_time_ms", tiebreak="node_uuid"):
    """The best rows of each stratum, up to its quota, strata in quota order.

    The largest quota is a literal bound on the rank, which lets Spark cut each
    stratum before the shuffle; no task receives a whole stratum.
    """
    quotas = quotas or S.RISK_QUOTAS
    names = list(quotas)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc(by), tiebreak))
    quota = F.lit(0)
    order = F.lit(len(names))
    for place, name in enumerate(names):
        quota = F.when(F.col(stratum) == name, quotas[name]).otherwise(quota)
        order = F.when(F.col(stratum) == name, place).otherwise(order)
    return (
        df.filter(F.col(stratum).isin(names))
        .withColumn("stratum_rank", rank)
        .filter(F.col("stratum_rank") <= max(quotas.values()))
        .filter(F.col("stratum_rank") <= quota)
        .withColumn("stratum_order", order)
        .orderBy("stratum_order", "stratum_rank")
    )
