"""Row contract, referential checks and table checks."""

from pyspark.sql import functions as F

from nodeglass import settings as S
from nodeglass.functions import load_version

# Accepted codes and latencies.
CODE_RANGE = (100, 599)
KNOWN_CODES = [200, 206, 429]
LATENCY_RANGE = (0, 10_000)
SERIAL_PREFIX = "SN-"


def with_reasons(rows):
    """Default the status and list, per row, what breaks the contract."""
    code, ms = F.col("http_response_code"), F.col("response_time_ms")
    reason = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    return rows.withColumns({
        "json_status": F.coalesce("json_status", F.lit(S.CLAIMED_STATUS)),
        "reasons": F.array_compact(F.array(
            reason(F.col("node_id").isNull(), "node_id missing"),
            reason(~code.between(*CODE_RANGE), "http_response_code out of range"),
            reason(ms < 0, "response_time_ms negative"),
        )),
    })


def split_rows(rows):
    """``(valid, rejected)``; rejected rows carry their ``reasons``."""
    checked = with_reasons(rows)
    good = F.size("reasons") == 0
    return checked.filter(good).drop("reasons"), checked.filter(~good)


def known_nodes_only(logs, nodes):
    return logs.join(nodes.select(F.col("node_uuid").alias("node_id")), "node_id", "left_semi")


def unknown_nodes_only(logs, nodes):
    return logs.join(nodes.select(F.col("node_uuid").alias("node_id")), "node_id", "left_anti")


def orphan_node_ids(logs, nodes):
    """Distinct first, so the join sees one row per node, not per log."""
    return unknown_nodes_only(logs.select("node_id").distinct(), nodes)


def duplicate_ids(logs, key="log_id"):
    """One row: how many rows have an id that another row has already.

    Ids are marked in blocks of 64 as the bits of one number. Logs lie in id
    order, so tasks bring a block down to one row before it moves, and no id is
    shuffled by itself; a block with fewer bits than rows has repeated ids.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod({key}, 64) AS INT))")
    blocks = logs.where(F.col(key).isNotNull()).groupBy(F.shiftright(key, 6).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("bits"))
    return blocks.agg(F.coalesce(F.sum(F.col("n") - F.bit_count("bits")), F.lit(0)).cast("long").alias("duplicate_log_id"))


def quality_report(logs, nodes, mode="step", window=S.WINDOW):
    """One row per check with the number of violations.

    Two scans of the logs: a counting pass, and the id uniqueness, which groups
    blocks of ids and so is kept apart and narrow.
    """
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    version = load_version("log_id", mode, window)
    wrong_column = ((version == 1) & F.col("l_v1").isNotNull()) | ((version == 2) & F.col("load_val").isNotNull())
    counted = logs.agg(
        bad(~F.col("response_time_ms").between(*LATENCY_RANGE)).alias("latency_out_of_range"),
        bad(F.col("json_status") != S.CLAIMED_STATUS).alias("json_status_not_operational"),
        bad(~F.col("http_response_code").isin(KNOWN_CODES)).alias("unexpected_http_code"),
        bad(wrong_column).alias("load_in_inactive_column"),
    )
    unique = duplicate_ids(logs)
    serials = nodes.agg(bad(~F.col("serial_number").startswith(SERIAL_PREFIX)).alias("serial_without_prefix"))
    orphans = orphan_node_ids(logs, nodes).agg(F.count(F.lit(1)).alias("log_node_not_in_registry"))
    long_form = lambda df: df.unpivot([], df.columns, "check_name", "violations")
    report = long_form(counted)
    for part in (unique, serials, orphans):
        report = report.union(long_form(part))
    return report


def latency_range(logs):
    return logs.agg(
        F.min("response_time_ms").alias("min_latency"), F.max("response_time_ms").alias("max_latency")
    )
