"""Serial numbers shared by several nodes."""

from pyspark.sql import functions as F

from nodeglass.operators.skew import salted_join


def _counted(nodes):
    """Serials carried by more than one node; ``named`` is 0 for nodes without one."""
    return nodes.groupBy("serial_number").agg(
        F.count("node_uuid").alias("clone_count"),
        F.coalesce(F.sum(F.col("is_infected").cast("long")), F.lit(0)).alias("infected_count"),
        F.count("serial_number").alias("named"),
    ).filter(F.col("clone_count") > 1)


def clone_groups(nodes):
    """Serials carried by more than one node, with counts."""
    return _counted(nodes).drop("named")


def clone_members(nodes):
    """Every node whose serial is shared, one row per node.

    A salted join against the shared serials rather than a count over a window,
    so a serial copied onto a large part of the fleet is split over many tasks.
    Nodes without a serial are left out by their count, not by a null filter,
    so the serial is decoded once for the groups and once for the rows.
    """
    shared = _counted(nodes).filter(F.col("named") > 0).drop("named")
    return salted_join(nodes, shared, "serial_number", "node_uuid")


def cloned_identities(nodes, list_size=10_000):
    """One row per shared serial with its sorted node ids.

    A serial with more nodes than ``list_size`` gets several rows, numbered by
    ``part``, that together hold all its nodes; the counts are those of the
    whole serial on every row.
    """
    parts = F.ceil(F.col("clone_count") / list_size)
    return (
        clone_members(nodes)
        .withColumn("part", F.pmod(F.xxhash64("node_uuid"), parts).cast("int"))
        .groupBy("serial_number", "clone_count", "infected_count", "part")
        .agg(F.sort_array(F.collect_list("node_uuid")).alias("node_uuids"))
    )


def clone_totals(nodes):
    return clone_groups(nodes).agg(
        F.count(F.lit(1)).alias("total_cloned_serials"),
        F.coalesce(F.sum("clone_count"), F.lit(0)).alias("total_affected_nodes"),
    )


def clone_infection_rates(nodes):
    """Infection rate of cloned nodes beside that of the whole fleet."""
    infected = F.col("is_infected").cast("double")
    rates = lambda df, name: df.agg(
        F.lit(name).alias("scope"),
        F.count(F.lit(1)).alias("node_count"),
        F.avg(infected).alias("infected_rate"),
    )
    return rates(clone_members(nodes), "cloned").union(rates(nodes, "all"))
