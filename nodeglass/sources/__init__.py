from nodeglass.sources.readers import (
    load_node_registry, load_schema_config, load_system_logs, read_table,
)
from nodeglass.sources.writers import (
    append_logs, append_new, refresh_reference_tables, seed_anomalies, seed_logs, seed_nodes,
    seed_schema_config,
)
from nodeglass.sources.exports import heatmap_export, registry_export, write_export
