from newsloom.sinks.tables import (
    append,
    append_new,
    ensure_table,
    insert_if_absent,
    update_partitions,
    update_table,
)

__all__ = ["append", "append_new", "ensure_table", "insert_if_absent", "update_partitions", "update_table"]
