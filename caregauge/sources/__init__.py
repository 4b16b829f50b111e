from .io import (  # noqa: F401
    jdbc_options,
    jdbc_write_options,
    json_records,
    read_query,
    read_table,
    replace_statements,
    row_counts,
    with_date_parts,
    write_csv,
    write_parts,
    write_table,
    write_table_jdbc,
)
from .star import StarTables  # noqa: F401
