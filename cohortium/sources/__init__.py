from .conform import clean_header, conform, normalise_headers, resolve_column, to_number
from .readers import first_existing, path_exists, read_csv, read_many
from .writers import load_model, load_pipeline, save_model, suffixed, write_metadata, write_table

__all__ = [
    "clean_header", "conform", "normalise_headers", "resolve_column", "to_number", "first_existing", "read_csv",
    "read_many", "path_exists", "load_model", "load_pipeline", "save_model", "suffixed", "write_metadata", "write_table",
]
