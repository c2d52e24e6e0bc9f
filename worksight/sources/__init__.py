from .readers import Dataset, load_dataset, load_evidence, load_projects, probe_files, read_table
from .schema import (DOCUMENTS, IMAGES, INSPECTIONS, PROJECTS, SPECS, TableSpec, normalize, rejected_rows,
                     resolve_headers)
from .sinks import to_records, write_records

__all__ = ["Dataset", "load_dataset", "load_evidence", "load_projects", "probe_files", "read_table",
           "DOCUMENTS", "IMAGES", "INSPECTIONS", "PROJECTS", "SPECS", "TableSpec", "normalize",
           "rejected_rows", "resolve_headers", "to_records", "write_records"]
