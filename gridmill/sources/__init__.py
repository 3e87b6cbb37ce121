from gridmill.sources.datasource import message_source, register_source
from gridmill.sources.files import (
    deal_files,
    decode_files,
    describe,
    empty_files,
    file_names,
    flag_unreadable,
    scan_files,
    split_decoded,
    split_files,
)
from gridmill.sources.index import MessageIndex, index_files, read_messages, stale_files
from gridmill.sources.isolation import Limits
from gridmill.sources.ledger import Change, FileLedger, load_files
from gridmill.sources.published import current_run, followed, new_run, publish
from gridmill.sources.scratch import (
    delete_folder,
    materialize,
    release_scratch,
    scratch_in,
    scratch_path,
    scratch_root,
)
from gridmill.sources.tables import (
    monthly_cells,
    read_summary,
    scan_monthly_cells,
    scan_monthly_csv,
    scan_monthly_partitions,
    union_years,
)

__all__ = [
    "Change",
    "FileLedger",
    "Limits",
    "MessageIndex",
    "current_run",
    "deal_files",
    "empty_files",
    "followed",
    "index_files",
    "load_files",
    "message_source",
    "register_source",
    "new_run",
    "publish",
    "read_messages",
    "stale_files",
    "decode_files",
    "delete_folder",
    "describe",
    "file_names",
    "flag_unreadable",
    "materialize",
    "read_summary",
    "release_scratch",
    "scan_files",
    "scan_monthly_cells",
    "scan_monthly_csv",
    "scan_monthly_partitions",
    "monthly_cells",
    "scratch_in",
    "scratch_path",
    "scratch_root",
    "split_decoded",
    "split_files",
    "union_years",
]
