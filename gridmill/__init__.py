"""gridmill: gridded time series to monthly and yearly tables, as Spark DataFrame plans."""

from gridmill.plans import run, run_incremental, summarize_folder
from gridmill.session import session

__all__ = ["run", "run_incremental", "session", "summarize_folder"]
