from gridmill.plans.climate import Outcome, first_file_variables, monthly_from_messages, run, summarize_folder
from gridmill.plans.incremental import file_states, run_incremental

__all__ = [
    "Outcome",
    "file_states",
    "first_file_variables",
    "monthly_from_messages",
    "run",
    "run_incremental",
    "summarize_folder",
]
