from .intake import (count_stream, current_counts, decision_stream, deduplicated, report_stream, run_now,
                     write_append, write_counts)
from .maintained import MaintainedTable
from .waiting import waiting_decisions, waiting_reports

__all__ = ["count_stream", "current_counts", "decision_stream", "deduplicated", "report_stream", "run_now",
           "write_append", "write_counts", "MaintainedTable", "waiting_decisions", "waiting_reports"]
