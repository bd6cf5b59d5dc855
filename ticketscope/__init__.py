"""Support-ticket analytics on Spark."""

from ticketscope.config import Config
from ticketscope.dataset import TicketDataset
from ticketscope.operators.filters import TicketFilter
from ticketscope.plans.reports import REPORTS, run_report

__all__ = ["Config", "REPORTS", "TicketDataset", "TicketFilter", "run_report"]
