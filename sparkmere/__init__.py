"""A query engine on PySpark: columnar tables, exact predicates, vector search, queues and streams in one database."""

from .database import Database, Statement, Ticket, Transaction, connect
from .errors import BusyError, Code, Domain, EngineError, MisuseError

__version__ = "0.1.0"
__all__ = ["BusyError", "Code", "Database", "Domain", "EngineError", "MisuseError", "Statement", "Ticket", "Transaction", "__version__", "connect"]
