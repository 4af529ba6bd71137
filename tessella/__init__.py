"""Tessella: SQL, full-text, JSON and vector queries over PySpark DataFrames."""

from tessella.connection import Connection, Cursor, Row, Rows, Statement, connect
from tessella.errors import Busy, BusySnapshot, EngineError, GeneralError, InternalError, IoError, NotImplementedFeature, SqlError

__all__ = ["Busy", "BusySnapshot", "Connection", "Cursor", "EngineError", "GeneralError", "InternalError", "IoError", "NotImplementedFeature", "Row", "Rows", "SqlError", "Statement", "connect"]
