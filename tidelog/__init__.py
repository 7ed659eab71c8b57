"""Event-log, ledger and snapshot analytics as plain DataFrame functions on Spark."""

from tidelog.vocab import Thresholds, Vocabulary

__all__ = ["Thresholds", "Vocabulary"]
