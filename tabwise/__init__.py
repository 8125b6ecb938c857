"""tabwise: profile, clean, summarise, model and question any table with Spark."""

from tabwise.session import checkpoint_cut, session

__all__ = ["session", "checkpoint_cut"]
