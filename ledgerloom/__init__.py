"""Declaration analytics as Spark plans: classify, extract, reconcile, gate, number, merge."""

__version__ = "0.1.0"
