"""loanmart: credit-default data marts and model monitoring as Spark plans."""

__version__ = "0.1.0"
