"""Corvid: a retrieval and corpus analytics engine on PySpark DataFrames."""
