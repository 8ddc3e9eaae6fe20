"""Plumbline: data and model assurance on PySpark DataFrames."""
