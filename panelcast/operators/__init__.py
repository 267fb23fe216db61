"""Relational and modelling operators over panel DataFrames."""
