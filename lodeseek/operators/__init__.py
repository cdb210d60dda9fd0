"""Operators over chunks, rankings and answers, as DataFrames in and out."""
