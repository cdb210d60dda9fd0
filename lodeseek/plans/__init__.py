"""Whole plans over several operators: index snapshots and question answering."""
