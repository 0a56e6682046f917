"""Runnable jobs over the library: ``python -m jobs.word_panel --help``, ``python -m jobs.cell_report --help``."""
