"""Spatio-temporal scene analytics and question-answering evaluation on PySpark."""
