"""Foliary: document-image text extraction and corpus analytics on Spark DataFrames."""
