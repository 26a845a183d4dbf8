"""Governed media-dataset analytics on Spark: gates, lineage, frame metrics, selection, QC."""
