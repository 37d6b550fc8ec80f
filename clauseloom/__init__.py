"""Segmentation of policy documents as Spark jobs."""
