"""Readers of labels, manifests, images and grids, and writers of reports."""
