"""Readers and writers of bundles, manifests, pages and lines."""
