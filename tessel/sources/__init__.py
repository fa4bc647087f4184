"""Readers and writers of documents, markup, logs and manifests."""
