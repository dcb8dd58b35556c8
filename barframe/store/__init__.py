"""Stores: series on a file system, with manifests, recovery, snapshots and a registry."""
