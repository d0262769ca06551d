"""Registered queries and their SQL twins."""

from tidemark.plans import catalogs, contents, drills, general, readers, restores, snapshots, timeline

CATALOG = (general, snapshots.CATALOG, timeline.CATALOG, contents.CATALOG, catalogs.CATALOG, restores.CATALOG, drills.CATALOG, readers.CATALOG)
