"""Part of the document engine; see the README."""
