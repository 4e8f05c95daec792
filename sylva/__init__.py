"""sylva: a PySpark-native analytics engine for gridded heights, trees, footprints and corpora."""
