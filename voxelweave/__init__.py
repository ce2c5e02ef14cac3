"""Spark-native structure catalogs: voxel tables, connected structures, catalog analytics."""
