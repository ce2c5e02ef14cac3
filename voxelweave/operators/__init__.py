"""Relational operators of the engine: grids, components, catalogs, spectra, models."""
