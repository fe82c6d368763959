"""Column-level building blocks: spectra, grids, hash draws and decision rules."""
