"""Column builders: photometry, astrometry, shapes, profiles."""
